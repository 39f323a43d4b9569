"""Token ids in Arrow files: record batches of fixed-size lists, equal-length sequences with masks.

Each part is an Arrow IPC file whose rows are sequences of ``length`` ids, with two masks of the same length: ``real``
(false on the padding after the part's last token) and ``end`` (true on a document's last id). All buffers are plain
and uncompressed, so a reader that maps the file gets any sequence without a copy. Beside it lies a small file with
each document's id, first token and token count. Parts follow the order of doc_id, and so do documents in a part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.chunks import AT_ONCE
from folio.llm.common import held, new_path, put, written

#: Sequences in a record batch.
BATCH = 256
END_ID = 0

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_schema(length: int, wide: bool = False) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(kind, length)), ("real", pa.list_(pa.bool_(), length)), ("end", pa.list_(pa.bool_(), length))])


class PartWriter:
    """Packs documents into sequences and writes full batches as they fill; at most one batch is held."""

    def __init__(self, sink, length: int, wide: bool) -> None:
        self.schema, self.length = file_schema(length, wide), length
        self.file = ipc.new_file(sink, self.schema)
        self.kind = np.uint32 if wide else np.uint16
        self.ids = np.zeros(BATCH * length, self.kind)
        self.end = np.zeros(BATCH * length, bool)
        self.fill = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, len(self.ids) - self.fill)
            self.ids[self.fill : self.fill + n] = ids[at : at + n]
            self.fill, at = self.fill + n, at + n
            if at == len(ids):
                self.end[self.fill - 1] = True
            if self.fill == len(self.ids):
                self._flush()
        self.total += len(ids)

    def _flush(self) -> None:
        rows = -(-self.fill // self.length)
        n = rows * self.length
        self.ids[self.fill : n] = 0
        lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.ids[:n]), pa.array(np.arange(n) < self.fill), pa.array(self.end[:n]))]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.end[:] = False
        self.fill = 0

    def close(self) -> None:
        if self.fill:
            self._flush()
        self.file.close()


def write_token_files(docs: DataFrame, path: str, encoder: Callable[[], Callable[[list[str]], list[bytes]]], length: int = 1024, wide: bool = False, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's ids, each with ``end_id`` appended, in ascending order of id; returns the manifest.

    Documents are dealt by ranges of id, so a part holds a run of the order; null ids come first, and rows with one id
    are ordered by text. A null text is empty. A part is written under a name of its own and then moved to its place,
    so a task that runs twice leaves one file. The manifest (part, documents, tokens) is a written table: the files
    are written once, whatever is lost later.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        ids_of = encoder()
        own = f"{root}/.{uuid.uuid4().hex}"
        index: list[list] = [[], [], []]
        writer = None
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                cut = b.slice(k, AT_ONCE)
                for doc, found in zip(cut.column(0).to_pylist(), ids_of([t or "" for t in cut.column(1).to_pylist()]), strict=True):
                    if writer is None:
                        store.create_dir(root, recursive=True)
                        sink = store.open_output_stream(own)
                        writer = PartWriter(sink, length, wide)
                    ids = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id))
                    for c, v in zip(index, (doc, writer.total, len(ids)), strict=True):
                        c.append(v)
                    writer.add(ids)
        if writer is None:
            return
        writer.close()
        sink.close()
        put(store, own, f"{root}/{part:06d}.arrow")
        with store.open_output_stream(own) as sink, ipc.new_file(sink, INDEX) as f:
            f.write_table(pa.table(index, schema=INDEX), max_chunksize=1 << 16)
        put(store, own, f"{root}/{part:06d}.index.arrow")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "documents": [len(index[0])], "tokens": [writer.total]})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("doc_id").asc_nulls_first()
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, by).sortWithinPartitions(by, "text")
    return written(ordered.mapInArrow(write, "part int, documents long, tokens long"), "token-manifest")


def _opened(store: fs.FileSystem, path: str) -> ipc.RecordBatchFileReader:
    return ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def sequence(path: str, part: int, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sequence of a part with its masks, by random access; the ids are a view of the file where it can be mapped."""
    store, root = fs.FileSystem.from_uri(path)
    batch = _opened(store, f"{root}/{part:06d}.arrow").get_batch(row // BATCH)
    return tuple(batch.column(k)[row % BATCH].values.to_numpy(zero_copy_only=k == 0) for k in range(3))


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Every document back from the files: doc_id, start (ids of all documents before it), n_tokens, ids (32-bit, little-endian).

    A part whose masks and index disagree raises. Parts are read in parallel, one batch at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for part, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = _opened(store, f"{root}/{part:06d}.index.arrow").read_all()
                starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                file = _opened(store, f"{root}/{part:06d}.arrow")
                at, done = 0, 0
                held = np.zeros(0, np.uint32)
                for k in range(file.num_record_batches):
                    batch = file.get_batch(k)
                    ids, real, end = (batch.column(c).flatten() for c in ("ids", "real", "end"))
                    n = int(np.count_nonzero(real.to_numpy(zero_copy_only=False)))
                    stops = np.flatnonzero(end.to_numpy(zero_copy_only=False)[:n]) + 1
                    held = np.concatenate([held, ids.to_numpy()[:n]], dtype=np.uint32)
                    stops = stops + len(held) - n
                    if not len(stops):
                        continue
                    to = done + len(stops)
                    if not np.array_equal(stops + at, starts[done:to] + counts[done:to]):
                        raise ValueError(f"part {part}: ends of documents are not where its index has them")
                    rows = [held[i:j].tobytes() for i, j in zip(np.append(0, stops[:-1]), stops, strict=True)]
                    yield pa.RecordBatch.from_arrays([index.column("doc_id")[done:to].combine_chunks(), pa.array(starts[done:to] + before), pa.array(counts[done:to]), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at, done, held = at + int(stops[-1]), to, held[stops[-1] :]
                if done != len(starts) or len(held):
                    raise ValueError(f"part {part} holds {done} documents; its index has {len(starts)}")

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", before.alias("before"))  # a row per part
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def cuts_safely(vocabulary: str) -> bool:
    """Does the tokenizer in this file cut texts as ``ChunkMemory`` takes it: byte-level pieces by the usual pattern, nothing before?"""
    with open(vocabulary, encoding="utf-8") as f:
        told = json.load(f)
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    tokens = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in told.get("added_tokens", []))
    return bool(plain and bpe and tokens and told.get("normalizer") is None)


def library_encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """The tokenizers library's ids; the one encoder that a worker keeps.

    They come through a memory of chunks where the file says that chunks have the same ids wherever they stand, else
    each whole text is encoded.
    """

    def make() -> Callable[[list[str]], list[bytes]]:
        from tokenizers import Tokenizer

        from folio.llm.chunks import ChunkMemory

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not cuts_safely(vocabulary):
            return lambda texts: [np.asarray(ids, "<u4").tobytes() for ids in encode(texts)]
        added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        # Each character of a byte-level token stands for one byte.
        id_bytes = np.array([len(added[i].encode()) if i in added else len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])
        return ChunkMemory(encode, id_bytes, list(added.values())).ids

    return held(("library", vocabulary), make)


def needs_wide(vocabulary: str) -> bool:
    """Are there ids above 16 bits?"""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size() > 1 << 16


def tokens_of_documents(docs: DataFrame, vocabulary: str, length: int = 1024) -> DataFrame:
    """Write ``docs`` as token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, path, lambda: library_encoder(vocabulary), length, needs_wide(vocabulary))

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [zlib.crc32(x.as_buffer()) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_token_files(manifest, path).mapInArrow(checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
