"""Media columns: content-addressed payloads in tar shards.

A payload's bytes are the samples of an 8-bit grey PNG, ``WIDTH`` wide. Each task appends the media of its rows to one
tar shard, where a member is named by the digest of its bytes and stored once; rows carry digest, shard, offset and
length. An index gives each digest one place for all rows, so copies in other shards are never read. Metadata columns
are filled by range reads of the header alone.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import new_path, put, spread, written

WIDTH = 192
#: Fixed values of the PNG format: signature, and the bytes up to the end of the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's bytes, filled with spaces up to a positive multiple of ``WIDTH``; and how many bytes it has itself."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_media(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter type 0
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from a file's first ``HEADER_BYTES`` bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def to_payload(media: bytes) -> bytes:
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, parts = HEADER_BYTES, []
    while media[at + 4 : at + 8] != b"IEND":
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            parts.append(media[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's payload under ``path``; a written table with a row per row of ``docs``: columns of ``INDEX``.

    A null text is empty: its payload is ``WIDTH`` spaces. A shard is written beside its place and moved there, so a task
    that runs twice leaves one file. Nothing but the index rows leaves a task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        name = f"{TaskContext.get().partitionId():06d}.tar"
        own, out, at, places = f"{root}/.{uuid.uuid4().hex}", None, 0, {}
        for b in batches:
            for k in range(0, len(b), 256):
                cut = b.slice(k, 256)
                rows = []
                for text in cut.column(1).to_pylist():
                    payload, n = payload_of(text)
                    key = hashlib.sha256(payload).digest()
                    if key not in places:
                        if out is None:
                            store.create_dir(root, recursive=True)
                            out = store.open_output_stream(own)
                        media = to_media(payload)
                        digest = hashlib.sha256(media).hexdigest()
                        member = tarfile.TarInfo(f"{digest}.png")
                        member.size = len(media)
                        head = member.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + b"\0" * (-len(media) % 512))
                        places[key] = (digest, at + len(head), len(media))
                        at += len(head) + len(media) + -len(media) % 512
                    rows.append((n, *places[key]))
                n, digest, offset, length = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array([name] * len(rows)), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=[c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()
            put(store, own, f"{root}/{name}")

    return written(spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(write, INDEX), "media-index")


def places(index: DataFrame) -> DataFrame:
    """One place of each digest: the first shard that has it. Sorted by shard, so that a reader opens each file once."""
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return one.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(b: pa.RecordBatch, store: fs.FileSystem, root: str, most: int | None) -> Iterator[bytes]:
    file, name = None, None
    for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            if file is not None:
                file.close()
            file, name = store.open_input_file(f"{root}/{shard}"), shard
        yield file.read_at(min(length, most or length), offset)
    if file is not None:
        file.close()


def with_metadata(index: DataFrame, path: str) -> DataFrame:
    """Add width, height and bits to rows with digest, shard, offset and length: ``HEADER_BYTES`` of each are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            found = [read_header(x) for x in _ranges(b, store, root, HEADER_BYTES)]
            w, h, bits = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(bits, pa.int32())], names=[*b.schema.names, "width", "height", "bits"])

    picked = index.select("digest", "shard", "offset", "length")
    return picked.mapInArrow(rows, "digest string, shard string, offset long, length long, width int, height int, bits int")


FEATURES = "digest string, shard string, offset long, length long, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_features(index: DataFrame, path: str) -> DataFrame:
    """Read each payload back, and what its samples say: FEATURES, a row per row. Bytes that don't match the digest raise."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for k in range(0, len(b), 256):
                cut, out = b.slice(k, 256), []
                given = (cut.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height", "bits"))
                for digest, shard, offset, length, w, h, bits, media in zip(*given, _ranges(cut, store, root, None), strict=True):
                    payload = to_payload(media)
                    sha = hashlib.sha256(media).hexdigest()
                    if sha != digest or len(payload) != w * h:
                        raise ValueError(f"stored bytes of {digest} have digest {sha}")
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    mean = int(counts @ np.arange(256)) / len(payload)
                    feature = f"png {w}x{h} gray{bits} mean={mean:.4f} levels={np.count_nonzero(counts)} mode={int(np.argmax(counts))}"
                    out.append((digest, shard, offset, length, w, h, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha, feature))
                columns = list(zip(*out, strict=True))
                kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
                names, types = zip(*(c.split() for c in FEATURES.split(", ")), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))

    return index.mapInArrow(rows, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store, then read back: doc_id, n_bytes and FEATURES. A digest has one place for all rows, and is read once."""
    path = new_path(docs.sparkSession, "media")
    index = write_shards(docs, path)
    found = written(with_features(with_metadata(places(index), path), path), "media-features")
    rows = index.select("doc_id", "n_bytes", F.col("digest").alias("_digest"))
    return rows.join(found, F.col("_digest") == F.col("digest")).drop("_digest")
