"""BPE encoding and decoding of whole texts by the backtracking encoder and the offset tables of ``bpe``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bpe import Bpe
from folio.llm.chunks import AT_ONCE, ChunkMemory
from folio.llm.common import held, spread


def encoder(vocabulary: str, pattern: str) -> tuple[Bpe, Callable[[list[str]], list[bytes]]]:
    """The one encoder that a worker keeps."""

    def make() -> tuple[Bpe, Callable[[list[str]], list[bytes]]]:
        bpe = Bpe(vocabulary, pattern)
        return bpe, ChunkMemory(lambda texts: [bpe.encode(t) for t in texts], np.diff(bpe.bytes_table.offset), list(bpe.added), remember=600_000).ids

    return held(("bpe", vocabulary, pattern), make)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: 32-bit, little-endian), in input order. A null text is empty; rows that repeat give equal ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_of = encoder(vocabulary, pattern)
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                cut = b.slice(k, AT_ONCE)
                ids = ids_of([t or "" for t in cut.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = encoder(vocabulary, pattern)
        for b in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "text"])

    return encoded.mapInArrow(rows, "doc_id long, n_tokens long, text string")


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from the ids).

    One pass, no shuffle, a row per row: a null text is empty, rows that repeat give equal rows, an empty table an empty one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ids_of = encoder(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                cut = b.slice(k, AT_ONCE)
                ids = [np.frombuffer(x, "<u4") for x in ids_of([t or "" for t in cut.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(bpe.decimals(x)) for x in ids]), pa.array([sha(bpe.decode(x).encode()) for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
