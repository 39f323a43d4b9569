"""Filter interaction audit: what each filter of a chain removes in every order of the chain.

A document's verdicts are one mask, so a part of the table is no more than 2^n counts (``mask_cells``). All orders of
the filters are then visited by adjacent transpositions (each order differs from the one before by one swap of two
neighbours): a swap changes one prefix of the order, so only the two steps it touches are counted anew from the cells,
and Shapley sums grow along the walk. Texts are read once; what is shuffled is a digest, an id and a mask a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import WORD

#: Filters whose orders are walked; n! rows and n * n! steps a part.
MOST_FILTERS = 8


def document_flags(text: Column) -> dict[str, Column]:
    """The four conditions of the audit that a text alone decides; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], copies: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic. Bit k of a mask is the k-th name of ``flags`` and ``copies``, sorted.

    ``copies`` fails where a smaller id has the same text anywhere in the table; null texts are empty, a null id is no
    smaller than any and has no smaller. Rows that repeat count each; a label counts once an id, whatever its repeats.
    A part is null's too: the empty string. Copies are found by partial aggregations alone: rows of one text meet first
    by id (where labels join), so a text that fills a third of the table is a few rows a task before it is dealt by text.
    """
    names = sorted([*flags, copies])
    bit = {name: 1 << k for k, name in enumerate(names)}
    mask = sum((F.when(F.coalesce(c, F.lit(False)), bit[k]).otherwise(0) for k, c in flags.items()), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), digest.alias("_text"), mask.alias("_mask"))
    rows = rows.withColumn("_salt", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("_text"), F.lit(9973))).otherwise(0).cast("int"))  # rows without an id lie apart
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic")).withColumn("_salt", F.lit(0))
    met = rows.join(told, ["_id", "_salt"], "left").select("_id", "_salt", "part", "_text", "_mask", F.coalesce("_good", F.lit(False)).alias("_good"), F.coalesce("_toxic", F.lit(False)).alias("_toxic"))
    kind = ["_text", "_mask", "part", "_good", "_toxic"]
    by_id = met.groupBy("_id", "_salt", *kind).agg(F.count("*").alias("_n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("_n").alias("_rows"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))).alias("_least"),
        F.sum(F.when(F.col("_id").isNotNull(), F.col("_n")).otherwise(0)).alias("_known"),
    )
    by_text = by_kind.groupBy("_text").agg(F.min("_least._id").alias("_first"), F.collect_list(F.struct("part", "_mask", "_good", "_toxic", "_rows", "_least", "_known")).alias("_kinds"))
    each = by_text.select("_first", F.explode("_kinds").alias("k")).select("_first", "k.*")
    copied = F.col("_known") - F.when(F.col("_least._id") == F.col("_first"), F.col("_least._n")).otherwise(0)
    cells = each.select("part", "_good", "_toxic", F.explode(F.array(
        F.struct(F.col("_mask").alias("mask"), (F.col("_rows") - copied).alias("n")),
        F.struct((F.col("_mask") + bit[copies]).alias("mask"), copied.alias("n")),
    )).alias("c")).select("part", "c.mask", "c.n", "_good", "_toxic")
    count = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("_good").alias("good"), count("_toxic").alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose swap with the next one leads from each order of ``n`` things to the next: n! - 1 swaps, all orders once."""
    order, heading = list(range(n)), [-1] * n  # a thing moves past smaller ones until it meets a larger one or the end
    for _ in range(factorial(n) - 1):
        place = {thing: k for k, thing in enumerate(order)}
        free = lambda x: 0 <= (to := place[x] + heading[x]) < n and order[to] < x
        mover = max(x for x in range(n) if free(x))
        at, to = place[mover], place[mover] + heading[mover]
        order[at], order[to] = order[to], order[at]
        for x in range(mover + 1, n):
            heading[x] = -heading[x]
        yield min(at, to)


def walk(cells: np.ndarray, n: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """``cells``: (parts, 2^n, counts). Each order, with what stands before its first step and after each step:
    an array (n + 1, parts, counts) that is changed in place by one row an order."""
    masks = np.arange(1 << n)
    after = lambda order: cells[:, (masks & sum(1 << f for f in order)) == 0].sum(axis=1)
    order = list(range(n))
    kept = np.stack([after(order[:k]) for k in range(n + 1)])
    yield order, kept
    for at in adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        kept[at + 1] = after(order[: at + 1])  # steps at and at + 1 share this prefix; all others stand
        yield order, kept


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_orders(cells: DataFrame, names: list[str]) -> DataFrame:
    """Every order of ``names`` over the ``cells`` of each part: AUDIT, zeros included. ``names`` are single letters, sorted."""
    n = len(names)
    if n > MOST_FILTERS or names != sorted(set(names)):
        raise ValueError("filters must be sorted, different, and few")
    wide = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                cut = b.slice(k, 64)
                counts = np.zeros((len(cut), 1 << n, 3), np.int64)
                for p, found in enumerate(cut.column(1).to_pylist()):
                    for c in found:
                        counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield _audited(cut.column(0), counts, names)

    return wide.mapInArrow(rows, AUDIT)


def _audited(parts: pa.Array, counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    n, orders = len(names), factorial(len(names))
    masks = np.arange(1 << n)
    fails = np.stack([counts[:, (masks >> f) & 1 == 1, 0].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([counts[:, 1 << f, 0] for f in range(n)], axis=1)
    shapley = np.zeros((len(parts), n), np.int64)
    texts, filters = [], np.zeros((orders, n), np.int64)
    kept = np.zeros((len(parts), orders, n), np.int64)
    lost = np.zeros((len(parts), orders, n, 3), np.int64)
    steps: np.ndarray | None = None
    for k, (order, left) in enumerate(walk(counts, n)):
        texts.append("".join(names[f] for f in order))
        filters[k] = order
        steps = left[:-1] - left[1:]
        lost[:, k], kept[:, k] = steps.transpose(1, 0, 2), left[1:, :, 0].T
        shapley[:, order] += steps[:, :, 0].T
    removed = lost[..., 0]
    by_step = lambda table: table[:, filters]  # noqa: E731  a filter's figure at the steps where it stands
    columns = [
        parts.take(pa.array(np.repeat(np.arange(len(parts)), orders * n))),
        pa.array(texts * len(parts)).take(pa.array(np.repeat(np.arange(orders * len(parts)), n))),
        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), orders * len(parts))),
        *(pa.array(x.reshape(-1)) for x in (kept, removed, by_step(fails) - removed, by_step(alone), lost[..., 1], lost[..., 2], by_step(shapley))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in AUDIT.split(", ")])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole texts, in all 120 orders, for each value of ``lang``."""
    return audit_orders(mask_cells(docs, labels, document_flags(F.col("text")), "E"), list("ABCDE"))
