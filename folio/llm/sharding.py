"""Sharding by a K-d tree over document metadata.

The tree splits at weighted medians along the dimension whose extent, relative to the whole table's, is widest, until
leaves reach the target bytes. Strings count by the rank of their value among all values. Medians are found by
distributed histograms: each pass is one aggregation for all nodes of a level, narrows every node's range to one bin,
and ends when a bin holds one value. Ties along a dimension are ordered by text digest and then by row.

Equal texts are one row of the tree, with the metadata of the least id, so they come into one leaf. Only texts whose
copies have more than a sixteenth of a leaf's bytes are dealt row by row: no group, however large, can unbalance leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, drop_table, write_table, written

#: Histogram rows that one pass brings to the driver at most. A level with more nodes than these allow takes several passes.
HISTOGRAM_ROWS = 1 << 19
#: Copies of one text stay together unless they have more than a leaf's bytes divided by this.
SPLIT_ABOVE = 16
#: Bins of a node in a pass.
LEAST_BINS, MOST_BINS = 16, 4096


@dataclass
class Node:
    leaves: int
    first_leaf: int
    dim: int = 0
    #: The cut, so far: values on the dimension, the digest and the row that are settled.
    settled: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    #: Bytes that the left side still wants, from the current range on.
    want: float = 0.0
    open: bool = True
    #: Some row is in it.
    seen: bool = False


def with_rank(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the rank of ``column``'s value in the order of all its values, from 0, as ``name``; null is -1.

    Values are sorted by ranges, numbered within each and moved on by what stands before it, so no task holds them all.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = rows.select(F.col(column).alias("_value")).where("_value IS NOT NULL").distinct()
    ranged = written(values.repartitionByRange(n, "_value").withColumn("_part", F.spark_partition_id()), "kd-values")
    before = ranged.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # a row per range
    at = F.row_number().over(Window.partitionBy("_part").orderBy("_value")) - 1
    ranks = written(ranged.withColumn("_at", at).join(F.broadcast(before), F.col("_part") == F.col("_p")).select("_value", (F.col("_before") + F.col("_at")).cast("long").alias(name)), "kd-ranks")
    few = F.broadcast(ranks) if ranks.count() <= BROADCAST_ROWS else ranks
    return rows.join(few, F.col(column) == F.col("_value"), "left").drop("_value").fillna(-1, [name])


def digest60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def kd_tree_leaves(rows: DataFrame, dims: list[str], bytes_col: str, tie_col: str, leaves: int) -> DataFrame:
    """Add ``leaf`` (0 to leaves - 1) to ``rows``, whose ``dims``, ``tie_col`` and ``row`` are longs, ``row`` unique.

    ``rows`` must be a written table, since it is read several times a level. One table of the rows is written a level, and
    the one before goes. The tree, a few numbers a node, lives on the driver.
    """
    spark, schema, path = rows.sparkSession, None, None
    nodes = {0: Node(leaves, 0)}
    rows = rows.withColumn("_node", F.lit(0))
    whole: list[tuple[int, int]] | None = None
    while any(n.leaves > 1 for n in nodes.values()):
        extents = [f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
        for r in rows.groupBy("_node").agg(F.sum(bytes_col).alias("mass"), *extents).collect():  # a row per node
            n = nodes[r["_node"]]
            spans = [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(dims))]
            whole = whole or spans
            n.dim = max(range(len(dims)), key=lambda i: ((spans[i][1] - spans[i][0]) / max(1, whole[i][1] - whole[i][0]), -i))
            (n.low, n.high), n.want = spans[n.dim], r["mass"] * (n.leaves // 2) / n.leaves
            n.seen = True
        split = {k: n for k, n in nodes.items() if n.leaves > 1 and n.seen}
        while any(n.open for n in split.values()):
            live = [k for k, n in split.items() if n.open]
            for at in range(0, len(live), HISTOGRAM_ROWS // LEAST_BINS):
                _narrow(spark, rows, dims, bytes_col, tie_col, {k: split[k] for k in live[at : at + HISTOGRAM_ROWS // LEAST_BINS]})
        cuts = spark.createDataFrame(
            [(k, n.dim, *(n.settled + [2**62] * 3)[:3]) if n in split.values() else (k, -1, 0, 0, 0) for k, n in nodes.items()],
            "_n int, _dim int, _c0 long, _c1 long, _c2 long",
        )
        joined = rows.join(F.broadcast(cuts), F.col("_node") == F.col("_n"))  # a row per node
        value = _value(dims)
        left = (value < F.col("_c0")) | ((value == F.col("_c0")) & ((F.col(tie_col) < F.col("_c1")) | ((F.col(tie_col) == F.col("_c1")) & (F.col("row") <= F.col("_c2")))))
        stays = F.col("_dim") == -1
        child = F.col("_node") * 2 + F.when(stays | left, 1).otherwise(2)
        moved = joined.withColumn("_node", child).select(rows.columns)
        schema, before, path = moved.schema, path, write_table(moved, "kd-level")
        if before:
            drop_table(spark, before)
        rows = spark.read.schema(schema).parquet(path)
        below = {}
        for k, n in nodes.items():
            if n.leaves == 1:
                below[2 * k + 1] = Node(1, n.first_leaf)
            else:
                half = n.leaves // 2
                below[2 * k + 1] = Node(half, n.first_leaf)
                below[2 * k + 2] = Node(n.leaves - half, n.first_leaf + half)
        nodes = below
    leaf = spark.createDataFrame([(k, n.first_leaf) for k, n in nodes.items()], "_n int, leaf int")
    return rows.join(F.broadcast(leaf), F.col("_node") == F.col("_n")).drop("_n", "_node")


def _value(dims: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col("_dim") == i, F.col(d)) for i, d in enumerate(dims)], F.lit(0))


def _narrow(spark: SparkSession, rows: DataFrame, dims: list[str], bytes_col: str, tie_col: str, live: dict[int, Node]) -> None:
    """One histogram pass for nodes that have no cut yet."""
    bins = max(LEAST_BINS, min(MOST_BINS, HISTOGRAM_ROWS // len(live)))
    state = spark.createDataFrame(
        [(k, n.dim, len(n.settled), *(n.settled + [0, 0])[:2], n.low, n.high, (n.high - n.low) // bins + 1) for k, n in live.items()],
        "_n int, _dim int, _phase int, _s0 long, _s1 long, _low long, _high long, _step long",
    )
    at = rows.join(F.broadcast(state), F.col("_node") == F.col("_n"))  # a row per node
    value = _value(dims)
    key = F.when(F.col("_phase") == 0, value).when((F.col("_phase") == 1) & (value == F.col("_s0")), F.col(tie_col)).when((value == F.col("_s0")) & (F.col(tie_col) == F.col("_s1")) & (F.col("_phase") == 2), F.col("row"))
    at = at.select("_n", "_low", "_high", "_step", key.alias("_key"), F.col(bytes_col).alias("_bytes")).where("_key BETWEEN _low AND _high")
    found: dict[int, list] = {}
    for r in at.groupBy("_n", F.expr("(_key - _low) div _step").alias("bin")).agg(F.sum("_bytes").alias("mass"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect():  # HISTOGRAM_ROWS at most
        found.setdefault(r["_n"], []).append((r["bin"], r["mass"], r["lo"], r["hi"]))
    for k, n in live.items():
        hist = sorted(found[k])
        for _, mass, lo, hi in hist:
            if mass >= n.want or hi == hist[-1][3]:
                break
            n.want -= mass
        n.low, n.high = lo, hi
        if lo < hi:
            continue
        n.settled.append(lo)
        if len(n.settled) == 3:
            if n.want < mass / 2:
                n.settled[2] -= 1
            n.open = False
        else:
            n.low, n.high = (0, 2**60) if len(n.settled) == 1 else (0, 2**62)


def numbered(rows: DataFrame, by: str, order: list[str], salt: Column, in_chunk: int = 200_000) -> DataFrame:
    """Add ``slot``, gapless from 0 within each value of ``by``: rows are numbered in chunks, and chunks start where others end.

    Groups are cut into chunks of about ``in_chunk`` rows by a hash of ``salt``, so no window spans a group.
    """
    sizes = rows.groupBy(F.col(by).alias("_of")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(in_chunk))).alias("_chunks"))
    chunked = rows.join(sizes, F.col(by) == F.col("_of")).withColumn("_chunk", F.pmod(F.xxhash64(salt), F.col("_chunks"))).drop("_of", "_chunks")
    counts = chunked.groupBy(F.col(by).alias("_of"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy("_of").orderBy("_c")) - F.col("_n")).drop("_n")
    chunked = chunked.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_chunk").orderBy(*order)) - 1)
    out = chunked.join(starts, (F.col(by) == F.col("_of")) & (F.col("_chunk") == F.col("_c")))
    return out.withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_of", "_c", "_chunk", "_start", "_at")


def _units(rows: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """What the tree deals out: a row a text, with all copies' bytes and the metadata of the least id; and the rows of copies.

    Copies with more than ``most`` bytes in all are units one by one. Such texts are at most SPLIT_ABOVE a leaf, so their
    list has a known bound; it is broadcast if it is short. The others' groups are short, so none is a hot key.
    """
    key = ["tie", "text_crc32", "size"]
    rest = [c for c in rows.columns if c not in key]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), *rest)).alias("_first")
    groups = written(rows.groupBy(*key).agg(F.count("*").alias("copies"), first), "kd-texts")
    large = groups.where((F.col("copies") > 1) & (F.col("copies") * F.col("size") > most)).select(*[F.col(k).alias(f"_{k}") for k in key])
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    met = [F.col(k) == F.col(f"_{k}") for k in key]
    # A text that stands once is its group's only row already.
    alone = groups.join(large, met, "left_anti").select(*key, F.col("copies"), *[F.col(f"_first.{c}").alias(c) for c in rest])
    apart = rows.join(large, met, "left_semi").withColumn("copies", F.lit(1).cast("long"))
    units = alone.unionByName(apart).withColumn("one_size", F.col("size")).withColumn("size", F.col("size") * F.col("copies"))
    several = groups.where("copies > 1").select(*[F.col(k).alias(f"_{k}") for k in key])
    return units, rows.join(large, met, "left_anti").join(several, met, "left_semi")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Put every row of ``docs`` into a shard: doc_id, size, text_crc32, shard, slot.

    Either ``shards`` or ``target_bytes`` (leaves are split until they reach it) is given. A row weighs the UTF-8 bytes
    of its text (null: none) plus 1. Metadata that is null counts as less than any other. Rows that repeat are told
    apart by their place in the table, so any number of copies can be dealt evenly. An empty table gives an empty one.
    Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        digest60(F.col(text_col)).alias("tie"),
        F.coalesce(F.col(length_col).cast("long"), F.lit(-1)).alias("d0"),
        *[F.col(c).cast("string").alias(f"v{i + 1}") for i, c in enumerate(label_cols)],
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(picked, "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    units, whole = _units(rows, total / leaves / SPLIT_ABOVE)
    units = written(units, "kd-units")
    for i in range(len(label_cols)):
        units = with_rank(units, f"v{i + 1}", f"d{i + 1}")
    units = written(units.drop(*[f"v{i + 1}" for i in range(len(label_cols))]), "kd-ranked")
    if total:
        units = kd_tree_leaves(units, [f"d{i}" for i in range(len(label_cols) + 1)], "size", "tie", leaves)
    else:
        units = units.withColumn("leaf", F.lit(0))
    copies = units.where("copies > 1").select("tie", "text_crc32", "one_size", "leaf")
    same = [F.col(f"r.{a}") == F.col(f"u.{b}") for a, b in (("tie", "tie"), ("text_crc32", "text_crc32"), ("size", "one_size"))]
    shared = whole.alias("r").join(copies.alias("u"), same).select("r.doc_id", "r.size", "r.text_crc32", "u.leaf", "r.row")
    dealt = units.where("copies = 1").select("doc_id", F.col("one_size").alias("size"), "text_crc32", "leaf", "row").union(shared)
    out = numbered(dealt.withColumnRenamed("leaf", "shard"), "shard", ["row"], F.col("row"))
    return out.drop("row")
