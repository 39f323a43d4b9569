"""Connected components of a table of links, distributed: alternating large-star and small-star steps.

Every step sends each node's larger (or smaller) neighbours to the least neighbour. Links shrink to stars, whose
centres are the components' least members, in a number of rounds that grows with the logarithm of the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_table, write_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: a, b. One step: minima by node first (a partial aggregation), then a join on the node."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
    met = both.join(least, F.col("a") == F.col("n"))
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``links``: a, b (longs). Returns node, component (its least member) for every node that has a link.

    Each round's links are a written table, so lineage stays short; a round's count and checksum tell when nothing moves.
    """
    spark, schema = links.sparkSession, "a long, b long"
    path, before = write_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"), None
    for _ in range(most_rounds):
        now = spark.read.schema(schema).parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        next_ = write_table(_star(_star(now, True), False), "links")
        drop_table(spark, path)
        path = next_
    else:
        raise RuntimeError("components did not settle")
    stars = spark.read.schema(schema).parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
