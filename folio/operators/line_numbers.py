"""Line numbers of manuscripts: digits that stand first in their line, most of them at one x."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def candidates(tokens: DataFrame) -> DataFrame:
    """The token of least x of each line, if it is all digits. ``tokens`` has x as a number."""
    w = Window.partitionBy("doc_id", "page_idx", "line_idx").orderBy("x", "token_idx")
    return tokens.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & T.is_digit(F.col("text"))).drop("_n")


def line_numbers(tokens: DataFrame, x_threshold: float = 10, ratio: float = 0.7, more_than: int = 2) -> DataFrame:
    """Candidates that are line numbers: on a page with more than two, those within the threshold of the commonest
    rounded x (the first met, of equally common ones), if they are enough of the page's candidates."""
    found = candidates(tokens).withColumn("_x", F.bround("x", 0))
    order = F.struct("line_idx", "token_idx")
    counts = found.groupBy("doc_id", "page_idx", "_x").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    pages = counts.groupBy("doc_id", "page_idx").agg(F.sum("n").alias("all"), F.min_by("_x", F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("mode"))
    near = found.join(pages.where(F.col("all") > more_than), ["doc_id", "page_idx"]).where(F.abs(F.col("x") - F.col("mode")) < x_threshold)
    share = F.count("*").over(Window.partitionBy("doc_id", "page_idx")) / F.col("all")
    return near.withColumn("_share", share).where(F.col("_share") >= ratio).drop("_x", "_share", "all", "mode").withColumn("tag", F.lit("line_no"))
