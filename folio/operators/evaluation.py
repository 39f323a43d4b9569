"""Shares of tags on pages, and confusion metrics of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import tags as T



def tag_shares(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """doc_id, page_idx, tag, count, percentage: prefixes are taken off, no tag is a group of its own (null)."""
    counts = tokens.groupBy("doc_id", "page_idx", F.nullif(T.tag_value(tag), F.lit("")).alias("tag")).agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", F.col("count") / F.sum("count").over(Window.partitionBy("doc_id", "page_idx")))


def pages_with_tags(shares: DataFrame, least: float) -> DataFrame:
    """Pages of which at least ``least`` is tagged; a page without untagged tokens is one."""
    bare = F.coalesce(F.max(F.when(F.col("tag").isNull(), F.col("percentage"))), F.lit(0.0))
    return shares.groupBy("doc_id", "page_idx").agg(bare.alias("untagged")).where(F.col("untagged") <= 1 - least).select("doc_id", "page_idx")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; NaN for 0 / 0, as array libraries have it."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def f1_of_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return f1(precision(tp, fp), recall(tp, fn))


def confusion(pairs: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, n: the cells that occur."""
    return pairs.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy of each class, from confusion cells: three small aggregations."""
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    rows = cells.groupBy(F.col("label").alias("cls")).agg(hit.alias("tp"), F.sum("n").alias("actual")).withColumn("predicted", F.lit(0).cast("long"))
    cols = cells.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted")).select("cls", F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), "predicted")
    out = rows.unionByName(cols).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])
    total = F.sum("actual").over(Window.partitionBy(F.lit(1)))  # a row per class
    tp, fp, fn = F.col("tp"), F.col("predicted") - F.col("tp"), F.col("actual") - F.col("tp")
    out = out.select("cls", "tp", fp.alias("fp"), fn.alias("fn"), (total - tp - fp - fn).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1_of_counts(tp, fp, fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def summary(metrics: DataFrame) -> DataFrame:
    """Over classes: micro values from sums, the sum of f1 (``macro_f1_sum``) and its mean (``macro_f1``)."""
    s = {c: F.sum(c) for c in ("tp", "fp", "fn")}
    micro_p, micro_r = precision(s["tp"], s["fp"]), recall(s["tp"], s["fn"])
    return metrics.agg(*[v.alias(k) for k, v in s.items()], micro_p.alias("micro_precision"), micro_r.alias("micro_recall"), f1(micro_p, micro_r).alias("micro_f1"), F.sum("f1").alias("macro_f1_sum"), F.avg("f1").alias("macro_f1"), F.avg("accuracy").alias("accuracy"))


def accumulated(batches: DataFrame, batch_size: int) -> DataFrame:
    """Evaluations of batches (batch, cls, tp, fp, fn, tn, accuracy, micro_f1) as one: counts are summed, rates averaged."""
    per_class = batches.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    per_class = per_class.withColumn("f1", f1_of_counts(F.col("tp"), F.col("fp"), F.col("fn")))
    per_batch = batches.select("batch", "accuracy", "micro_f1").distinct().agg(F.avg("accuracy").alias("accuracy"), F.avg("micro_f1").alias("micro_f1"), (F.count("*") * batch_size).alias("count"))
    return per_class.agg(F.avg("f1").alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]).crossJoin(per_batch)  # one row each


def mean_loss(losses: DataFrame, loss: str = "loss") -> DataFrame:
    return losses.agg(F.avg(loss).alias("mean_loss"))


def l1_loss(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def cross_entropy(labels: Column, probabilities: Column, weights: Column | None = None, floor: float = 1e-12) -> Column:
    """Of one row's arrays: minus the sum of label * log(probability), each weighed if weights are given."""
    terms = F.zip_with(labels, probabilities, lambda y, p: -y * F.ln(F.greatest(p, F.lit(floor))))
    if weights is not None:
        terms = F.zip_with(terms, weights, lambda t, w: t * w)
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
