"""Class weights from label frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequencies(pixels: DataFrame, colours: DataFrame, image: str = "image_id", unknown: str | None = None) -> DataFrame:
    """image, label, frequency: pixels per colour, 0 where an image has none. ``colours``: label, r, g, b.

    ``unknown`` names a class for pixels of no colour. Pixels meet colours after they are counted by colour.
    """
    counted = pixels.groupBy(image, "r", "g", "b").agg(F.count("*").alias("n"))
    named = counted.join(colours, ["r", "g", "b"], "left").groupBy(image, F.coalesce("label", F.lit(unknown)).alias("label")).agg(F.sum("n").alias("n"))
    names = [r[0] for r in colours.select("label").distinct().orderBy("label").collect()]  # a row per class
    every = F.array(*[F.lit(n) for n in dict.fromkeys([*names, *([unknown] if unknown is not None else [])])])
    grid = counted.select(image).distinct().select(image, F.explode(every).alias("label"))
    return grid.join(named, [image, "label"], "left").select(image, "label", F.coalesce("n", F.lit(0)).cast("double").alias("frequency"))


def summed(freq: DataFrame) -> DataFrame:
    return freq.groupBy("label").agg(F.sum("frequency").alias("frequency"))


def median_weights(freq: DataFrame) -> DataFrame:
    """label, weight: the median of an image's non-zero frequencies by their sum, brought to the sum 1; 0 if there are none.

    Equal frequencies are counted first, so that a label's many images meet as one row for each value they have.
    """
    counted = freq.where("frequency <> 0").groupBy("label", "frequency").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("label").orderBy("frequency")
    placed = counted.withColumns({"upto": F.sum("n").over(ordered), "of": F.sum("n").over(Window.partitionBy("label")), "mass": F.sum(F.col("n") * F.col("frequency")).over(Window.partitionBy("label"))})
    holds = lambda place: (F.col("upto") - F.col("n") < place) & (place <= F.col("upto"))
    low, high = F.floor((F.col("of") + 1) / 2), F.floor(F.col("of") / 2) + 1
    middle = placed.groupBy("label").agg(((F.max(F.when(holds(low), F.col("frequency"))) + F.max(F.when(holds(high), F.col("frequency")))) / 2).alias("median"), F.max("mass").alias("mass"))
    own = freq.select("label").distinct().join(middle, "label", "left").select("label", F.coalesce(F.try_divide(F.col("median"), F.col("mass")), F.lit(0.0)).alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(1)))  # a row per label
    return own.select("label", F.coalesce(F.try_divide(F.col("w"), total), F.lit(0.0)).alias("weight"))


def enet_weights(freq: DataFrame, shift: float = 1.02) -> DataFrame:
    """label, weight: 1 / ln(1.02 + share of all); 0 for a label that does not occur."""
    total = F.sum("frequency").over(Window.partitionBy(F.lit(1)))  # a row per label
    weight = F.when(F.col("frequency") > 0, 1 / F.ln(F.lit(shift) + F.try_divide(F.col("frequency"), total))).otherwise(0.0)
    return summed(freq).select("label", weight.alias("weight"))


def without_zero(weights: DataFrame) -> DataFrame:
    return weights.where(F.coalesce("weight", F.lit(0.0)) != 0)


def as_json(weights: DataFrame) -> DataFrame:
    """One row: the weights by label as JSON, labels sorted."""
    entries = F.array_sort(F.collect_list(F.struct("label", "weight")))
    return weights.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
