"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keep_indices(values: Column, indices: Column) -> Column:
    """The elements whose index, from 0, is among ``indices``."""
    return F.filter(values, lambda _, i: F.array_contains(indices, i))


def zipped(*arrays: Column) -> Column:
    """Tuples up to the shortest array's length (``arrays_zip`` fills up with nulls)."""
    shortest = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.greatest(shortest, F.lit(0)))


def inverted(values: Column) -> Column:
    """Values to keys; of equal values the last key stays."""
    return F.map_from_entries(F.transform(F.array_distinct(F.map_values(values)), lambda v: F.struct(v.alias("k"), F.element_at(F.map_keys(F.map_filter(values, lambda _, x: x == v)), -1).alias("v"))))


def without_nulls(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull())


def inverted_ranges(ranges: Column, start: Column, stop: Column) -> Column:
    """The gaps in [start, stop) that ordered, disjoint (s, e) ranges leave."""
    first = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("out"), start.cast("int").alias("at"))

    def step(acc: Column, r: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("s"), F.least(r["s"], stop).cast("int").alias("e")))
        return F.struct(F.when(r["s"] > acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], r["e"]).cast("int").alias("at"))

    rest = lambda acc: F.when(acc["at"] < stop, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), stop.cast("int").alias("e"))))).otherwise(acc["out"])
    return F.aggregate(ranges, first, step, rest)


def number_range(low: Column, high: Column) -> Column:
    """All numbers from low to high, both given as digits; empty if either is not, or low is above high."""
    ok = low.rlike("^[0-9]+$") & high.rlike("^[0-9]+$") & (low.try_cast("long") <= high.try_cast("long"))
    return F.when(ok, F.sequence(low.try_cast("long"), high.try_cast("long"))).otherwise(F.array().cast("array<long>"))


def append_new(values: Column, value: Column) -> Column:
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def without(values: Column, others: Column) -> Column:
    """Elements of ``values`` that are not in ``others``, repeats kept."""
    return F.filter(values, lambda v: ~F.array_contains(others, v))


def longest_first(values: Column) -> Column:
    """By length, the longest first; equal ones in their order."""
    numbered = F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(numbered), lambda s: s["v"])


def json_or(text: Column, schema: str, default: Column) -> Column:
    return F.coalesce(F.from_json(text, schema), default)


def one_hot(value: Column, classes: list) -> Column:
    """Which of ``classes`` the value is, and at the end whether it is none of them."""
    hits = [F.coalesce(value == c, F.lit(False)).cast("int") for c in classes]
    return F.array(*hits, (~F.coalesce(value.isin(classes), F.lit(False))).cast("int"))


def positional_weights(weights: Column, labels: list[str], unknown: float | None = None) -> Column:
    """A map of weights as an array in the order of labels, and the unknown class's weight last."""
    got = [F.element_at(weights, F.lit(x)) for x in labels]
    return F.array(*got, *([F.lit(float(unknown))] if unknown is not None else []))


def argmax(values: Column) -> Column:
    """The index, from 0, of the first greatest element."""
    return F.array_position(values, F.array_max(values)) - 1


def blank_others(values: Column, k: int) -> Column:
    return F.transform(values, lambda v, i: F.when(i == k, v).otherwise(F.lit(0).cast("double")))
