"""Bounding boxes as struct columns (x, y, width, height), and ranges as (start, length). A box without area is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x: double, y: double, width: double, height: double>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def box_of_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(x1, y1, x2 - x1, y2 - y1)


def image_box(width: Column, height: Column) -> Column:
    return box(F.lit(0), F.lit(0), width, height)


def is_empty(b: Column) -> Column:
    return (b["width"] == 0) | (b["height"] == 0)


def validated(b: Column) -> Column:
    """The box; a negative size raises."""
    return F.when((b["width"] < 0) | (b["height"] < 0), F.raise_error(F.lit("a box has a negative size")).cast(BOX)).otherwise(b)


def rounded(b: Column, digits: int = 0) -> Column:
    """Half to even."""
    return box(*[F.bround(b[n], digits) for n in ("x", "y", "width", "height")])


def moved(b: Column, dx: Column | float, dy: Column | float) -> Column:
    return box(b["x"] + dx, b["y"] + dy, b["width"], b["height"])


def scaled(b: Column, rx: Column | float, ry: Column | float) -> Column:
    return box(b["x"] * rx, b["y"] * ry, b["width"] * rx, b["height"] * ry)


def expanded(b: Column, dx: Column | float, dy: Column | float) -> Column:
    return box(b["x"] - dx, b["y"] - dy, F.greatest(F.lit(0.0), b["width"] + 2 * dx), F.greatest(F.lit(0.0), b["height"] + 2 * dy))


def shrunk(b: Column, dx: float, dy: float) -> Column:
    return expanded(b, -dx, -dy)


with_margin = expanded


def union(a: Column, b: Column) -> Column:
    """The least box around both; an empty one counts for nothing."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    both = box_of_corners(x, y, F.greatest(a["x"] + a["width"], b["x"] + b["width"]), F.greatest(a["y"] + a["height"], b["y"] + b["height"]))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def intersects(a: Column, b: Column) -> Column:
    """Do they share an area? Touching edges don't."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def intersection(a: Column, b: Column) -> Column:
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    right, bottom = F.least(a["x"] + a["width"], b["x"] + b["width"]), F.least(a["y"] + a["height"], b["y"] + b["height"])
    return box(x, y, F.greatest(F.lit(0.0), right - x), F.greatest(F.lit(0.0), bottom - y))


def touches(a: Column, b: Column, margin: float = 0) -> Column:
    """Overlap of boxes of whole pixels, edges included, ``a`` widened to both sides."""
    return (a["x"] - margin <= b["x"] + b["width"] - 1) & (b["x"] <= a["x"] + a["width"] - 1 + margin) & (a["y"] <= b["y"] + b["height"] - 1) & (b["y"] <= a["y"] + a["height"] - 1)


def to_list(b: Column) -> Column:
    return F.array(*[b[n] for n in ("x", "y", "width", "height")])


def x_range(b: Column) -> Column:
    return F.struct(b["x"].alias("start"), b["width"].alias("length"))


def y_range(b: Column) -> Column:
    return F.struct(b["y"].alias("start"), b["height"].alias("length"))


def ranges_intersect(a: Column, b: Column) -> Column:
    return (a["start"] < b["start"] + b["length"]) & (b["start"] < a["start"] + a["length"])


def range_intersection(a: Column, b: Column) -> Column:
    start = F.greatest(a["start"], b["start"])
    stop = F.least(a["start"] + a["length"], b["start"] + b["length"])
    return F.struct(start.alias("start"), F.greatest(F.lit(0.0), stop - start).alias("length"))


def range_union(a: Column, b: Column) -> Column:
    start = F.least(a["start"], b["start"])
    stop = F.greatest(a["start"] + a["length"], b["start"] + b["length"])
    both = F.struct(start.alias("start"), (stop - start).alias("length"))
    return F.when(a["length"] == 0, b).when(b["length"] == 0, a).otherwise(both)


def box_text(b: Column) -> Column:
    return F.concat_ws(" ", *[b[n].cast("string") for n in ("x", "y", "width", "height")])


def parse_box(text: Column) -> Column:
    part = F.split(text, " ")
    return F.when(F.size(part) == 4, box(*[part[k] for k in range(4)]))


def lxml_box(attributes: Column) -> Column:
    """From x and y, 0 if missing, and width and height, which must be there."""
    at = lambda n: F.try_element_at(attributes, F.lit(n)).cast("double")
    return F.when(at("width").isNotNull() & at("height").isNotNull(), box(F.coalesce(at("x"), F.lit(0.0)), F.coalesce(at("y"), F.lit(0.0)), at("width"), at("height")))


def svg_box(attributes: Column, text: Column) -> Column:
    """The box in an attribute, else the view box, else a guess from the font size: 0.8 of it for each character."""
    at = lambda n: F.try_element_at(attributes, F.lit(n))
    size = at("font-size").cast("double")
    guess = F.when(size.isNotNull(), box(at("x").cast("double"), at("y").cast("double"), size * 0.8 * F.greatest(F.lit(1), F.length(text)), size))
    return F.coalesce(parse_box(at("bounding-box")), parse_box(at("viewBox")), guess)


def edge_moved(b: Column, edge: Column, delta: Column) -> Column:
    """One edge (0 left, 1 top, 2 right, 3 bottom) moved outwards by ``delta``, inwards if negative."""
    d = delta.cast("double")
    left, top = F.when(edge == 0, d).otherwise(0.0), F.when(edge == 1, d).otherwise(0.0)
    return box(b["x"] - left, b["y"] - top, b["width"] + F.when(edge.isin(0, 2), d).otherwise(0.0), b["height"] + F.when(edge.isin(1, 3), d).otherwise(0.0))


def points_of_pixels(b: Column, page: Column, rx: Column, ry: Column) -> Column:
    """A box of image pixels in page points: clipped to the page image, scaled, three digits."""
    return rounded(scaled(intersection(b, page), rx, ry), 3)


def union_of(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Aggregate: the box around a group's boxes, empty ones left out."""
    there = (width != 0) & (height != 0)
    keep = lambda c: F.when(there, c)
    return box_of_corners(F.min(keep(x)), F.min(keep(y)), F.max(keep(x + width)), F.max(keep(y + height)))
