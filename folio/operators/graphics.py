"""Graphics found on pages by keypoints, as joins and aggregations.

Images become rows of keypoints. Descriptors meet in bands of sixteen bits, so a graphic meets only the pages of its
document that share some; Hamming distances and the two nearest neighbours are columns. Each match that is left says
where the graphic's centre would be, at which size and direction; such votes are counted in coarse cells, and the
cell with most votes takes the place of random samples. A map is then fitted to its matches by covariances, and
fitted again to the matches that agree with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import keypoints as K
from folio.functions import raster as R
from folio.operators.joins import dealt, with_fallback
from folio.sources.shared import written

#: Bands of a descriptor: four of sixteen bits in each long.
BAND_BITS, BANDS_A_LONG = 16, 4
# Least matches, and pixels that a match may be off the map.
LEAST_MATCHES, OFF = 10, 5.0
#: Bits that descriptors of one place may differ in; how much nearer than the next place the nearest must be.
FAR_BITS, RATIO = 72, 0.8

KEYPOINTS = "x double, y double, size double, angle double, d array<bigint>, image_width int, image_height int"


def image_keypoints(images: DataFrame, keys: list[str], png: str = "png", strongest: int = K.STRONGEST) -> DataFrame:
    """``keys``, kp (a number within the image), KEYPOINTS: a row a keypoint. Images that are null have none."""
    kinds = {c: images.schema[c].dataType.simpleString() for c in keys}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                if (data := b.column(len(keys))[k].as_py()) is None:
                    continue
                image = R.grey(R.decode_png(data))
                x, y, size, angle, bits = K.keypoints(image, strongest)
                n = len(x)
                if n:
                    key = [pa.repeat(b.column(c)[k], n) for c in range(len(keys))]
                    d = pa.ListArray.from_arrays(pa.array(np.arange(0, K.LONGS * n + 1, K.LONGS, np.int32)), pa.array(bits.ravel()))
                    shape = [pa.repeat(pa.scalar(v, pa.int32()), n) for v in (image.shape[1], image.shape[0])]
                    columns = [*key, pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, (x, y, size, angle)), d, *shape]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "kp", "x", "y", "size", "angle", "d", "image_width", "image_height"])

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    return images.select(*keys, png).mapInArrow(rows, f"{schema}, kp int, {KEYPOINTS}")


def _banded(points: DataFrame, side: str, keys: list[str]) -> DataFrame:
    bits = lambda i, k: F.shiftright(F.col("d")[i], BAND_BITS * k).bitwiseAND((1 << BAND_BITS) - 1)
    bands = [F.struct(F.lit(i * BANDS_A_LONG + k).alias("band"), bits(i, k).alias("bits")) for i in range(K.LONGS) for k in range(BANDS_A_LONG)]
    own = [F.col(c).alias(c if c in keys else f"{side}_{c}") for c in points.columns]
    return points.select(*own, F.inline(F.array(*bands))).where("bits <> 0")


def hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(K.LONGS)), F.lit(0))


def keypoint_matches(graphics: DataFrame, pages: DataFrame, far: int = FAR_BITS, ratio: float = RATIO) -> DataFrame:
    """Keypoints of graphics (doc_id, graphic_id) with their nearest on each page (doc_id, page_idx) of the document.

    A match is kept if its distance is at most ``far`` bits and less than ``ratio`` of that to the nearest other place,
    ten pixels away or more; descriptors that share no band of sixteen bits don't meet, nor do flat places (bands of zeros). Equal distances: the first keypoint.
    """
    g, p = _banded(graphics, "g", ["doc_id", "graphic_id"]), _banded(pages, "p", ["doc_id", "page_idx"])
    met = g.join(p, ["doc_id", "band", "bits"]).withColumn("bits_off", hamming(F.col("g_d"), F.col("p_d"))).where(F.col("bits_off") <= 2 * far)
    one = ["doc_id", "graphic_id", "page_idx", "g_kp"]
    near = met.drop("band", "bits", "g_d", "p_d").dropDuplicates([*one, "p_kp"])
    w = Window.partitionBy(*one)
    nearest = F.first(F.struct("p_kp", "p_x", "p_y")).over(w.orderBy("bits_off", "p_kp"))
    near = near.withColumn("_first", nearest)
    beside = F.hypot(F.col("p_x") - F.col("_first.p_x"), F.col("p_y") - F.col("_first.p_y")) < 10
    near = near.withColumn("_next", F.min(F.when(~beside, F.col("bits_off"))).over(w))
    good = (F.col("p_kp") == F.col("_first.p_kp")) & (F.col("bits_off") <= far) & (F.col("bits_off") < ratio * F.coalesce("_next", F.lit(2 * far)))
    return near.where(good).drop("_first", "_next")


def _votes(matches: DataFrame) -> DataFrame:
    """Each match with the two nearest cells on every axis: log2 of the size, direction, and the centre in quarters of the graphic."""
    turn = F.col("p_angle") - F.col("g_angle")
    scale = F.col("p_size") / F.col("g_size")
    dx, dy = F.col("g_image_width") / 2 - F.col("g_x"), F.col("g_image_height") / 2 - F.col("g_y")
    cx = F.col("p_x") + scale * (F.cos(turn) * dx - F.sin(turn) * dy)
    cy = F.col("p_y") + scale * (F.sin(turn) * dx + F.cos(turn) * dy)
    two = lambda c: F.array(F.floor(c - 0.5).cast("int"), F.floor(c + 0.5).cast("int"))
    sectors = 12
    quarter = F.greatest("g_image_width", "g_image_height") / 4
    placed = matches.withColumns({"_s": F.log2(scale) * 1.5, "_t": turn * sectors / (2 * pi), "_x": cx / quarter, "_y": cy / quarter})
    for axis in ("_s", "_t"):
        placed = placed.withColumn(axis, F.explode(two(F.col(axis))))
    placed = placed.withColumn("_t", F.pmod("_t", F.lit(sectors)))
    size = F.pow(F.lit(2.0), F.col("_s") / 1.5)
    for axis in ("_x", "_y"):
        placed = placed.withColumn(axis, F.explode(two(F.col(axis) / size)))
    return placed


_ONE = ["doc_id", "graphic_id", "page_idx"]


def _fitted(matches: DataFrame) -> DataFrame:
    """The affine map of graphics to pages by least squares, from covariances: a0 to a5, and how many matches made it."""
    cov = lambda a, b: F.covar_pop(a, b)
    sums = matches.groupBy(*_ONE).agg(
        F.count("*").alias("n"), F.var_pop("g_x").alias("xx"), F.var_pop("g_y").alias("yy"), cov("g_x", "g_y").alias("xy"),
        *[cov(f"g_{a}", f"p_{b}").alias(f"{a}{b}p") for a in "xy" for b in "xy"], *[F.avg(f"{s}_{a}").alias(f"{s}{a}") for s in "gp" for a in "xy"],
        F.first("g_image_width").alias("w"), F.first("g_image_height").alias("h"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    sums = sums.where(det > 1e-6)
    line = lambda b: ((F.col(f"x{b}p") * F.col("yy") - F.col(f"y{b}p") * F.col("xy")) / det, (F.col(f"y{b}p") * F.col("xx") - F.col(f"x{b}p") * F.col("xy")) / det)
    (a0, a1), (a3, a4) = line("x"), line("y")
    maps = sums.withColumns({"a0": a0, "a1": a1, "a3": a3, "a4": a4})
    rest = lambda p, q, of: F.col(of) - F.col(p) * F.col("gx") - F.col(q) * F.col("gy")
    return maps.select(*_ONE, "n", "w", "h", "a0", "a1", rest("a0", "a1", "px").alias("a2"), "a3", "a4", rest("a3", "a4", "py").alias("a5"))


def placed_graphics(matches: DataFrame, least: int = LEAST_MATCHES, off: float = OFF, rounds: int = 3) -> DataFrame:
    """doc_id, graphic_id, page_idx, n, map (six numbers), x, y, width, height: where enough matches agree on one place.

    Of cells with equally many votes the first wins; a cell needs three for a map. After each fit the matches within
    ``off`` pixels of the map make the next one; fewer than ``least`` at the end are no match.
    """
    cells = ["_s", "_t", "_x", "_y"]
    votes = _votes(matches)
    counts = votes.groupBy(*_ONE, *cells).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*_ONE).agg(F.max_by(F.struct(*cells), F.struct("_n", *[-F.col(c) for c in cells])).alias("_best"), F.max("_n").alias("_n")).where("_n >= 3")
    chosen = votes.join(best.select(*_ONE, *[F.col(f"_best.{c}").alias(c) for c in cells]), [*_ONE, *cells], "left_semi")
    maps = _fitted(chosen)
    ends = lambda a, b, c: F.col(a) * F.col("g_x") + F.col(b) * F.col("g_y") + F.col(c)
    for _ in range(rounds):
        near = F.hypot(ends("a0", "a1", "a2") - F.col("p_x"), ends("a3", "a4", "a5") - F.col("p_y")) <= off * F.greatest(F.lit(1.0), "p_size")
        maps = _fitted(matches.join(maps.select(*_ONE, *[f"a{k}" for k in range(6)]), _ONE).where(near))
    at = lambda k, x, y: F.col(f"a{k}") * x + F.col(f"a{k + 1}") * y + F.col(f"a{k + 2}")
    corner = [(F.lit(0), F.lit(0)), (F.col("w"), F.lit(0)), (F.lit(0), F.col("h")), (F.col("w"), F.col("h"))]
    xs, ys = [at(0, *c) for c in corner], [at(3, *c) for c in corner]
    box = {"x": F.least(*xs), "y": F.least(*ys), "width": F.greatest(*xs) - F.least(*xs), "height": F.greatest(*ys) - F.least(*ys)}
    area = F.abs(F.col("a0") * F.col("a4") - F.col("a1") * F.col("a3"))
    good = (F.col("n") >= least) & (area > 0.0025) & (area < 400)
    return maps.where(good).select(*_ONE, "n", F.array(*[f"a{k}" for k in range(6)]).alias("map"), *[v.alias(k) for k, v in box.items()])


def scored(placed: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``score``: how alike each graphic and the part of the page that its map takes it to are (structural similarity)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = []
            for page, graphic, a in zip(*(b.column(c).to_pylist() for c in ("_page", "_graphic", "map")), strict=True):
                g = R.grey(R.decode_png(graphic))
                part = K.warped(R.grey(R.decode_png(page)), a, (g.shape[1], g.shape[0]))
                score.append(R.similarity(part, R.resize_bicubic(g, (64, 64))))
            out = b.drop_columns(["_page", "_graphic"])
            yield out.append_column("score", pa.array(score, pa.float64()))

    placed = dealt(placed)
    met = placed.join(graphics.select("doc_id", "graphic_id", F.col("png").alias("_graphic")), ["doc_id", "graphic_id"])
    met = met.join(pages.select("doc_id", "page_idx", F.col("png").alias("_page")), ["doc_id", "page_idx"])
    kind = placed.select(*placed.columns).withColumn("score", F.lit(0.0)).schema
    return met.select(*placed.columns, "_page", "_graphic").mapInArrow(rows, kind)


def best_pages(found: DataFrame) -> DataFrame:
    """Each graphic's best page: by score, then by matches, then the first."""
    rest = [c for c in found.columns if c not in ("doc_id", "graphic_id")]
    best = found.groupBy("doc_id", "graphic_id").agg(F.max_by(F.struct(*rest), F.struct("score", "n", -F.col("page_idx"))).alias("_b"))
    return best.select("doc_id", "graphic_id", *[F.col(f"_b.{c}").alias(c) for c in rest])


def graphics_by_keypoints(graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, graphic_id, page_idx, n, map, x, y, width, height, score: each graphic's best place, scaled, turned or partly covered.

    ``graphics``: doc_id, graphic_id, png. ``pages``: doc_id, page_idx, png. A graphic with too few matches has no row.
    """
    points = image_keypoints(graphics, ["doc_id", "graphic_id"]), image_keypoints(pages, ["doc_id", "page_idx"])
    found = written(keypoint_matches(*points), "matches")  # fits go through it several times
    return best_pages(scored(placed_graphics(found), graphics, pages))


def graphics_found(graphics: DataFrame, pages: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, graphic_id, page_idx, score, x, y, width, height: by keypoints; the others by template matches on all pages."""
    from folio.operators.raster import graphics_on_pages

    box = ["doc_id", "graphic_id", "page_idx", "score", "x", "y", "width", "height"]
    found = graphics_by_keypoints(graphics, pages).select(*box)
    left = graphics.join(found.where(F.col("score") >= least).select("doc_id", "graphic_id"), ["doc_id", "graphic_id"], "left_anti")
    key = F.struct("doc_id", "graphic_id").alias("_key")
    both = with_fallback(found.withColumn("_key", key), graphics_on_pages(left, pages, least).select(*box, key), "_key", "score", least)
    return both.drop("_key")
