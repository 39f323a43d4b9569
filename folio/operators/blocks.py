"""Blocks of tagged tokens on pages: merging neighbours, painting."""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import tags as T
from folio.functions.raster import encode_png, nearest_places
from folio.operators.joins import dealt

#: Boxes of one page and tag that are merged without a grid.
FEW_BOXES = 256
#: Boxes of one page and tag that are merged together with those of other pages.
AT_ONCE = 64
SCHEMA = "doc_id string, page_idx int, block_ord int, tag string, x double, y double, width double, height double"


def token_blocks(tokens: DataFrame) -> DataFrame:
    """Tagged tokens with a box, prefixes off, in document order: doc_id, page_idx, block_ord, tag, x, y, width, height."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page_idx").orderBy("line_idx", "token_idx")
    b = F.col("bbox")
    there = tokens.withColumn("_tag", T.tag_value("tag")).where((F.col("_tag") != "") & b.isNotNull())
    return there.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", (F.row_number().over(w) - 1).alias("block_ord"), F.col("_tag").alias("tag"), *[b[n].alias(n) for n in ("x", "y", "width", "height")])


def _merge(boxes: np.ndarray, tolerance: float) -> list[tuple[int, list[float]]]:
    """Boxes (x, y, width, height) of one tag in order, to (place of the leading box, merged box).

    The first box left takes in all that touch it, widened sideways by 1 + tolerance, and tries again; when nothing
    touches it, it is done. Edges are those of whole pixels, included. Many boxes are looked up in a grid.
    """
    left, out = list(range(len(boxes))), []
    edges = np.column_stack([boxes[:, 0], boxes[:, 1], boxes[:, 0] + boxes[:, 2] - 1, boxes[:, 1] + boxes[:, 3] - 1])
    if len(boxes) > FEW_BOXES:
        return _merge_in_grid(edges, 1 + tolerance)
    while left:
        lead = left.pop(0)
        x1, y1, x2, y2 = edges[lead]
        while left:
            e = edges[left]
            margin = 1 + tolerance
            hit = (e[:, 0] <= x2 + margin) & (e[:, 2] >= x1 - margin) & (e[:, 1] <= y2) & (e[:, 3] >= y1)
            if not hit.any():
                break
            x1, y1 = min(x1, e[hit, 0].min()), min(y1, e[hit, 1].min())
            x2, y2 = max(x2, e[hit, 2].max()), max(y2, e[hit, 3].max())
            left = [k for k, h in zip(left, hit, strict=True) if not h]
        out.append((lead, [x1, y1, x2 - x1 + 1, y2 - y1 + 1]))
    return out


def _merge_in_grid(edges: np.ndarray, margin: float) -> list[tuple[int, list[float]]]:
    """``_merge`` for a page of many boxes (x1, y1, x2, y2): a box meets those in the cells it grows into, not all.

    Growing is monotone, so the order in which boxes are taken in doesn't change where it ends.
    """
    low = edges[:, :2].min(0)
    side = np.maximum(1.0, 2 * np.median(np.maximum(edges[:, 2:] - edges[:, :2], 1), axis=0))
    first = np.floor((edges[:, :2] - low) / side).astype(np.int64)
    last = np.floor((np.maximum(edges[:, 2:], edges[:, :2]) - low) / side).astype(np.int64)
    across, down = (last - first + 1).T
    wide = across * down > 64  # boxes over many cells are looked at each time
    cells: dict[tuple[int, int], list[int]] = {}
    for k in np.flatnonzero(~wide):
        for cx in range(first[k, 0], last[k, 0] + 1):
            for cy in range(first[k, 1], last[k, 1] + 1):
                cells.setdefault((cx, cy), []).append(k)
    spread, free, out = np.flatnonzero(wide), np.ones(len(edges), bool), []
    end = last.max(0)
    for lead in range(len(edges)):
        if not free[lead]:
            continue
        free[lead] = False
        x1, y1, x2, y2 = edges[lead]
        done: tuple[int, int, int, int] | None = None  # cells whose boxes are all taken in
        while True:
            a1, b1 = (int(v) for v in np.maximum(0, np.floor((np.array([x1 - margin, min(y1, y2)]) - low) / side)))
            a2, b2 = (int(v) for v in np.minimum(end, np.floor((np.array([x2 + margin, max(y1, y2)]) - low) / side)))
            near = [k for cx in range(a1, a2 + 1) for cy in range(b1, b2 + 1) if not (done and done[0] + 1 < cx < done[2] and done[1] + 1 < cy < done[3]) for k in cells.get((cx, cy), ()) if free[k]]
            near = np.unique(np.concatenate([np.array(near, np.int64), spread[free[spread]]]))
            e = edges[near]
            hit = near[(e[:, 0] <= x2 + margin) & (e[:, 2] >= x1 - margin) & (e[:, 1] <= y2) & (e[:, 3] >= y1)]
            if not len(hit):
                break
            free[hit] = False
            done = (a1, b1, a2, b2)
            x1, y1 = min(x1, edges[hit, 0].min()), min(y1, edges[hit, 1].min())
            x2, y2 = max(x2, edges[hit, 2].max()), max(y2, edges[hit, 3].max())
        out.append((lead, [x1, y1, x2 - x1 + 1, y2 - y1 + 1]))
    return out


def _merge_rounds(edges: np.ndarray, group: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """``_merge`` of many short lists at once: each round is one step of all of them.

    ``edges`` are those of all lists, one list after another, ``group`` the number of each one's list, from 0. Returns the
    places of leading boxes in order, and the merged boxes as edges.
    """
    at, leads, merged = np.flatnonzero(np.diff(group, prepend=-1)), [], []
    lead, box = at.copy(), edges[at]
    left = np.setdiff1d(np.arange(len(edges)), at, assume_unique=True)
    going = np.ones(len(at), bool)
    while going.any():
        g = group[left]
        e, now = edges[left], box[g]
        hit = (e[:, 0] <= now[:, 2] + margin) & (e[:, 2] >= now[:, 0] - margin) & (e[:, 1] <= now[:, 3]) & (e[:, 3] >= now[:, 1])
        grown = np.zeros(len(going), bool)
        if hit.any():
            starts = np.flatnonzero(np.diff(g[hit], prepend=-1))
            into, e = g[hit][starts], e[hit]
            box[into, :2] = np.minimum(box[into, :2], np.minimum.reduceat(e[:, :2], starts))
            box[into, 2:] = np.maximum(box[into, 2:], np.maximum.reduceat(e[:, 2:], starts))
            grown[into] = True
            left, g = left[~hit], g[~hit]
        done = going & ~grown
        leads.append(lead[done])
        merged.append(box[done])
        going &= grown
        first = np.diff(g, prepend=-1) != 0
        first &= done[g]
        lead[g[first]], box[g[first]] = left[first], edges[left[first]]
        going[g[first]] = True
        left = left[~first]
    leads, merged = np.concatenate(leads), np.concatenate(merged)
    order = np.argsort(leads)
    return leads[order], merged[order]


def _merge_lists(boxes: np.ndarray, counts: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """``_merge`` of many lists, given one after another with their lengths: places of leading boxes, and merged boxes."""
    few = counts <= AT_ONCE
    short, starts = np.repeat(few, counts), np.cumsum(counts) - counts
    leads, out = [np.zeros(0, np.int64)], [np.zeros((0, 4))]
    if short.any():
        some = np.flatnonzero(short)
        x, y, w, h = boxes[some].T
        lengths = counts[few & (counts > 0)]
        places, edges = _merge_rounds(np.column_stack([x, y, x + w - 1, y + h - 1]), np.repeat(np.arange(len(lengths)), lengths), 1 + tolerance)
        leads.append(some[places])
        out.append(np.column_stack([edges[:, :2], edges[:, 2:] - edges[:, :2] + 1]))
    for k in np.flatnonzero(~few):
        for place, box in _merge(boxes[starts[k] : starts[k] + counts[k]], tolerance):
            leads.append(np.array([starts[k] + place]))
            out.append(np.array([box], float))
    places, found = np.concatenate(leads), np.concatenate(out)
    order = np.argsort(places)
    return places[order], found[order]


_BOXES = "array<struct<block_ord: int, x: double, y: double, width: double, height: double>>"
_SIDES = ("x", "y", "width", "height")


def _columns(lists: pa.Array, names: tuple[str, ...]) -> np.ndarray:
    flat = lists.flatten()
    return np.column_stack([pa.compute.struct_field(flat, n).to_numpy(zero_copy_only=False) for n in names])


def merged_blocks(blocks: DataFrame, tolerance: float = 0) -> DataFrame:
    """Neighbouring blocks of one tag as one; order is that of leading blocks.

    Tags don't interact, so a page's blocks of one tag come together, as an array, and are merged in Arrow batches, the
    short arrays of a batch at once. Blocks that lie by document already are not shuffled again.
    """

    @F.arrow_udf(_BOXES)
    def run(rows: pa.Array) -> pa.Array:
        counts = np.asarray(rows.value_lengths().fill_null(0))
        places, boxes = _merge_lists(_columns(rows, _SIDES), counts, tolerance)
        orders = pa.compute.struct_field(rows.flatten(), "block_ord").take(pa.array(places))
        ends = np.searchsorted(places, np.cumsum(counts))
        found = pa.StructArray.from_arrays([orders, *map(pa.array, np.ascontiguousarray(boxes.T))], names=["block_ord", *_SIDES])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), found)

    one = F.array_sort(F.collect_list(F.struct(F.col("block_ord").cast("int").alias("block_ord"), *[F.col(c).cast("double").alias(c) for c in _SIDES])))
    grouped = blocks.groupBy("doc_id", "page_idx", "tag").agg(one.alias("b"))
    merged = grouped.select("doc_id", "page_idx", "tag", F.inline(run("b")))
    return merged.select("doc_id", "page_idx", "block_ord", "tag", "x", "y", "width", "height")


def expanded_blocks(blocks: DataFrame, dx: float = 4, dy: float = 2) -> DataFrame:
    b = G.expanded(G.box(F.col("x"), F.col("y"), F.col("width"), F.col("height")), dx, dy)
    return blocks.withColumns({n: b[n] for n in ("x", "y", "width", "height")})


def paint(shape: tuple[int, int], boxes: list[tuple[float, float, float, float]], colours: list[tuple[int, int, int]], background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Boxes on a page in order; a rectangle's right and bottom edge are in it."""
    image = np.empty((*shape, 3), np.uint8)
    image[:] = background
    for (x, y, w, h), c in zip(boxes, colours, strict=True):
        image[max(0, int(y)) : max(0, int(y + h) + 1), max(0, int(x)) : max(0, int(x + w) + 1)] = c
    return image


@lru_cache(64)
def _kept(n: int, m: int) -> list[int]:
    return nearest_places(n, m).tolist()


@lru_cache(64)
def _page(height: int, width: int, size: tuple[int, int] | None, painted: tuple) -> bytes:
    """A page's image, ``painted`` on it in order (x, y, width, height, colour). Of a scaled page only those pixels are
    painted that are kept; a worker remembers its last pages, since many are alike, the blank ones above all.
    """
    if size is None:
        return encode_png(paint((height, width), [p[:4] for p in painted], [p[4] for p in painted]))
    rows, columns = _kept(height, size[1]), _kept(width, size[0])
    image = np.full((size[1], size[0], 3), 255, np.uint8)
    for x, y, w, h, colour in painted:
        image[bisect_left(rows, int(y)) : bisect_left(rows, int(y + h) + 1), bisect_left(columns, int(x)) : bisect_left(columns, int(x + w) + 1)] = colour
    return encode_png(image)


def block_images(blocks: DataFrame, pages: DataFrame, colours: dict[str, tuple[int, int, int]], size: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, page_idx, png: each page's blocks painted in order, tags without a colour left out, scaled to ``size`` (w, h)."""
    sized = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", F.col("width").alias("page_width"), F.col("height").alias("page_height"))

    @F.arrow_udf("binary")
    def run(width: pa.Array, height: pa.Array, rows: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(rows.value_lengths().fill_null(0))).tolist()
        flat = rows.flatten()
        boxes = [(*box, colours.get(tag)) for tag, *box in zip(*(pa.compute.struct_field(flat, n).to_pylist() for n in ("tag", *_SIDES)), strict=True)]
        out, at = [], 0
        for w, h, end in zip(width.to_pylist(), height.to_pylist(), ends, strict=True):
            out.append(_page(int(h), int(w), size, tuple(b for b in boxes[at:end] if b[4] is not None)))
            at = end
        return pa.array(out, pa.binary())

    one = F.array_sort(F.collect_list(F.struct("block_ord", "tag", *_SIDES)))
    met = dealt(sized, "doc_id").join(blocks.groupBy("doc_id", "page_idx").agg(one.alias("b")), ["doc_id", "page_idx"], "left")
    return met.select("doc_id", "page_idx", run("page_width", "page_height", "b").alias("png"))


def blocks_svg(blocks: list[tuple[str, float, float, float, float]], colours: dict[str, str], width: float, height: float) -> str:
    rects = "".join(f'<rect x="{x:g}" y="{y:g}" width="{w:g}" height="{h:g}" fill="{colours[t]}"/>' for t, x, y, w, h in blocks if t in colours)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">{rects}</svg>'
