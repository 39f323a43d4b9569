"""Images in DataFrames: decoding, pixels, painting by predictions, and finding graphics on pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import raster as R


def pixels(images: DataFrame, id_col: str = "image_id", png_col: str = "png") -> DataFrame:
    """image_id, y, x, r, g, b: a row per pixel, an image at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, png in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                image = R.decode_png(png)
                y, x = (v.ravel().astype(np.int32) for v in np.mgrid[: image.shape[0], : image.shape[1]])
                flat = image.reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(y), b.column(0).type), pa.array(y), pa.array(x), *(pa.array(flat[:, k]) for k in range(3))], names=["image_id", "y", "x", "r", "g", "b"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(F.col(id_col).alias("image_id"), F.col(png_col)).mapInArrow(rows, f"image_id {kind}, y int, x int, r int, g int, b int")


def mapped_images(images: DataFrame, how, columns: tuple[str, ...] = ("png",)) -> DataFrame:
    """Images put through a function of arrays, PNG to PNG; other columns stay."""

    @F.udf("binary", useArrow=True)
    def run(png):
        return None if png is None else R.encode_png(how(R.decode_png(png)))

    return images.withColumns({c: run(c) for c in columns})


def resized(images: DataFrame, size: tuple[int, int], nearest: bool = False) -> DataFrame:
    return mapped_images(images, lambda i: (R.resize_nearest if nearest else R.resize_bicubic)(i, size))


def recoloured(images: DataFrame, colours: dict) -> DataFrame:
    return mapped_images(images, lambda i: R.mapped(i, colours))


def colour_frequencies(images: DataFrame) -> DataFrame:
    """image_id, r, g, b, n: counted where the image is decoded, so pixels are never rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"image_id": i, "r": c[0], "g": c[1], "b": c[2], "n": n} for i, png in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c, n in R.colour_counts(R.decode_png(png)).items()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("image_id", b.column(0).type), ("r", pa.int32()), ("g", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))

    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "png").mapInArrow(rows, f"image_id {kind}, r int, g int, b int, n long")


def annotate_by_images(tokens: DataFrame, images: DataFrame, pages: DataFrame, colours: dict[str, tuple[int, int, int]], threshold: float = 0.5, target: str = "cv_tag") -> DataFrame:
    """Tokens tagged by the colour that has more than half of their box on the page's predicted image.

    A page's image and its tokens are one group; boxes are scaled to the image and cut to it. Pixels are counted once a
    colour, a token's share is four lookups. Of equal shares the first colour wins.
    """
    keys = ["doc_id", "page_idx"]
    out_type, tags = "doc_id string, page_idx int, line_idx int, token_idx int, tag string, share double", list(colours)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            image, page = R.decode_png(bytes(right.png.iloc[0])), right.iloc[0]
            rx = image.shape[1] / page.page_width if page.page_width else 0
            ry = image.shape[0] / page.page_height if page.page_height else 0
            if colours:
                shares = R.ColourSums(image, colours).shares(left.x * rx, left.y * ry, left.width * rx, left.height * ry)
                top = shares.argmax(0)
                for k in np.flatnonzero(shares.max(0) > threshold):
                    t = left.iloc[k]
                    rows.append((t.doc_id, t.page_idx, t.line_idx, t.token_idx, tags[top[k]], float(shares[top[k], k])))
        return pd.DataFrame(rows, columns=["doc_id", "page_idx", "line_idx", "token_idx", "tag", "share"])

    b = F.col("bbox")
    a = tokens.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", "line_idx", "token_idx", *[b[n].alias(n) for n in ("x", "y", "width", "height")])
    i = images.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", "png").join(pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page_idx", F.col("width").alias("page_width"), F.col("height").alias("page_height")), keys)
    found = a.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(run, out_type)
    return found.withColumnRenamed("tag", target)


def scaled_images(images: DataFrame, longest: int) -> DataFrame:
    """Images whose longest side is ``longest``."""
    return mapped_images(images, lambda i: R.scaled_to(i, longest))


#: Nine colours that are easy to tell apart, by number of category.
CATEGORY_COLOURS = [(228, 26, 28), (55, 126, 184), (77, 175, 74), (152, 78, 163), (255, 127, 0), (255, 255, 51), (166, 86, 40), (247, 129, 191), (153, 153, 153)]


def annotated_pages(pages: DataFrame, found: DataFrame, thick: int = 3) -> DataFrame:
    """doc_id, page_idx, png: pages with the boxes that were found on them drawn in, in order, in the colour of their category.

    ``found``: doc_id, page_idx, category_id, x, y, width, height. Edges are rounded to whole pixels, halves to even.
    Pages without a box stay as they are.
    """
    box = F.struct("category_id", *[F.bround(c, 0).alias(c) for c in ("x", "y", "width", "height")])
    on = found.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for png, boxes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if png is not None and boxes:
                    image = R.decode_png(png).copy()
                    for r in boxes:
                        R.framed(image, (r["x"], r["y"], r["width"], r["height"]), CATEGORY_COLOURS[min(r["category_id"], len(CATEGORY_COLOURS) - 1)], thick)
                    png = R.encode_png(image)
                out.append(png)
            yield b.drop_columns(["png", "boxes"]).append_column("png", pa.array(out, pa.binary()))

    met = pages.select("doc_id", "page_idx", "png").join(on, ["doc_id", "page_idx"], "left")
    return met.mapInArrow(rows, pages.select("doc_id", "page_idx", "png").schema)


def graphics_on_pages(graphics: DataFrame, pages: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, graphic_id, page_idx, score, x, y, width, height: where each graphic of a document is on its pages.

    Graphics meet the pages of their own document; every pair is scored by template matches at several scales, and the
    best page of a graphic is kept (the first of equal ones) if its score is enough.
    """
    kind = "score double, x double, y double, width double, height double"

    @F.udf(f"struct<{kind.replace(' double', ': double')}>", useArrow=True)
    def score(page, graphic):
        m = R.scaled_template_match(R.decode_png(page), R.decode_png(graphic))
        return m["score"], m["x"], m["y"], m["width"], m["height"]

    met = graphics.select("doc_id", "graphic_id", F.col("png").alias("_graphic")).join(pages.select("doc_id", "page_idx", F.col("png").alias("_page")), "doc_id")
    scored = met.select("doc_id", "graphic_id", "page_idx", score("_page", "_graphic").alias("m"))
    best = scored.groupBy("doc_id", "graphic_id").agg(F.max_by(F.struct("page_idx", "m"), F.struct("m.score", -F.col("page_idx"))).alias("b"))
    return best.where(F.col("b.m.score") >= least).select("doc_id", "graphic_id", "b.page_idx", *[F.col(f"b.m.{n}").alias(n) for n in ("score", "x", "y", "width", "height")])


def annotation_documents(graphics: DataFrame, pages: DataFrame, found: DataFrame, created: str, version: str = "0.0.2") -> DataFrame:
    """doc_id, data: what was found in a document and what wasn't, as a struct that ``to_json`` writes (nulls left out).

    ``graphics``: doc_id, graphic_id, ord, href, category, related_id. ``pages``: doc_id, page_idx, file_name, width, height
    (pixels), pt_width, pt_height. ``found``: doc_id, graphic_id, page_idx, score, x, y, width, height. Pages and categories
    are numbered from 1, categories in the order in which the document's graphics first have them. Boxes are cut to the
    page, in whole pixels and in points to three digits. A document without graphics or without pages has empty lists.
    """
    sizes = pages.select("doc_id", "page_idx", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "pt_width", "pt_height")])
    met = graphics.join(found.withColumn("_found", F.lit(True)), ["doc_id", "graphic_id"], "left").join(sizes, ["doc_id", "page_idx"], "left")
    page = G.image_box(F.col("_width"), F.col("_height"))
    box = G.box(*[F.col(c) for c in ("x", "y", "width", "height")])
    whole = G.to_list(G.rounded(G.intersection(box, page), 0))
    points = G.to_list(G.points_of_pixels(box, page, F.col("_pt_width") / F.col("_width"), F.col("_pt_height") / F.col("_height")))
    row = F.struct("ord", "graphic_id", "href", "category", "related_id", (F.col("page_idx") + 1).alias("image_id"), whole.alias("bbox"), points.alias("pt_bbox"), "score", F.coalesce("_found", F.lit(False)).alias("found"))
    rows = met.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("g"))
    image = F.struct((F.col("page_idx") + 1).alias("id"), "file_name", "width", "height", F.array(F.lit(0.0), F.lit(0.0), F.col("pt_width").cast("double"), F.col("pt_height").cast("double")).alias("pt_bbox"))
    both = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(image)).alias("images")).join(rows, "doc_id", "full")
    listed = F.coalesce("g", F.array().cast(rows.schema["g"].dataType))
    names = F.array_distinct(F.transform(listed, lambda r: r["category"]))
    known = lambda r: [r["href"].alias("file_name"), F.array_position(names, r["category"]).cast("int").alias("category_id"), r["related_id"].alias("related_element_id")]
    annotations = F.transform(F.filter(listed, lambda r: r["found"]), lambda r: F.struct(*known(r), r["image_id"].alias("image_id"), r["bbox"].alias("bbox"), r["pt_bbox"].alias("pt_bbox"), r["score"].alias("_score")))
    missing = F.transform(F.filter(listed, lambda r: ~r["found"]), lambda r: F.struct(*known(r)))
    categories = F.transform(names, lambda c, i: F.struct((i + 1).alias("id"), c.alias("name")))
    info = F.struct(F.lit(version).alias("version"), F.lit(created).alias("date_created"))
    images = F.coalesce("images", F.array().cast(both.schema["images"].dataType))
    data = F.struct(info.alias("info"), images.alias("images"), annotations.alias("annotations"), categories.alias("categories"), F.when(F.size(missing) > 0, missing).alias("missing_annotations"))
    return both.select("doc_id", data.alias("data"))


def coco_documents(found: DataFrame) -> DataFrame:
    """doc_id, json: images, annotations and categories of a document, categories numbered from 1 by place of first use."""
    ordered = F.array_sort(F.collect_list(F.struct("page_idx", "graphic_id", "category", "x", "y", "width", "height")))
    rows = found.groupBy("doc_id").agg(ordered.alias("a"))
    names = F.array_distinct(F.transform("a", lambda r: r["category"]))
    annotations = F.transform("a", lambda r: F.struct(r["page_idx"].alias("image_id"), F.array_position(names, r["category"]).cast("int").alias("category_id"), F.array(*[F.bround(r[n], 0) for n in ("x", "y", "width", "height")]).alias("bbox")))
    categories = F.transform(names, lambda c, i: F.struct((i + 1).alias("id"), c.alias("name")))
    images = F.transform(F.array_distinct(F.transform("a", lambda r: r["page_idx"])), lambda p: F.struct(p.alias("id"), F.format_string("/page_%05d.jpg", p + 1).alias("file_name")))
    return rows.select("doc_id", F.to_json(F.struct(images.alias("images"), annotations.alias("annotations"), categories.alias("categories"))).alias("json"))
