"""Queries on images that are painted from the tables: where things are is known, so SQL says what is to be found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import raster as R
from folio.operators import blocks, graphics, inference, joins, raster
from folio.plans.catalog import query, table

CELL, ACROSS, DOWN, PAGE = 10, 10, 8, (340, 440)


def picture(text: str) -> np.ndarray:
    """Grey squares whose shades depend on every byte of a text and its place."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    k = np.arange(len(b))
    shades = np.bincount(k % (ACROSS * DOWN), weights=(b * 37 + k * 11) % 256, minlength=ACROSS * DOWN).astype(np.int64) % 256
    return np.kron(shades.reshape(DOWN, ACROSS).astype(np.uint8), np.ones((CELL, CELL), np.uint8))


def placed(item: int, image: np.ndarray) -> np.ndarray:
    """A page with a picture at a place, size and direction that its number gives; of some the lower edge is covered."""
    page = np.full(PAGE, 255, np.uint8)
    turned = np.rot90(image, item % 4 == 3)
    scale = (2 + item % 3) / 2
    small = R.resize_bicubic(turned, (round(turned.shape[1] * scale), round(turned.shape[0] * scale)))
    x, y = 20 + 10 * (item * 7 % 20), 20 + 10 * (item * 3 % 10)
    page[y : y + small.shape[0], x : x + small.shape[1]] = small
    if item % 5 == 2:
        page[y + small.shape[0] - 15 : y + small.shape[0]] = 255
    return page


def painted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphics (doc_id, graphic_id, png), one an item, and pages (doc_id, page_idx, png): two items make a document."""

    def paint(page: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                items, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                images = [picture(t or "") for t in texts]
                png = [R.encode_png(placed(i, g) if page else g) for i, g in zip(items, images, strict=True)]
                second = pa.array([1 - i % 2 for i in items], pa.int32()) if page else b.column(0)
                yield pa.RecordBatch.from_arrays([pa.array([i // 2 for i in items], pa.int64()), second, pa.array(png, pa.binary())], names=["doc_id", "page_idx" if page else "graphic_id", "png"])

        return rows

    picked = joins.dealt(items.select("item_id", "text"), "item_id")
    return picked.mapInArrow(paint(False), "doc_id long, graphic_id long, png binary"), picked.mapInArrow(paint(True), "doc_id long, page_idx int, png binary")


_PLACES = """SELECT item_id // 2 AS doc_id, item_id AS graphic_id, CAST(1 - item_id % 2 AS INT) AS page_idx, 20 + 10 * (item_id * 7 % 20) AS x, 20 + 10 * (item_id * 3 % 10) AS y,
CAST((CASE WHEN item_id % 4 = 3 THEN 80 ELSE 100 END) * (2 + item_id % 3) / 2 AS BIGINT) AS width, CAST((CASE WHEN item_id % 4 = 3 THEN 100 ELSE 80 END) * (2 + item_id % 3) / 2 AS BIGINT) AS height FROM benchmark"""


def tens(c: str):
    return (F.round(F.col(c) / 10) * 10).cast("long").alias(c)


@query("graphics_by_keypoints", _PLACES)
def graphics_by_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures found on the pages of their document, larger, turned and partly covered; places in tens."""
    found = graphics.graphics_by_keypoints(*painted(table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "graphic_id", "page_idx", *[tens(c) for c in ("x", "y", "width", "height")])


# Pages of suppliers: three blocks each, painted one over the other, and six boxes of tokens.
COLOURS = {"a": (255, 0, 0), "b": (0, 160, 0), "c": (0, 0, 255)}
SIZE, ON_PAGE = (64, 48), (128.0, 96.0)
_BLOCKS = """b AS (SELECT s_suppkey AS doc_id, k, 'abc'[(s_suppkey + k) % 3 + 1] AS tag, s_suppkey * (k + 3) % 40 AS x, s_suppkey * (k + 5) % 30 AS y, 10 + s_suppkey * (k + 1) % 20 AS w, 8 + (s_suppkey + k * 7) % 15 AS h FROM supplier, range(3) r(k)),
pixel AS (SELECT doc_id, py, px, max_by(tag, k) AS tag FROM (SELECT *, unnest(range(y, y + h + 1)) AS py FROM (SELECT *, unnest(range(x, x + w + 1)) AS px FROM b)) WHERE px < 64 AND py < 48 GROUP BY ALL)"""


def supplier_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("k")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    tag = F.element_at(F.array(*map(F.lit, "abc")), ((s + k) % 3 + 1).cast("int"))
    box = {"x": s * (k + 3) % 40, "y": s * (k + 5) % 30, "width": 10 + s * (k + 1) % 20, "height": 8 + (s + k * 7) % 15}
    return rows.select(s.cast("string").alias("doc_id"), F.lit(0).alias("page_idx"), k.alias("block_ord"), tag.alias("tag"), *[d(v).alias(n) for n, v in box.items()])


def supplier_pages(spark: SparkSession, sf_dir: str, colours: dict = COLOURS) -> tuple[DataFrame, DataFrame]:
    """Painted pages (doc_id, page_idx, png), and their sizes on paper."""
    key = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("page_idx"))
    sized = lambda w, h: key.withColumns({"width": F.lit(float(w)), "height": F.lit(float(h))})
    return blocks.block_images(supplier_blocks(spark, sf_dir), sized(*SIZE), colours), sized(*ON_PAGE)


def supplier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, j = F.col("s_suppkey"), F.col("token_idx")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "supplier").withColumn("token_idx", F.explode(F.sequence(F.lit(0), F.lit(5))))
    box = F.struct(d(s * (j + 2) % 100).alias("x"), d((s + j * 11) % 80).alias("y"), d(6 + s * j % 24).alias("width"), d(4 + (s * 3 + j) % 14).alias("height"))
    return rows.select(s.cast("string").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(0).alias("line_idx"), "token_idx", box.alias("bbox"))


_TOKENS = f"""WITH {_BLOCKS},
t AS (SELECT s_suppkey AS doc_id, j, s_suppkey * (j + 2) % 100 / 2.0 AS x, (s_suppkey + j * 11) % 80 / 2.0 AS y, (6 + s_suppkey * j % 24) / 2.0 AS w, (4 + (s_suppkey * 3 + j) % 14) / 2.0 AS h FROM supplier, range(6) r(j)),
e AS (SELECT doc_id, j, floor(x)::BIGINT AS x1, floor(y)::BIGINT AS y1, least(floor(x + w), 64)::BIGINT AS x2, least(floor(y + h), 48)::BIGINT AS y2 FROM t),
n AS (SELECT e.doc_id, j, tag, (x2 - x1) * (y2 - y1) AS total, count(*) AS n FROM e JOIN pixel p ON p.doc_id = e.doc_id AND px >= x1 AND px < x2 AND py >= y1 AND py < y2 GROUP BY ALL)
SELECT doc_id::VARCHAR AS doc_id, 0 AS page_idx, 0 AS line_idx, j::INT AS token_idx, tag AS cv_tag, n / total AS share FROM n WHERE n > 0.5 * total"""


@query("tokens_by_images", _TOKENS)
def tokens_by_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens tagged by what is painted under more than half of their box."""
    images, sizes = supplier_pages(spark, sf_dir)
    return raster.annotate_by_images(supplier_tokens(spark, sf_dir), images, sizes, COLOURS)


@query("tokens_by_predicted_images", _TOKENS)
def tokens_by_predicted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in paler colours go through a model, and tokens are tagged by the images that it makes."""
    pale = {t: tuple(128 + v // 2 for v in c) for t, c in COLOURS.items()}
    images, sizes = supplier_pages(spark, sf_dir, pale)
    classes = [*COLOURS.values(), (255, 255, 255)]
    near = np.array([*pale.values(), (255, 255, 255)], float)
    model = inference.save_arrays(spark, {"weights": 2 * near.T, "bias": -(near**2).sum(1)})
    predicted = inference.predicted_images(images, model, classes).where("error IS NULL")
    return raster.annotate_by_images(supplier_tokens(spark, sf_dir), predicted, sizes, COLOURS)


@query("predicted_pixels", f"""WITH {_BLOCKS}, n AS (SELECT doc_id, tag, count(*) AS n FROM pixel GROUP BY ALL),
a AS (SELECT doc_id, tag, n FROM n UNION ALL SELECT s_suppkey, 'white', 64 * 48 - coalesce(sum(n), 0)::BIGINT FROM supplier LEFT JOIN n ON doc_id = s_suppkey GROUP BY s_suppkey)
SELECT doc_id::VARCHAR AS image_id, tag, n::BIGINT AS n FROM a WHERE n > 0""")
def predicted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of colours, the likeliest one of each pixel, and its pixels counted, on painted pages."""
    classes = {**COLOURS, "white": (255, 255, 255)}
    images, _ = supplier_pages(spark, sf_dir)
    again = raster.mapped_images(images, lambda i: R.likeliest_colours(R.masks(i, list(classes.values())), list(classes.values())))
    moved = raster.recoloured(again, {COLOURS["a"]: (1, 2, 3)})
    counts = raster.colour_frequencies(moved.select(F.col("doc_id").alias("image_id"), "png"))
    named = {(1, 2, 3) if t == "a" else c: t for t, c in classes.items()}
    tag = F.coalesce(*[F.when((F.col("r") == c[0]) & (F.col("g") == c[1]) & (F.col("b") == c[2]), t) for c, t in named.items()])
    return counts.select("image_id", tag.alias("tag"), "n")


@query("framed_pages", """WITH b AS (SELECT s_suppkey AS doc_id, 10 + s_suppkey % 20 AS x, 6 + s_suppkey % 11 AS y, 12 + s_suppkey % 13 AS w, 10 + s_suppkey % 7 AS h FROM supplier)
SELECT doc_id::VARCHAR AS doc_id, ((w + 2) * (h + 2) - (w - 4) * (h - 4))::BIGINT AS framed FROM b""")
def framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A found box drawn on each page; pixels that changed."""
    s = F.col("s_suppkey")
    box = {"x": 10 + s % 20, "y": 6 + s % 11, "width": 12 + s % 13, "height": 10 + s % 7}
    found = table(spark, sf_dir, "supplier").select(s.cast("string").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(1).alias("category_id"), *[v.cast("double").alias(n) for n, v in box.items()])
    sizes = found.select("doc_id", "page_idx").withColumns({"width": F.lit(64.0), "height": F.lit(48.0)})
    white = blocks.block_images(supplier_blocks(spark, sf_dir), sizes, {})
    drawn = raster.annotated_pages(white, found)
    counts = raster.colour_frequencies(drawn.select(F.col("doc_id").alias("image_id"), "png"))
    r, g, b = raster.CATEGORY_COLOURS[1]
    return counts.where((F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b)).select(F.col("image_id").alias("doc_id"), F.col("n").alias("framed"))


@query("resized_pages", """SELECT s_suppkey::VARCHAR AS doc_id, w, h FROM supplier, (VALUES (100, 75), (40, 30), (32, 24)) v(w, h)""")
def resized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages scaled up to a longest side, scaled down to fit, and resized by nearest pixels."""
    images, _ = supplier_pages(spark, sf_dir)
    up = raster.scaled_images(images, 100)
    down = raster.mapped_images(images, lambda i: R.within(i, 40))
    near = raster.resized(images, (32, 24), nearest=True)
    size = F.conv(F.hex(F.substring("png", 17, 4)), 16, 10).cast("int"), F.conv(F.hex(F.substring("png", 21, 4)), 16, 10).cast("int")
    all_ = up.union(down).union(near)
    return all_.select("doc_id", size[0].alias("w"), size[1].alias("h"))


@query("match_debug_rows", """WITH v AS (SELECT s_suppkey::VARCHAR AS doc_id, 'vendor ' || regexp_replace(s_suppkey::VARCHAR, '(\\d)', 'a\\1', 'g') AS v FROM supplier)
SELECT doc_id, 1 AS id, 'name' AS tag, false AS match_multiple, '' AS tag_value_pre, v AS tag_value_current, 0 AS start_index, length(v)::INT AS next_start_index, true AS reached_end, v || ' other words' AS choice_combined, v AS choice_current, 'other words' AS choice_next, true AS accepted, false AS tag_to_choice_match, false AS sub_annotation FROM v
UNION ALL SELECT doc_id, 2, 'city', false, '', 'q w', 0, 0, NULL, 'other words', 'other words', NULL, false, true, false FROM v""".replace("\\\\", "\\"))
def match_debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comparison of two targets with the lines of a small document."""
    from folio.operators import alignment

    name = F.concat(F.lit("vendor "), F.regexp_replace(F.col("s_suppkey").cast("string"), r"(\d)", "a$1"))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), name.alias("name"))
    lines = docs.select("doc_id", F.posexplode(F.array("name", F.lit("other words"))).alias("line_idx", "line"))
    rows = lines.select("doc_id", F.lit(0).alias("page_idx"), "line_idx", F.posexplode(F.split("line", " ")).alias("token_idx", "text")).withColumn("tag", F.lit(None).cast("string"))
    off, none = F.lit(False), F.array().cast("array<struct<name: string, value: array<string>>>")
    one = lambda k, tag, value: F.struct(F.lit(k).alias("target_ord"), F.lit(tag).alias("name"), F.array(value).alias("value"))
    wanted = docs.select("doc_id", F.inline(F.array(one(0, "name", F.col("name")), one(1, "city", F.lit("q w")))))
    found = alignment.match_debug(rows, wanted.withColumns({"is_list": off, "match_multiple": off, "bonding": off, "require_next": off, "sub": none}))
    return found.drop(*[c for c in found.columns if c.startswith("fm_")])


_GRAPHICS = """g AS (SELECT s_nationkey AS doc_id, s_suppkey AS k, 'g' || s_suppkey || '.png' AS href, ['fig', 'table', 'formula'][(s_suppkey % 3 + 1)::INT] AS category, (s_suppkey % 4)::INT AS page, 3.0 * (s_suppkey % 30) - 2 AS x, 2.0 * (s_suppkey % 19) AS y, 20.0 + s_suppkey % 50 AS w, 10.0 + s_suppkey % 45 AS h FROM supplier),
c AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) AS id FROM g GROUP BY 1, 2)"""


def supplier_graphics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphics of documents (nations), their pages, and where all but every fifth were found."""
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("doc_id", F.col("s_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, ("fig", "table", "formula"))), (s % 3 + 1).cast("int"))
    listed = rows.select("doc_id", s.alias("graphic_id"), s.alias("ord"), F.concat(F.lit("g"), s.cast("string"), F.lit(".png")).alias("href"), kind.alias("category"), F.when(s % 2 == 0, F.concat(F.lit("id"), s.cast("string"))).alias("related_id"))
    pages = rows.select("doc_id").distinct().withColumn("page_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    pages = pages.select("doc_id", "page_idx", F.format_string("d/page_%05d.jpg", F.col("page_idx") + 1).alias("file_name"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"), F.lit(75.0).alias("pt_width"), F.lit(60.0).alias("pt_height"))
    box = {"x": 3.0 * (s % 30) - 2, "y": 2.0 * (s % 19), "width": 20.0 + s % 50, "height": 10.0 + s % 45}
    found = rows.where(s % 5 != 0).select("doc_id", s.alias("graphic_id"), (s % 4).cast("int").alias("page_idx"), F.lit(0.5).alias("score"), *[v.alias(n) for n, v in box.items()])
    return listed, pages, found


@query("annotation_documents", f"""WITH {_GRAPHICS}, b AS (SELECT *, greatest(x, 0) AS x1, y AS y1, least(x + w, 100) AS x2, least(y + h, 80) AS y2 FROM g)
SELECT doc_id, href AS file_name, c.id::INT AS category_id, CASE WHEN k % 5 <> 0 THEN page + 1 END AS image_id, CASE WHEN k % 5 <> 0 THEN [x1, y1, x2 - x1, y2 - y1]::DOUBLE[] END AS bbox,
CASE WHEN k % 5 <> 0 THEN [x1 * 0.75, y1 * 0.75, (x2 - x1) * 0.75, (y2 - y1) * 0.75]::DOUBLE[] END AS pt_bbox, CASE WHEN k % 2 = 0 THEN 'id' || k END AS related_element_id FROM b JOIN c USING (doc_id, category)""")
def annotation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of annotations, as JSON that is read back: what was found, and what wasn't."""
    out = raster.annotation_documents(*supplier_graphics(spark, sf_dir), created="2020-01-01T00:00:00")
    both = out.select("doc_id", F.from_json(F.to_json("data"), out.schema["data"].dataType).alias("d"))
    none = {"image_id": F.lit(None).cast("int"), "bbox": F.lit(None).cast("array<double>"), "pt_bbox": F.lit(None).cast("array<double>")}
    columns = ["doc_id", "file_name", "category_id", "image_id", "bbox", "pt_bbox", "related_element_id"]
    found = both.select("doc_id", F.inline("d.annotations")).select(columns)
    missing = both.select("doc_id", F.inline("d.missing_annotations")).withColumns(none).select(columns)
    return found.unionByName(missing)


@query("coordinates_in_xml", f"""WITH {_GRAPHICS}
SELECT doc_id, '<body>' || string_agg('<graphic href="' || href || CASE WHEN k % 5 <> 0 THEN '" coords="' || (page + 1) || ',' || x::DOUBLE || ',' || y::DOUBLE || ',' || w::DOUBLE || ',' || h::DOUBLE ELSE '' END || '" />', '' ORDER BY k) || '</body>' AS xml FROM g GROUP BY doc_id""")
def coordinates_in_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of found graphics as attributes of a document's XML."""
    from folio.operators import targets

    listed, _, found = supplier_graphics(spark, sf_dir)
    node = F.concat(F.lit('<graphic href="'), F.col("href"), F.lit('"/>'))
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("ord", node.alias("node")))), lambda r: r["node"])
    xmls = listed.groupBy("doc_id").agg(F.concat(F.lit("<body>"), F.array_join(nodes, ""), F.lit("</body>")).alias("xml"))
    places = found.join(listed.select("doc_id", "graphic_id", "href"), ["doc_id", "graphic_id"]).select("doc_id", "href", (F.col("page_idx") + 1).alias("page_no"), "x", "y", "width", "height")
    return targets.documents_with_coords(xmls, places)


@query("page_media_boxes", """SELECT s_suppkey::VARCHAR AS path, p::INT AS page_idx, CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE (s_suppkey % 7)::DOUBLE END AS x, 0.0::DOUBLE AS y, CASE WHEN p = 0 THEN 595.0::DOUBLE ELSE 100.0::DOUBLE + s_suppkey % 300 END AS width, CASE WHEN p = 0 THEN 842.5::DOUBLE ELSE 200.0::DOUBLE END AS height FROM supplier, range(2) r(p)""")
def page_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media boxes of the pages of small PDFs, the first page's from its parent."""
    from folio.sources import pdf

    s = F.col("s_suppkey")
    body = F.format_string(
        "%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 595 842.5] >>\nendobj\n"
        "3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n4 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [%d 0 %d 200] >>\nendobj\n",
        s % 7, s % 7 + 100 + s % 300,
    )
    files = table(spark, sf_dir, "supplier").select(s.cast("string").alias("path"), F.encode(body, "UTF-8").alias("content"))
    return pdf.page_boxes(files).where("error IS NULL").drop("error")


@query("likeness_of_plain_pages", """WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 256)::DOUBLE AS a, (s_suppkey * 7 % 256)::DOUBLE AS b FROM supplier)
SELECT k::VARCHAR AS doc_id, round((2 * a * b + 6.5025) / (a * a + b * b + 6.5025), 6) AS likeness, a::INT AS level FROM p""")
def likeness_of_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of two evenly grey pages, and the grey of a page with its channels swapped."""
    s = F.col("s_suppkey")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            likeness, level = [], []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                one, two = (R.grey(R.swap_channels(np.full((16, 16, 3), v, np.uint8))) for v in (x, y))
                likeness.append(round(R.similarity(one, two), 6))
                level.append(int(one[0, 0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(likeness), pa.array(level, pa.int32())], names=["doc_id", "likeness", "level"])

    picked = table(spark, sf_dir, "supplier").select(s.cast("string").alias("doc_id"), (s % 256).alias("a"), (s * 7 % 256).alias("b"))
    return picked.mapInArrow(rows, "doc_id string, likeness double, level int")
