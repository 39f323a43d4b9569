"""Queries on joins, aggregates, geometry and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import nested as N
from folio.functions import text as X
from folio.operators import evaluation, joins, weights
from folio.plans.catalog import query, table

#: Boxes that queries make of line items: x, y, width and height from its numbers.
BOX_SQL = "l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 20 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber * 3 AS DOUBLE) AS h FROM lineitem"
KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.box(F.col("l_partkey") % 50, F.col("l_suppkey") % 20, F.col("l_quantity"), F.col("l_linenumber") * 3)
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag", b.alias("bbox"))


def parts(b, *names: str):
    return [b[n].alias(a) for n, a in zip(("x", "y", "width", "height"), names or "xywh", strict=True)]


@query("tag_shares", "SELECT l_orderkey AS doc_id, 0 AS page_idx, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS tag, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS percentage FROM lineitem GROUP BY 1, 2, 3")
def tag_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of pages with their shares; no tag is a group."""
    tag = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("b-"), F.col("l_returnflag")))
    return evaluation.tag_shares(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), tag.alias("tag")))


@query("pages_tagged_enough", "SELECT l_orderkey AS doc_id, 0 AS page_idx FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) / count(*) <= 1 - 0.6")
def pages_tagged_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04."""
    return evaluation.pages_with_tags(tag_shares(spark, sf_dir), 0.6)


@query("confusion_cells", "SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_METRICS = """WITH c AS (SELECT l_linenumber % 4 AS label, l_partkey % 4 AS prediction FROM lineitem), k AS (SELECT unnest([0, 1, 2, 3]) AS cls),
m AS (SELECT cls, count(*) FILTER (label = cls AND prediction = cls) AS tp, count(*) FILTER (label <> cls AND prediction = cls) AS fp, count(*) FILTER (label = cls AND prediction <> cls) AS fn, count(*) FILTER (label <> cls AND prediction <> cls) AS tn FROM k, c GROUP BY cls)"""


@query("class_metrics", f"{_METRICS} SELECT cls, tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A12."""
    cells = evaluation.confusion(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("a"), (F.col("l_partkey") % 4).alias("b")), "a", "b")
    out = evaluation.class_metrics(cells)
    return out.select("cls", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("metric_summary", f"{_METRICS}, f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM m) SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 9) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS micro_recall, round(sum(f1), 9) AS macro_f1_sum, round(avg(f1), 9) AS macro_f1, round(avg(accuracy), 9) AS accuracy FROM f")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A11, Q25."""
    cells = evaluation.confusion(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).cast("long").alias("a"), (F.col("l_partkey") % 4).alias("b")), "a", "b")
    s = evaluation.summary(evaluation.class_metrics(cells))
    return s.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("micro_precision", "micro_recall", "macro_f1_sum", "macro_f1", "accuracy")])


@query("mean_loss", "SELECT round(avg(l_tax), 9) AS mean_loss, round(avg(abs(l_tax - l_discount)), 9) AS l1 FROM lineitem")
def mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, D06."""
    return table(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_tax"), 9).alias("mean_loss"), F.round(evaluation.l1_loss(F.col("l_tax"), F.col("l_discount")), 9).alias("l1"))


@query("cross_entropy", "SELECT l_orderkey, l_linenumber, l_partkey, round(-ln(greatest(l_discount + 0.01, 1e-12)) * l_tax * 2 - ln(1 - l_discount) * (1 - l_tax), 9) AS loss FROM lineitem")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cross entropy of arrays."""
    y, p = F.array(F.col("l_tax"), 1 - F.col("l_tax")), F.array(F.col("l_discount") + 0.01, 1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.round(evaluation.cross_entropy(y, p, F.array(F.lit(2.0), F.lit(1.0))), 9).alias("loss"))


_FREQ = "WITH f AS (SELECT user_id AS image, event_type AS label, CAST(count(*) AS DOUBLE) AS frequency FROM events GROUP BY 1, 2), g AS (SELECT i.image, l.label, coalesce(f.frequency, 0) AS frequency FROM (SELECT DISTINCT image FROM f) i CROSS JOIN (SELECT DISTINCT label FROM f) l LEFT JOIN f ON f.image = i.image AND f.label = l.label)"


def event_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image"), F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("frequency"))
    return counts


@query("median_class_weights", f"{_FREQ}, w AS (SELECT label, median(frequency) FILTER (frequency <> 0) / sum(frequency) AS w FROM g GROUP BY label) SELECT label, round(w / sum(w) OVER (), 9) AS weight FROM w")
def median_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06, A07."""
    return weights.median_weights(event_frequencies(spark, sf_dir)).select("label", F.round("weight", 9).alias("weight"))


@query("enet_class_weights", f"{_FREQ} SELECT label, round(1 / ln(1.02 + sum(frequency) / sum(sum(frequency)) OVER ()), 9) AS weight FROM g GROUP BY label")
def enet_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05, A08, F14."""
    return weights.without_zero(weights.enet_weights(event_frequencies(spark, sf_dir))).select("label", F.round("weight", 9).alias("weight"))


@query("colour_frequencies", "WITH p AS (SELECT l_orderkey AS image, l_linenumber % 3 AS c FROM lineitem), l AS (SELECT * FROM (VALUES ('red', 0), ('blue', 1), ('unknown', 2)) t(label, c)) SELECT i.image AS image_id, l.label, CAST(count(p.c) AS DOUBLE) AS frequency FROM (SELECT DISTINCT image FROM p) i CROSS JOIN l LEFT JOIN p ON p.image = i.image AND p.c = l.c GROUP BY 1, 2")
def colour_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels by colour, those of no colour as unknown."""
    c = F.col("l_linenumber") % 3
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.when(c == 0, 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.when(c == 1, 255).when(c == 2, 7).otherwise(0).alias("b"))
    colours = spark.createDataFrame([("red", 255, 0, 0), ("blue", 0, 0, 255)], "label string, r int, g int, b int")
    return weights.frequencies(pixels, colours, unknown="unknown")


@query("nearest_centroid", "WITH c AS (SELECT label AS idx, [i / 10.0 FOR i IN range(64)] AS d, label FROM (SELECT DISTINCT label FROM embeddings)), u AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT c.idx, k.k, (c.idx - 2) * 0.05 * (k.k % 3) AS m FROM c, (SELECT unnest(range(1, 65)) AS k) k), q AS (SELECT u.vec_id, m.idx, sum((u.v - m.m) * (u.v - m.m)) AS d FROM u JOIN m ON u.k = m.k GROUP BY 1, 2) SELECT vec_id, arg_min(idx, (round(d, 9), idx)) AS nearest FROM q GROUP BY vec_id")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids from a rule, one broadcast row."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("idx")).distinct()
    centroid = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.col("idx") - 2) * F.lit(0.05) * (k % 3))
    return joins.nearest_centroid(table(spark, sf_dir, "embeddings"), labels.select("idx", centroid.alias("centroid"))).select("vec_id", "nearest")


@query("pairs_of_files", "SELECT 'd' || o_orderkey || '/a.pdf' AS source_url, 'd' || o_orderkey || '/b.xml' AS xml_url FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 500")
def pairs_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one directory, the first 500 by path."""
    o = table(spark, sf_dir, "orders")
    at = F.concat(F.lit("d"), F.col("o_orderkey").cast("string"))
    return joins.file_pairs(o.select(F.concat(at, F.lit("/a.pdf")).alias("path")), o.where("o_orderstatus = 'F'").select(F.concat(at, F.lit("/b.xml")).alias("path")), limit=500)


@query("items_left_to_do", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def items_left_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without an output."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("out/"), F.col("l_orderkey").cast("string")).alias("path")).distinct()
    items = table(spark, sf_dir, "orders").select("o_orderkey")
    return joins.without_output(items, done, F.concat(F.lit("out/"), F.col("o_orderkey").cast("string")))


@query("zipped_lists", "WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS r FROM nation), b AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) SELECT r - 1 AS row, n_name, n_nationkey FROM a JOIN b USING (r)")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two file lists side by side."""
    n = table(spark, sf_dir, "nation")
    return joins.zip_lists(n.select("n_name"), n.select("n_nationkey"), ["n_name"], ["n_nationkey"]).select(F.col("row").cast("long").alias("row"), "n_name", "n_nationkey")


@query("category_ids", "SELECT event_type AS category, CAST(row_number() OVER (ORDER BY min(event_id)) AS INT) AS id FROM events GROUP BY event_type")
def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return joins.numbered_categories(table(spark, sf_dir, "events").withColumnRenamed("event_type", "category"), "category", "event_id")


@query("overlapping_boxes", f"WITH b AS (SELECT {BOX_SQL}), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, x, y, w, h) AS o FROM b) SELECT a.l_orderkey AS doc_id, a.o AS left_ord, b.o AS right_ord FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND a.o < b.o AND a.x - 1 <= b.x + b.w - 1 AND b.x <= a.x + a.w AND a.y <= b.y + b.h - 1 AND b.y <= a.y + a.h - 1")
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10."""
    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "bbox.x", "bbox.y", "bbox.width", "bbox.height"))
    rows = boxes(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit("t").alias("tag"), o.cast("long").alias("block_ord"), "bbox")
    return joins.overlapping(rows).select("doc_id", "left_ord", "right_ord")


@query("box_union_per_order", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY l_orderkey")
def box_union_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, G07."""
    b = F.col("bbox")
    out = boxes(spark, sf_dir).groupBy("l_orderkey").agg(G.union_of(b["x"], b["y"], b["width"], b["height"]).alias("b"))
    return out.select("l_orderkey", *parts(F.col("b")))


@query("box_arithmetic", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, x + 1.5 AS mx, x * 2 AS sx, w * 2 AS sw, x - 4 AS ex, w + 8 AS ew, h + 4 AS eh, greatest(0, w - 20) AS kw, round_even(x / 4, 1) AS rx, w = 0 OR h = 0 AS empty FROM b")
def box_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G02 to G06, G08, G13."""
    b = F.col("bbox")
    e, s, k = G.expanded(b, 4, 2), G.scaled(b, 2, 2), G.shrunk(b, 10, 10)
    return boxes(spark, sf_dir).select(*KEYS, G.moved(b, 1.5, 0)["x"].alias("mx"), s["x"].alias("sx"), s["width"].alias("sw"), e["x"].alias("ex"), e["width"].alias("ew"), e["height"].alias("eh"), k["width"].alias("kw"), G.rounded(G.scaled(b, 0.25, 1), 1)["x"].alias("rx"), G.is_empty(b).alias("empty"))


@query("box_intersections", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, greatest(x, 10) AS x, greatest(y, 5) AS y, greatest(0, least(x + w, 40) - greatest(x, 10)) AS w, greatest(0, least(y + h, 25) - greatest(y, 5)) AS h, x < 40 AND 10 < x + w AND y < 25 AND 5 < y + h AS hit FROM b")
def box_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G09."""
    b, page = F.col("bbox"), G.box(F.lit(10), F.lit(5), F.lit(30), F.lit(20))
    return boxes(spark, sf_dir).select(*KEYS, *parts(G.intersection(b, page)), G.intersects(b, page).alias("hit"))


@query("box_ranges", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, x AS start, w AS length, [x, y, w, h] AS list, greatest(0, least(x + w, 30) - greatest(x, 12)) AS cut, CASE WHEN w = 0 THEN 18 ELSE greatest(x + w, 30) - least(x, 12) END AS both FROM b")
def box_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G10."""
    r, other = G.x_range(F.col("bbox")), F.struct(F.lit(12.0).alias("start"), F.lit(18.0).alias("length"))
    return boxes(spark, sf_dir).select(*KEYS, r["start"].alias("start"), r["length"].alias("length"), G.to_list(F.col("bbox")).alias("list"), G.range_intersection(r, other)["length"].alias("cut"), G.range_union(r, other)["length"].alias("both"))


@query("box_text_round_trip", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, x, y, w, h FROM b")
def box_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes are written as text and read again."""
    return boxes(spark, sf_dir).select(*KEYS, *parts(G.parse_box(G.box_text(F.col("bbox")))))


@query("node_boxes", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, 0.0::DOUBLE AS lx, w AS lw, x AS sx, w * 0.8 * 3 AS sw FROM b")
def node_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of nodes from their attributes."""
    t = lambda c: c.cast("string")
    b = F.col("bbox")
    lxml = G.lxml_box(F.create_map(F.lit("width"), t(b["width"]), F.lit("height"), t(b["height"])))
    svg = G.svg_box(F.create_map(F.lit("x"), t(b["x"]), F.lit("y"), t(b["y"]), F.lit("font-size"), t(b["width"])), F.lit("abc"))
    return boxes(spark, sf_dir).select(*KEYS, lxml["x"].alias("lx"), lxml["width"].alias("lw"), svg["x"].alias("sx"), svg["width"].alias("sw"))


@query("moved_edges", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, x - CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 0 END AS x, y - CASE WHEN l_linenumber % 4 = 1 THEN 2 ELSE 0 END AS y, w + CASE WHEN l_linenumber % 4 IN (0, 2) THEN 2 ELSE 0 END AS w, h + CASE WHEN l_linenumber % 4 IN (1, 3) THEN 2 ELSE 0 END AS h FROM b")
def moved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return boxes(spark, sf_dir).select(*KEYS, *parts(G.edge_moved(F.col("bbox"), F.col("l_linenumber") % 4, F.lit(2))))


@query("points_of_pixels", f"WITH b AS (SELECT {BOX_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, round_even(x * 0.75, 3) AS x, round_even(y * 0.75, 3) AS y, round_even(greatest(0, least(x + w, 60) - x) * 0.75, 3) AS w, round_even(greatest(0, least(y + h, 30) - y) * 0.75, 3) AS h FROM b")
def points_of_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15, G16, P13."""
    page = G.image_box(F.lit(60), F.lit(30))
    return boxes(spark, sf_dir).select(*KEYS, *parts(G.points_of_pixels(F.col("bbox"), page, F.lit(0.75), F.lit(0.75))))


@query("best_rows", "SELECT l_orderkey, arg_max(l_partkey, (l_quantity, l_extendedprice, -l_linenumber)) AS l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey")
def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of a key by several values, the first page of equal ones."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linenumber")
    return joins.best_by(rows, ["l_orderkey"], [F.col("l_quantity"), F.col("l_extendedprice"), -F.col("l_linenumber")]).select("l_orderkey", "l_partkey", "l_quantity")


@query("top_tag_over_half", "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_orderkey) AS p FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, arg_max(l_returnflag, p) AS tag FROM c WHERE p > 0.5 GROUP BY l_orderkey")
def top_tag_over_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest tag of a place, if it has more than half."""
    shares = evaluation.tag_shares(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("l_returnflag").alias("tag")))
    return shares.where("percentage > 0.5").groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.max_by("tag", "percentage").alias("tag"))


@query("fallback_rows", "SELECT o_orderkey, o_totalprice AS score, 'first' AS kind FROM orders WHERE o_totalprice >= 100000 UNION ALL SELECT o_orderkey, o_totalprice / 2, 'second' FROM orders WHERE o_totalprice < 100000")
def fallback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second way for what the first did not settle."""
    o = table(spark, sf_dir, "orders")
    return joins.with_fallback(o.select("o_orderkey", F.col("o_totalprice").alias("score"), F.lit("first").alias("kind")), o.select("o_orderkey", (F.col("o_totalprice") / 2).alias("score"), F.lit("second").alias("kind")), "o_orderkey", "score", 100000)


@query("neighbour_ratio", "SELECT user_id AS query_id, event_id AS train_id, value AS distance FROM (SELECT *, row_number() OVER w AS n, lead(value) OVER w AS nx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)) WHERE n = 1 AND value < 0.7 * nx")
def neighbour_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    return joins.ratio_filtered(table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("train_id"), F.col("value").alias("distance")))


@query("not_parents", "SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS parent_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey + 1 FROM orders WHERE o_orderkey % 4 = 0)")
def not_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, U02."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") + 1).alias("parent_id"))
    return joins.without_parents(nodes)


@query("nearest_ancestors", "SELECT l_orderkey AS doc_id, l_linenumber AS node_id, max(a.n) AS ancestor_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS n) a WHERE a.n < l.l_linenumber AND a.n % 2 = 1 GROUP BY 1, 2 HAVING true")
def nearest_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last odd node above each; a node's path is all numbers up to it."""
    docs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct()
    path = F.sequence(F.lit(1), F.col("node_id"))
    asked = docs.select("doc_id", F.col("l_linenumber").alias("node_id"))
    tree = docs.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("node_id"))
    found = joins.nearest_ancestor(tree.withColumn("path", path), F.col("node_id") % 2 == 1)
    return found.join(asked, ["doc_id", "node_id"], "left_semi")


@query("mapped_colours", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 1 THEN 9 ELSE l_linenumber END AS r, 0 AS g, 0 AS b FROM lineitem")
def mapped_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J09, J18, R06."""
    pixels = table(spark, sf_dir, "lineitem").select(*KEYS, F.col("l_linenumber").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return joins.mapped_colours(pixels, spark.createDataFrame([(1, 0, 0, 9, 0, 0)], "r int, g int, b int, r2 int, g2 int, b2 int")).select(*KEYS, "r", "g", "b")


@query("kept_indices", "SELECT item_id, list_filter(string_split(text, ' '), lambda x, i: (i - 1) IN (0, 2, 5)) AS words FROM benchmark")
def kept_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P04."""
    return table(spark, sf_dir, "benchmark").select("item_id", N.keep_indices(F.split("text", " "), F.array(F.lit(0), F.lit(2), F.lit(5))).alias("words"))


@query("zipped_arrays", "SELECT item_id, unnest(list_zip(w[1:least(len(w), 7)], range(1, 8)[1:least(len(w), 7)])).* FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)".replace(".*", "[1] AS word"))
def zipped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays side by side up to the shortest."""
    w = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"), F.sequence(F.lit(1), F.lit(7)).alias("n"))
    return rows.select("item_id", F.explode(N.zipped(F.col("w"), F.col("n"))).alias("z")).select("item_id", F.col("z.w").alias("word"))


@query("zipped_neighbours", """WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
SELECT a.item_id, unnest(range(1, least(len(a.w), len(b.w)) + 1)) AS k, unnest(a.w[1:least(len(a.w), len(b.w))]) AS word, unnest(b.w[1:least(len(a.w), len(b.w))]) AS beside FROM b a JOIN b ON b.item_id = a.item_id + 1""")
def zipped_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of an item beside those of the next one, up to the shorter."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    rows = items.join(after, "item_id").select("item_id", F.posexplode(N.zipped(F.col("w"), F.col("v"))).alias("k", "z"))
    return rows.select("item_id", (F.col("k") + 1).cast("long").alias("k"), F.col("z.w").alias("word"), F.col("z.v").alias("beside"))


@query("number_ranges", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN range(CAST(p_size AS BIGINT), 21) ELSE [] END AS numbers FROM part")
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a number to 20, nothing above."""
    return table(spark, sf_dir, "part").select("p_partkey", N.number_range(F.col("p_size").cast("string"), F.lit("20")).alias("numbers"))


@query("gaps_of_ranges", "SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN [0, p_size % 10 + 5] ELSE [p_size % 10 + 5] END AS starts, CASE WHEN p_size % 10 > 0 THEN [p_size % 10, 20] ELSE [20] END AS stops FROM part")
def gaps_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M05, C19."""
    s = F.col("p_size") % 10
    ranges = F.array(F.struct(s.alias("s"), (s + 5).alias("e")))
    return table(spark, sf_dir, "part").select("p_partkey", N.inverted_ranges(ranges, F.lit(0), F.lit(20)).alias("gaps")).select("p_partkey", F.col("gaps.s").alias("starts"), F.col("gaps.e").alias("stops"))


@query("array_sets", "SELECT p_partkey, CASE WHEN p_size = 1 THEN [1, 2] ELSE [1, 2, p_size] END[1:CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END] AS added, list_filter([1, 2, 3, 2], lambda x: x <> p_size) AS rest FROM part")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01, U02, U04."""
    size, two = F.col("p_size"), F.array(F.lit(1), F.lit(2))
    rest = N.without(F.array(*[F.lit(k) for k in (1, 2, 3, 2)]), F.array(size))
    return table(spark, sf_dir, "part").select("p_partkey", N.append_new(two, size).alias("added"), rest.alias("rest"))


@query("json_defaults", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.none'), '7') AS INT) AS n FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, S28."""
    n = F.from_json("props", "none int")["none"]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(n, F.lit(7)).alias("n"))


@query("prefixed_maps", "SELECT p_partkey, p_name AS a, p_size IS NOT NULL AS kept, 1 AS n FROM part")
def prefixed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M03, M04, F19."""
    from folio.functions import tags as T

    m = F.create_map(F.lit("sub.a"), F.col("p_name"), F.lit("other"), F.col("p_brand"), F.lit("none"), F.lit(None).cast("string"))
    sub, flipped = T.prefixed_values(m, "sub."), N.inverted(N.without_nulls(m))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(sub, "a").alias("a"), (F.try_element_at(flipped, F.col("p_name")) == "sub.a").alias("kept"), F.size(sub).alias("n"))


@query("class_positions", "SELECT event_id, [CAST(event_type = 'click' AS INT), CAST(event_type = 'view' AS INT), CAST(event_type NOT IN ('click', 'view') AS INT)] AS hot FROM events")
def class_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot channels with an unknown class."""
    return table(spark, sf_dir, "events").select("event_id", N.one_hot(F.col("event_type"), ["click", "view"]).alias("hot"))


@query("likeliest_class", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS k FROM embeddings")
def likeliest_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the greatest probability."""
    return table(spark, sf_dir, "embeddings").select("vec_id", N.argmax(F.col("embedding")).cast("int").alias("k"))


@query("transposed", "SELECT CAST(k AS BIGINT) AS k, vec_id, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of vectors keyed by column; as rows, since a column is as long as the table."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return rows.select(F.col("k").cast("long").alias("k"), "vec_id", "v")


@query("stable_priorities", "SELECT p_partkey, row_number() OVER (ORDER BY -(p_size % 5), p_partkey) AS n FROM part")
def stable_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority, the highest first, then by place."""
    found = joins.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [-(F.col("p_size") % 5), "p_partkey"])
    return found.select("p_partkey", "n")


@query("sorted_matches", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 200")
def sorted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By place; the first 200."""
    return table(spark, sf_dir, "lineitem").select(*KEYS).orderBy(*KEYS).limit(200)


@query("all_sorted_matches", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey")
def all_sorted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All by place."""
    return table(spark, sf_dir, "lineitem").select(*KEYS).orderBy(*KEYS)


@query("sorted_distinct_tags", "SELECT DISTINCT event_type FROM events ORDER BY 1")
def sorted_distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T09."""
    return table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


@query("repeated_epochs", "SELECT item_id, epoch FROM benchmark, (SELECT unnest(range(3)) AS epoch)")
def repeated_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once an epoch, without a join."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("epoch"))


@query("shuffled", "SELECT item_id FROM benchmark")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In an order drawn with a seed."""
    return table(spark, sf_dir, "benchmark").select("item_id").orderBy(F.xxhash64("item_id", F.lit(42)))


@query("category_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a filter that the scan takes."""
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select("event_id")


@query("images_with_colours", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber IN (5, 6)")
def images_with_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images that have one of the colours: a semi join on counted pixels."""
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("r")).distinct()
    colours = spark.createDataFrame([(5,), (6,)], "r int")
    return pixels.join(colours, "r", "left_semi").select("l_orderkey").distinct()


@query("coco_counts", "SELECT l_orderkey AS image_id, l_returnflag AS category, count(*) AS annotations, round(sum(CAST(l_quantity AS DOUBLE) * l_linenumber * 3), 3) AS area FROM lineitem GROUP BY 1, 2")
def coco_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by page and category, and the area that they cover."""
    b = F.col("bbox")
    return boxes(spark, sf_dir).groupBy(F.col("l_orderkey").alias("image_id"), F.col("l_returnflag").alias("category")).agg(F.count("*").alias("annotations"), F.round(F.sum(b["width"] * b["height"]), 3).alias("area"))


@query("match_ranges", "SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, least(abs(min(l_linenumber) - 3), abs(max(l_linenumber) - 3)) AS distance FROM lineitem GROUP BY l_orderkey")
def match_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that rows span, and how far they are from a line."""
    lo, hi = F.min("l_linenumber"), F.max("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lo.alias("first"), hi.alias("last"), F.least(F.abs(lo - 3), F.abs(hi - 3)).alias("distance"))
