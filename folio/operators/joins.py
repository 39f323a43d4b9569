"""Joins of the document pipelines: by position, by place, by file, by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.operators.tokens import with_ordinal
from folio.sources.shared import written

#: Rows of a side that may be broadcast when its count is known.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a side if its counted rows are few; else leave the strategy to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dealt(df: DataFrame, *by: str | Column) -> DataFrame:
    """``df`` dealt to all cores at least, for a step whose work is large beside its bytes: small partitions are not merged again."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *by)


def pair_key(path: Column, by: str = "directory") -> Column:
    """What files are paired by: their directory, or their name up to the first dot."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1) if by == "directory" else F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def file_pairs(sources: DataFrame, xmls: DataFrame, by: str = "directory", limit: int | None = None) -> DataFrame:
    """source_url, xml_url: files that share a key, by path; the first ``limit``."""
    a = sources.select(F.col("path").alias("source_url"), pair_key(F.col("path"), by).alias("_key"))
    b = xmls.select(F.col("path").alias("xml_url"), pair_key(F.col("path"), by).alias("_key"))
    out = a.join(b, "_key").drop("_key").orderBy("source_url", "xml_url")
    return out.limit(limit) if limit else out


def at_same_place(tokens: DataFrame, other: DataFrame) -> DataFrame:
    """Each row of ``other`` (doc_id, doc_ord, more) with the token at its place, as ``tokens`` has it; rows without one go.

    What a join on document and place gives, but as one window over a document, into which the two are put together: a
    join would shuffle every token of both sides by document and place, even where they lie by document already.
    """
    a, b = with_ordinal(tokens), other.where(F.col("doc_id").isNotNull())
    wanted = [c for c in other.columns if c not in ("doc_id", "doc_ord")]
    token, more = F.struct(*tokens.columns), F.struct(*wanted)
    none = lambda c, df: F.lit(None).cast(df.select(c.alias("_")).schema["_"].dataType)
    key = F.col("doc_ord").cast("long").alias("doc_ord")
    both = a.where(F.col("doc_id").isNotNull()).select("doc_id", key, F.lit(0).alias("_side"), token.alias("_token"), none(more, b).alias("_more"))
    both = both.unionByName(b.select("doc_id", key, F.lit(1).alias("_side"), none(token, a).alias("_token"), more.alias("_more")))
    w = Window.partitionBy("doc_id").orderBy("doc_ord", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("doc_ord", "_token")), ignorenulls=True).over(w)
    met = both.withColumn("_last", last).where((F.col("_side") == 1) & (F.col("_last.doc_ord") == F.col("doc_ord")))
    return met.select("_last._token.*", *[F.col(f"_more.{c}").alias(c) for c in wanted])


def merge_tokens(tokens: DataFrame, other: DataFrame, source: str = "tag", target: str = "tag", check_text: bool = True) -> DataFrame:
    """Copy a tag from the token at the same place of the other document, where it has one. Tokens beyond the shorter go.

    Texts that differ at a place raise, unless ``check_text`` is off.
    """
    b = with_ordinal(other).select("doc_id", "doc_ord", F.col("text").alias("_text"), F.col(source).alias("_tag"))
    met = at_same_place(tokens, b)
    if check_text:
        same = F.col("text").eqNullSafe(F.col("_text"))
        met = met.withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("tokens differ: "), F.col("text"), F.lit(" / "), F.col("_text"))).cast("string")))
    return met.withColumn(target, F.coalesce("_tag", F.col(target))).drop("_text", "_tag")


def with_predictions(tokens: DataFrame, predictions: DataFrame, target: str = "crf_tag") -> DataFrame:
    """Set a tag from the prediction at the same place (doc_id, doc_ord, prediction), unless it is empty or O."""
    met = at_same_place(tokens, predictions.select("doc_id", "doc_ord", "prediction"))
    return met.withColumn(target, F.when(~F.col("prediction").isin("", "O"), F.col("prediction"))).drop("prediction")


def with_prediction_lists(docs: DataFrame, predictions: DataFrame, target: str = "crf_tag") -> DataFrame:
    """``with_predictions`` where a document is a row: its tokens (doc_id, tokens: array of structs) meet its predictions in
    order (doc_id, predictions: array of strings), as a model gives them. Tokens or predictions beyond the other list go.
    """
    met = docs.join(predictions, "doc_id").withColumn("_n", F.least(F.size("tokens"), F.size("predictions")))
    both = met.select("doc_id", *[F.slice(c, F.lit(1), F.col("_n")).alias(c) for c in ("tokens", "predictions")])
    rows = both.select("doc_id", F.explode_outer(F.arrays_zip("tokens", "predictions")).alias("_at")).where("_at IS NOT NULL")
    prediction = F.col("_at.predictions")
    return rows.select("doc_id", "_at.tokens.*", F.when(~prediction.isin("", "O"), prediction).alias(target))


def rows_in_order(df: DataFrame, by: list[str], name: str = "row") -> DataFrame:
    """Rows numbered from 0 in an order that is told. A file list is small; the window has one partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)) - 1)


def numbered(df: DataFrame, by: list[str | Column], name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order of ``by``, for tables of any size.

    Rows are dealt by ranges of ``by``, taken from a sample, so tasks are even whatever the values are; each range is
    numbered on its own and moved on by the rows of the ranges before, of which there is a row a task. The dealt table
    is written: where a row lies must not change between the two. Rows that are equal in ``by`` are numbered as they lie.
    """
    spark = df.sparkSession
    keys = {f"_k{k}": F.expr(c) if isinstance(c, str) else c for k, c in enumerate(by)}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns(keys).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    lying = written(ranged, "ranges")
    counts = lying.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    own = lying.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    met = own.join(F.broadcast(before), "_part")  # a row a task
    return met.withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_part", *keys)


def zip_lists(a: DataFrame, b: DataFrame, by_a: list[str], by_b: list[str], same_length: bool = True) -> DataFrame:
    """Rows of two lists side by side; lists of different lengths raise, or are cut to the shorter."""
    met = rows_in_order(a, by_a).join(rows_in_order(b, by_b), "row", "full" if same_length else "inner")
    if same_length:
        one = F.col(by_a[0]).isNull() | F.col(by_b[0]).isNull()
        met = met.withColumn(by_a[0], F.when(one, F.raise_error(F.lit("the lists differ in length")).cast(dict(a.dtypes)[by_a[0]])).otherwise(F.col(by_a[0])))
    return met


def without_output(items: DataFrame, outputs: DataFrame, output: Column) -> DataFrame:
    """Items whose output file is not among ``outputs`` (path): what is left to do on a second run."""
    done = outputs.select(F.col("path").alias("_done"))
    return items.join(done, output == F.col("_done"), "left_anti")


def in_vocabulary(lines: DataFrame, vocabulary: DataFrame, token: Column) -> DataFrame:
    """Lines whose token is in the vocabulary (token), letter case aside on both sides."""
    words = vocabulary.select(F.lower("token").alias("_word")).distinct()
    return lines.join(words, F.lower(token) == F.col("_word"), "left_semi")


#: Boxes of one page and tag that are compared without a grid.
FEW_BOXES = 64


def overlapping(blocks: DataFrame, margin: float = 1) -> DataFrame:
    """Pairs of blocks of one page and tag whose boxes touch, widened sideways: doc_id, page_idx, tag, left_ord, right_ord.

    ``blocks``: doc_id, page_idx, tag, block_ord, bbox. On pages with many boxes of a tag a grid of cells is part of the
    join's keys: cells of a level are as wide as the boxes whose level it is, so a box lies in four of them at most, on
    its own level and on each coarser one that is in use. A pair is reported in the one cell that holds the corner where
    the two boxes begin to overlap. Work follows the boxes and the pairs that touch, not the square of a page's boxes.
    """
    x, y, w, h = (F.col(f"bbox.{c}") for c in ("x", "y", "width", "height"))
    keys = ["doc_id", "page_idx", "tag"]
    many = blocks.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW_BOXES).select(*[F.col(c).alias(f"_{c}") for c in keys])
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_idx") == F.col("_page_idx")) & F.col("tag").eqNullSafe(F.col("_tag"))
    reach = F.greatest(w, F.lit(1)) + 2 * margin, F.greatest(h, F.lit(1))
    level = F.ceil(F.log2(F.greatest(*reach))).cast("int")
    placed = blocks.join(many, same, "left").select(*blocks.columns, F.when(F.col("_doc_id").isNotNull(), level).otherwise(-1).alias("_level"))
    used = placed.agg(F.sort_array(F.collect_set("_level")).alias("_used"))  # one row: some sixty levels at most
    left, top = x - margin, y
    side = lambda lv: F.pow(F.lit(2.0), lv)
    cell = lambda v, lv: F.floor(v / side(lv)).cast("long")

    def cells(levels: Column) -> Column:
        at = lambda lv: F.transform(
            F.sequence(cell(left, lv), cell(left + reach[0], lv)),
            lambda cx: F.transform(F.sequence(cell(top, lv), cell(top + reach[1], lv)), lambda cy: F.struct(lv.alias("on"), cx.alias("cx"), cy.alias("cy"))),
        )
        one = F.array(F.array(F.array(F.struct(F.lit(-1).alias("on"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))))
        return F.flatten(F.flatten(F.when(F.col("_level") < 0, one).otherwise(F.transform(levels, at))))

    columns = [*keys, "block_ord", "bbox", "_level"]
    b = placed.select(*columns, F.inline(cells(F.array("_level")))).alias("b")
    a = placed.crossJoin(F.broadcast(used)).select(*columns, F.inline(cells(F.filter("_used", lambda v: v >= F.col("_level"))))).alias("a")
    f = lambda side_, c: F.col(f"{side_}.{c}")
    met = (f("a", "doc_id") == f("b", "doc_id")) & (f("a", "page_idx") == f("b", "page_idx")) & f("a", "tag").eqNullSafe(f("b", "tag"))
    for c in ("on", "cx", "cy"):
        met &= f("a", c) == f("b", c)
    corner = F.greatest(f("a", "bbox.x"), f("b", "bbox.x")) - margin, F.greatest(f("a", "bbox.y"), f("b", "bbox.y"))
    here = (f("a", "on") < 0) | ((cell(corner[0], f("a", "on")) == f("a", "cx")) & (cell(corner[1], f("a", "on")) == f("a", "cy")))
    once = (f("a", "block_ord") != f("b", "block_ord")) & ((f("b", "_level") > f("a", "_level")) | (f("a", "block_ord") < f("b", "block_ord")))
    pairs = a.join(b, met & once & here & G.touches(f("a", "bbox"), f("b", "bbox"), margin))
    orders = f("a", "block_ord"), f("b", "block_ord")
    return pairs.select("a.doc_id", "a.page_idx", "a.tag", F.least(*orders).alias("left_ord"), F.greatest(*orders).alias("right_ord"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """The index of the nearest centroid (idx, centroid), the least index of equally near ones.

    Centroids are gathered into one row, which is broadcast, and each vector looks through it: nothing multiplies.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("idx", "centroid"))).alias("_table"))
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    best = F.array_min(F.transform("_table", lambda t: F.struct(square(t["centroid"]).alias("d"), t["idx"].alias("idx"))))
    return vectors.crossJoin(F.broadcast(table)).withColumn("nearest", best["idx"]).drop("_table")  # one row


def nearest_ancestor(nodes: DataFrame, wanted: Column) -> DataFrame:
    """Of nodes (doc_id, node_id, path: ids from the root), the last of the ancestors that ``wanted`` picks.

    Paths hold the ancestors, so the lookup is an equi join on exploded paths, not on ranges.
    """
    up = nodes.select("doc_id", "node_id", F.posexplode("path").alias("depth", "anc_id"))
    picked = nodes.where(wanted).select("doc_id", F.col("node_id").alias("anc_id"))
    met = up.join(picked, ["doc_id", "anc_id"]).where("anc_id <> node_id")
    return met.groupBy("doc_id", "node_id").agg(F.max_by("anc_id", "depth").alias("ancestor_id"))


def numbered_categories(rows: DataFrame, category: str, position: str) -> DataFrame:
    """category, id: numbers from 1 in the order in which categories are first met."""
    first = rows.groupBy(category).agg(F.min(position).alias("_first"))
    return first.select(category, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_first", category)).cast("int").alias("id"))  # a row per category


def mapped_colours(pixels: DataFrame, colours: DataFrame) -> DataFrame:
    """Pixels with colours looked up (r, g, b to r2, g2, b2), and left as they are where there is no entry."""
    met = pixels.join(colours, ["r", "g", "b"], "left")
    return met.withColumns({c: F.coalesce(f"{c}2", c) for c in "rgb"}).drop("r2", "g2", "b2")


def without_parents(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, parent_id) that are not parents of others among them."""
    parents = nodes.select(F.col("parent_id").alias("_p")).where("_p IS NOT NULL").distinct()
    return nodes.join(parents, F.col("node_id") == F.col("_p"), "left_anti")


def with_fallback(best: DataFrame, other: DataFrame, key: str, score: str, least: float) -> DataFrame:
    """Rows whose score is enough, and for keys without one the rows of ``other``."""
    good = best.where(F.col(score) >= least)
    return good.unionByName(other.join(good.select(key), key, "left_anti"))


def best_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last by ``order``: one aggregation, no sort."""
    rest = [c for c in rows.columns if c not in key]
    top = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*key, *[F.col(f"_top.{c}").alias(c) for c in rest])


def best_so_far(rows: DataFrame, key: list[str], order: str, value: Column, name: str = "best") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(value).over(w))


def ratio_filtered(neighbours: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Of neighbours (query_id, train_id, distance), the nearest, if there are two and it is near enough beside the second."""
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    ranked = neighbours.withColumns({"_n": F.row_number().over(w), "_next": F.lead("distance").over(w)})
    return ranked.where((F.col("_n") == 1) & (F.col("distance") < ratio * F.col("_next"))).drop("_n", "_next")
