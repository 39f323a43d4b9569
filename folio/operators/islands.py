"""Gaps and islands: runs of tokens with one tag become items, items become records. Windows by document; no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import tags as T
from folio.operators.tokens import in_order


def with_item(tokens: DataFrame, tag: str = "tag", within: list[str] | None = None, name: str = "item_ord") -> DataFrame:
    """The item a token is in: a new one where the tag differs from the last token's, null like any other, or begins anew.

    One window over a document, or over ``within``, gives what a pass per line and a merge of lines would.
    """
    w = in_order() if within is None else Window.partitionBy(*within).orderBy("page_idx", "line_idx", "token_idx")
    value, prefix = T.tag_value(tag), T.tag_prefix(tag)
    first = F.row_number().over(w) == 1
    starts = first | ~value.eqNullSafe(F.lag(value).over(w)) | F.coalesce(prefix == "b", F.lit(False))
    return tokens.withColumn(name, F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def joined_text(text: Column, line: Column, order: list[str], w=None) -> Column:
    """Aggregate: tokens in order, a space between them within a line and a line feed where the line changes."""
    parts = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], line.cast("string").alias("_line"), F.coalesce(text, F.lit("")).alias("_text"))))
    lines = F.concat(F.array(F.lit(None).cast("string")), F.transform(parts, lambda p: p["_line"]))  # of the token before

    def led(p: Column, before: Column) -> Column:
        return F.concat(F.when(before.isNull(), "").when(before == p["_line"], " ").otherwise("\n"), p["_text"])

    return F.array_join(F.zip_with(parts, lines, led), "")  # the place past the last token is null, which a join passes over


def items(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """doc_id, item_ord, tag, tag_prefix, text, n_tokens: untagged runs are items with a null tag.

    What stands before a token, a space or a line feed, is seen beside the token before. Items are put together in a
    window, since tokens lie in its order: an aggregation to lists would sort them twice more and then each list.
    """
    w = in_order()
    same_line = (F.lag("page_idx").over(w) == F.col("page_idx")) & (F.lag("line_idx").over(w) == F.col("line_idx"))
    led = F.concat(F.when(same_line, " ").otherwise("\n"), F.coalesce(F.col("text"), F.lit("")))
    placed = with_item(tokens.withColumns({"_ord": F.row_number().over(w), "_led": led}), tag)
    in_item = Window.partitionBy("doc_id", "item_ord").orderBy("_ord")
    whole = in_item.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = placed.select("doc_id", "item_ord", F.col(tag).alias("_tag"), F.row_number().over(in_item).alias("_first"), F.collect_list("_led").over(whole).alias("_parts"), F.count("*").over(whole).alias("n_tokens"))
    text = F.substring(F.array_join("_parts", ""), 2, (1 << 31) - 1)
    return met.where("_first = 1").select("doc_id", "item_ord", T.tag_value("_tag").alias("tag"), T.tag_prefix("_tag").alias("tag_prefix"), text.alias("text"), "n_tokens")


def sub_items(tokens: DataFrame, tag: str = "tag", sub_tag: str = "sub_tag") -> DataFrame:
    """Items of second-level tags inside items: doc_id, item_ord, sub_ord, tag, sub_tag, text."""
    inside = with_item(with_item(tokens, tag), sub_tag, ["doc_id", "item_ord"], "sub_ord")
    line, order = F.concat_ws(":", "page_idx", "line_idx"), ["page_idx", "line_idx", "token_idx"]
    first = lambda c: F.min_by(F.col(c), F.struct(*order))
    out = inside.groupBy("doc_id", "item_ord", "sub_ord").agg(first(tag).alias("_tag"), first(sub_tag).alias("_sub"), joined_text(F.col("text"), line, order).alias("text"))
    return out.select("doc_id", "item_ord", "sub_ord", T.tag_value("_tag").alias("tag"), T.tag_value("_sub").alias("sub_tag"), "text")


def sub_item_counts(tokens: DataFrame, tag: str = "tag", sub_tag: str = "sub_tag") -> DataFrame:
    """doc_id, item_ord, sub_ord, sub_tag, n: ``with_item`` at two levels and a count, in one order of the document.

    Only tokens that begin an item of either level are kept, and numbered in the order in which they lie; how many there
    are up to the next is told by their places. So tokens are sorted once, and not grouped.
    """
    w = in_order()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def begins(c: str) -> Column:
        return ~T.tag_value(c).eqNullSafe(F.lag(T.tag_value(c)).over(w)) | F.coalesce(T.tag_prefix(c) == "b", F.lit(False))

    place = F.row_number().over(w)
    starts = (place == 1) | begins(tag)
    marked = tokens.withColumns({"_place": place, "_starts": starts, "_sub": starts | begins(sub_tag), "_size": F.count("*").over(Window.partitionBy("doc_id"))})
    begun = marked.where("_sub").select("doc_id", "page_idx", "line_idx", "token_idx", "_place", "_starts", "_size", sub_tag)
    counted = begun.withColumns({"item_ord": F.sum(F.col("_starts").cast("int")).over(so_far) - 1, "_row": F.row_number().over(w).cast("long"), "_next": F.coalesce(F.lead("_place").over(w), F.col("_size") + 1)})
    first = F.max(F.when(F.col("_starts"), F.col("_row"))).over(so_far)
    return counted.select("doc_id", "item_ord", (F.col("_row") - first).alias("sub_ord"), sub_tag, (F.col("_next") - F.col("_place")).alias("n"))


def untagged_runs(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """Contiguous tokens of a line without a tag: doc_id, page_idx, line_idx, run, text, n_tokens."""
    w = Window.partitionBy("doc_id", "page_idx", "line_idx").orderBy("token_idx")
    bare = F.coalesce(F.col(tag), F.lit("")) == ""
    starts = bare & ~F.coalesce(F.lag(bare).over(w), F.lit(False))
    marked = tokens.withColumns({"_bare": bare, "run": F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1}).where("_bare")
    return marked.groupBy("doc_id", "page_idx", "line_idx", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "text"))), lambda s: s["text"]), " ").alias("text"), F.count("*").alias("n_tokens"))


def begin_inside(matches: DataFrame, group: list[str], tag: str = "tag", order: tuple[str, ...] = ("page_idx", "line_idx", "token_idx")) -> DataFrame:
    """Tags of matched tokens with prefixes: ``b-`` for the first of a match, ``i-`` for the rest."""
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return matches.withColumn(tag, F.concat(F.when(first, "b-").otherwise("i-"), F.col(tag)))


def single_node_text(mapped: DataFrame) -> DataFrame:
    """Text of a field that has one node: an item counts if it is the first of its tag, or follows an item of its tag.

    ``mapped``: doc_id, item_ord, tag, text, items of mapped tags only.
    """
    in_doc, of_tag = Window.partitionBy("doc_id").orderBy("item_ord"), Window.partitionBy("doc_id", "tag").orderBy("item_ord")
    counts = (F.row_number().over(of_tag) == 1) | (F.lag("tag").over(in_doc) == F.col("tag"))
    kept = mapped.withColumn("_keep", counts).where("_keep")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "text"))), lambda s: s["text"]), "\n")
    return kept.groupBy("doc_id", "tag").agg(text.alias("text"))


def excluded_tokens(tokens: DataFrame, tag: str = "tag", most: int = 100) -> DataFrame:
    """A look at tokens that matching leaves out: ``most`` of them."""
    return tokens.where(F.coalesce(F.col(tag), F.lit("")) != "").limit(most)
