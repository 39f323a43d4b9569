"""The token table: a row per token, keyed by document, page, line and token; projections and positions on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from folio.functions import tags as tag_functions
from folio.functions import text as text_functions

KEY = ("doc_id", "page_idx", "line_idx", "token_idx")
#: Characters of a text whose tokens are worked on as one row.
WHOLE_TEXT = 1 << 18


def in_order() -> WindowSpec:
    """Document order. Windows are by document, so no task holds more than a document."""
    return Window.partitionBy("doc_id").orderBy("page_idx", "line_idx", "token_idx")


def from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_per_page: int = 50) -> DataFrame:
    """Lines at line feeds, tokens at single spaces, pages of a fixed number of lines. A null text has no tokens."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    lines = lines.select("doc_id", F.expr(f"n div {lines_per_page}").cast("int").alias("page_idx"), (F.col("n") % lines_per_page).alias("line_idx"), "line")
    return lines.select("doc_id", "page_idx", "line_idx", F.posexplode(F.split("line", " ")).alias("token_idx", "text"))


def by_document(texts: DataFrame, whole: Callable[[DataFrame], DataFrame], in_windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of every document of ``texts`` (doc_id, text), which lie by document.

    Where a document is one text of WHOLE_TEXT characters at most, ``whole`` makes its rows from the text: tokens are in
    order as they are cut, so none is sorted. Longer texts, and those of an id that stands more than once, are cut into
    tokens for ``in_windows``, which may hold any number of them. What ``whole`` explodes it should explode with the outer
    form: before the other one, Spark looks for empty arrays where texts are read, and there makes each array again.
    """
    rows = F.count("*").over(Window.partitionBy("doc_id"))
    counted = texts.withColumn("_whole", F.coalesce((rows == 1) & (F.length("text") <= WHOLE_TEXT), F.lit(False)))
    part = lambda which: counted.where(which).drop("_whole")
    return whole(part("_whole")).unionByName(in_windows(from_text(part("NOT _whole"))))


def cut(text: str = "text", lines_per_page: int = 50) -> Column:
    """The tokens of ``from_text`` in order, as an array: page_idx, line_idx, token_idx, text."""

    def line(words: Column, n: Column) -> Column:
        place = F.floor(n / lines_per_page).cast("int").alias("page_idx"), (n % lines_per_page).alias("line_idx")
        return F.transform(F.split(words, " "), lambda t, k: F.struct(*place, k.alias("token_idx"), t.alias("text")))

    return F.flatten(F.transform(F.split(text, "\n"), line))


def words(text: str = "text") -> Column:
    """The texts of the tokens of ``from_text`` in order, as an array."""
    return F.split(F.translate(text, "\n", " "), " ")


def with_ordinal(tokens: DataFrame, name: str = "doc_ord") -> DataFrame:
    """The token's place in its document, from 0: what positional joins join on."""
    return tokens.withColumn(name, F.row_number().over(in_order()) - 1)


def with_positions(tokens: DataFrame) -> DataFrame:
    """Index and count of the token in its line, of the line in its page, of the page in its document."""
    in_line = Window.partitionBy("doc_id", "page_idx", "line_idx")
    in_page = Window.partitionBy("doc_id", "page_idx")
    in_doc = Window.partitionBy("doc_id")
    rank = lambda w, *by: F.dense_rank().over(w.orderBy(*by)) - 1
    ranked = tokens.withColumns({"token_index": F.row_number().over(in_line.orderBy("token_idx")) - 1, "token_count": F.count("*").over(in_line), "line_index": rank(in_page, "line_idx"), "page_index": rank(in_doc, "page_idx")})
    return ranked.withColumns({"line_count": F.max("line_index").over(in_page) + 1, "page_count": F.max("page_index").over(in_doc) + 1})


def text_positions(texts: DataFrame, lines_per_page: int = 50) -> DataFrame:
    """``with_positions`` of the tokens of texts, each a document of its own: known as they are cut, since no line is empty."""
    lines = texts.withColumn("_lines", F.split("text", "\n")).select("doc_id", F.size("_lines").alias("_n"), F.posexplode_outer("_lines").alias("n", "line"))
    page = F.expr(f"n div {lines_per_page}").cast("int")
    placed = lines.select("doc_id", page.alias("page_idx"), (F.col("n") % lines_per_page).alias("line_idx"), F.split("line", " ").alias("_words"), F.least(F.col("_n") - page * lines_per_page, F.lit(lines_per_page)).alias("line_count"), F.ceil(F.col("_n") / lines_per_page).cast("int").alias("page_count"))
    counted = placed.select("doc_id", "page_idx", "line_idx", F.size("_words").cast("long").alias("token_count"), "line_count", "page_count", F.posexplode_outer("_words").alias("token_idx", "text"))
    return counted.withColumns({"token_index": F.col("token_idx"), "line_index": F.col("line_idx"), "page_index": F.col("page_idx")})


def relative_box(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of its page; null on a page without a size."""
    part = lambda n, by: F.try_divide(box[n], by).alias(n)
    return F.struct(part("x", width), part("y", height), part("width", width), part("height", height))


def token_props(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Text, tag, scoped tags, box, box relative to the page, positions and page size of every token."""
    sized = pages.select("doc_id", "page_idx", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
    met = with_positions(tokens).join(sized, ["doc_id", "page_idx"], "left")
    met = met.withColumns({"rel_bbox": relative_box(F.col("bbox"), F.col("page_width"), F.col("page_height")), "tag": tag_functions.get_tag("tags"), "scoped_tags": F.map_filter("tags", lambda k, _: k != "")})
    return met


def labels(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    return tokens.withColumn("label", tag_functions.label(tag))


def without_labels(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    return tokens.drop(tag)


def page_slice(tokens: DataFrame, first: int, last: int) -> DataFrame:
    """Pages ``first`` to ``last``, from 1, both included: a filter that reaches a Parquet scan."""
    return tokens.where(F.col("page_idx").between(max(0, first - 1), last - 1))


def sorted_by_x(tokens: DataFrame, as_text: bool = False) -> DataFrame:
    """Places of tokens in their line by x: as a number, or, as some sources had it, as text ('100' before '20')."""
    x = F.col("x_raw") if as_text else F.col("x_raw").try_cast("double")
    by = Window.partitionBy("doc_id", "page_idx", "line_idx").orderBy(x, "token_idx")
    return tokens.withColumn("x_order", F.row_number().over(by) - 1)


def next_lines(lines: DataFrame) -> DataFrame:
    """Each line with the one after it in its document."""
    return lines.withColumn("next_line", F.lead("line").over(Window.partitionBy("doc_id").orderBy("page_idx", "line_idx")))


def character_spans(tokens: DataFrame) -> DataFrame:
    """Where each token starts and ends in its line, tokens joined by one space."""
    w = Window.partitionBy("doc_id", "page_idx", "line_idx").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text") + 1).over(w) - 1
    return tokens.withColumns({"end": end}).withColumn("start", F.col("end") - F.length("text"))


def tokens_between(spans: DataFrame, start: Column, stop: Column) -> DataFrame:
    return spans.where((F.col("end") > start) & (F.col("start") < stop))


def words_at_characters(spans: DataFrame) -> DataFrame:
    """A row per character of a line with the token it is in (``word_index``), spaces left out."""
    there = spans.where(F.col("end") > F.col("start"))
    return there.select("doc_id", "page_idx", "line_idx", F.explode(F.sequence("start", F.col("end") - 1)).alias("char_index"), F.col("token_idx").alias("word_index"))


def span_words(text: Column) -> Column:
    """Words and punctuation of a text with where they start and end: array of (word, start, end).

    Words are found by a pattern, and each one's place from where the last ended: a fold, no Python.
    """
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    kind = "array<struct<word:string,start:int,end:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, w: Column) -> Column:
        at = acc["at"] + F.instr(F.substring(text, acc["at"] + 1, F.length(text)), w) - 1
        end = at + F.length(w)
        return F.struct(F.array_append(acc["out"], F.struct(w.alias("word"), at.cast("int").alias("start"), end.cast("int").alias("end"))).alias("out"), end.cast("int").alias("at"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def xml_tokens(xml_texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Tokens of text nodes, each node by itself."""
    return xml_texts.withColumn("token", F.explode(text_functions.tokenise(text_col)))
