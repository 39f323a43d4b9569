"""Queries on text: tokens, vocabularies, normal forms, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import nested as N
from folio.functions import tags as T
from folio.functions import text as X
from folio.operators import joins as J
from folio.plans.catalog import query, table

#: The delimiters as a class of a regex within an SQL string.
_D = "".join(f"\\x{{{ord(c):x}}}" for c in X.DELIMITERS)
_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPLIT = f"'[{_D}]|[^{_D}]+'"
_BLANK = f"regexp_replace(token, '^{_SPACE}+|{_SPACE}+$', '', 'g') = ''"
#: Tokens in DuckDB: a delimiter or a run of anything else, blank ones left out.
TOKENS = f"(SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_SPLIT})) AS token FROM documents) WHERE NOT ({_BLANK}))"


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokenise("text")).alias("token"))


@query("vocab_word_count", f"SELECT token, count(*) AS n FROM {TOKENS} GROUP BY token")
def vocab_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token of all texts occurs."""
    return document_tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))


@query("vocab_top_words", f"SELECT token, count(*) AS n FROM {TOKENS} GROUP BY token ORDER BY n DESC, token LIMIT 100")
def vocab_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred commonest tokens, by count and then by token."""
    return vocab_word_count(spark, sf_dir).orderBy(F.desc("n"), "token").limit(100)


@query("vocab_filter_semijoin", f"SELECT token, count(*) AS n FROM {TOKENS} WHERE lower(token) IN (SELECT DISTINCT lower(unnest(regexp_extract_all(text, {_SPLIT}))) FROM benchmark) GROUP BY token")
def vocab_filter_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents that the benchmark's vocabulary has, letter case aside."""
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(X.tokenise("text")).alias("token"))
    return J.in_vocabulary(vocab_word_count(spark, sf_dir), vocabulary, F.col("token"))


@query("vocab_lower_set", f"SELECT DISTINCT lower(token) AS token FROM {TOKENS}")
def vocab_lower_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary in lower case."""
    return document_tokens(spark, sf_dir).select(F.lower("token").alias("token")).distinct()


@query("embedding_first_token", "SELECT doc_id, split_part(text, ' ', 1) AS token FROM documents")
def embedding_first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: the token that an embedding line starts with."""
    return table(spark, sf_dir, "documents").select("doc_id", X.first_token("text").alias("token"))


@query("normalise_text", "SELECT conv_id, turn, translate(replace(lower(text), '&apos;', ''''), chr(8212) || chr(8211) || chr(8201) || '''', '-- \"') AS text FROM conversations")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalise("text").alias("text"))


@query("strip_whitespace", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '\r', chr(10), 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'), '\n{2,}', chr(10), 'g') AS text FROM documents""")
def strip_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C03."""
    return table(spark, sf_dir, "documents").select("doc_id", X.strip_whitespace("text").alias("text"))


@query(
    "remove_junk",
    r"""WITH t AS (SELECT doc_id, translate(replace(lower(text), '&apos;', ''''), chr(8212) || chr(8211) || chr(8201) || '''', '-- "') AS t FROM documents),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM t), p AS (SELECT *, lag(ch) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM c),
k AS (SELECT * FROM p WHERE NOT coalesce(ch IN (' ', ',') AND prev = '.' OR ch = '.' AND regexp_full_match(prev, '\p{L}') OR ch = prev, false) AND ch <> '*')
SELECT t.doc_id, coalesce(string_agg(k.ch, '' ORDER BY k.i), '') AS text FROM t LEFT JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id""",
)
def remove_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By look-behind; the SQL, which has none, goes character by character."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise_and_remove_junk("text").alias("text"))


@query("author_junk", "SELECT c_custkey, regexp_replace(c_name || ' 1.,2*', '(?:[,+*0-9][.]?)+$', '') AS name FROM customer")
def author_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    return table(spark, sf_dir, "customer").select("c_custkey", X.clean_author(F.concat("c_name", F.lit(" 1.,2*"))).alias("name"))


@query("apply_pattern", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(?:([A-Z]+) )') THEN regexp_extract(p_type, '^(?:([A-Z]+) )', 1) ELSE p_type END AS kind FROM part")
def apply_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04."""
    return table(spark, sf_dir, "part").select("p_partkey", X.apply_pattern("p_type", "([A-Z]+) ").alias("kind"))


@query("word_features", r"""SELECT c_custkey, lower(c_name) AS lower, left(c_name, 1) AS first, right(c_name, 3) AS last3, right(c_name, 2) AS last2, upper(c_name) = c_name AND lower(c_name) <> c_name AS is_upper, regexp_full_match(c_name, '\p{Nd}+') AS is_digit FROM customer""")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C07, C08."""
    f = X.token_features("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", f["word.lower"].alias("lower"), f["word[:1]"].alias("first"), f["word[-3:]"].alias("last3"), f["word[-2:]"].alias("last2"), f["word.isupper"].alias("is_upper"), f["word.isdigit"].alias("is_digit"))


@query("tag_prefixes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b' WHEN event_id % 3 = 1 THEN 'i' END AS prefix, event_type AS value FROM events")
def tag_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes are put on, and taken apart again."""
    prefix = F.when(F.col("event_id") % 3 == 0, "b").when(F.col("event_id") % 3 == 1, "i")
    tagged = table(spark, sf_dir, "events").withColumn("tag", T.with_prefix("event_type", prefix))
    return tagged.select("event_id", T.tag_prefix("tag").alias("prefix"), T.tag_value("tag").alias("value"))


@query("scoped_tags", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS crf, 'x' AS plain, 1 + CAST(event_id % 2 = 0 AS INT) AS n FROM events")
def scoped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by scope in a map; a null value removes its key."""
    start = F.create_map(F.lit(""), F.lit("x"))
    value = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    tags = T.set_tag(start, value, T.scope_key("tag", "crf"))
    rows = table(spark, sf_dir, "events").withColumn("tags", tags)
    return rows.select("event_id", T.get_tag("tags", "crf-tag").alias("crf"), T.get_tag("tags").alias("plain"), F.size("tags").alias("n"))


@query("palette_colour", f"SELECT event_type, {list(X.PALETTE)}[list_reduce(list_transform(string_split(md5(event_type), ''), lambda d: strpos('0123456789abcdef', d) - 1), lambda a, d: (a * 16 + d) % {len(X.PALETTE)}) + 1] AS colour FROM (SELECT DISTINCT event_type FROM events)")
def palette_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 as one number modulo the palette; folded over hex digits."""
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", X.colour_for_tag("event_type").alias("colour"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '^(?:(.*)/)?([^/]*)$', 1) AS head, regexp_extract(url, '^(?:(.*)/)?([^/]*)$', 2) AS tail FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13."""
    return table(spark, sf_dir, "pages").select("page_id", X.path_head("url").alias("head"), X.path_tail("url").alias("tail"))


@query("page_names", "SELECT page_id, url || '#page' || page_id AS uri, url || '.annot#page' || page_id AS annotated, printf('/page_%05d.jpg', page_id) AS image FROM pages")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21, C23."""
    n = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", X.page_uri(F.col("url"), n).alias("uri"), X.page_uri(F.col("url"), n, True).alias("annotated"), X.page_image_name(n).alias("image"))


@query("model_extension", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN '.crf-cv.lxml.gz' WHEN quality = 1 THEN '.crf.lxml.gz' ELSE '.cv.lxml.gz' END AS ext FROM labels WHERE quality = 1 OR toxic = 1")
def model_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    some = table(spark, sf_dir, "labels").where("quality = 1 OR toxic = 1")
    return some.select("doc_id", X.annotated_extension(F.col("quality") == 1, F.col("toxic") == 1).alias("ext"))


@query("metric_format", "SELECT l_orderkey, l_linenumber, printf('tax: %.3f, discount: %.3f', l_tax, l_discount) AS text FROM lineitem")
def metric_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.format_metrics(tax=F.col("l_tax"), discount=F.col("l_discount")).alias("text"))


@query("string_lists", "SELECT p_partkey, list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda x: trim(x)) AS parts, lower(p_brand) IN ('yes', 'true', 'on', '1') AS flag FROM part")
def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16, F18."""
    return table(spark, sf_dir, "part").select("p_partkey", X.to_list(F.replace("p_name", F.lit(" "), F.lit(" , "))).alias("parts"), X.to_bool("p_brand").alias("flag"))


@query("colour_literals", "SELECT p_partkey, p_size AS grey, p_size % 7 AS r, p_size % 5 AS g, p_size % 3 AS b FROM part")
def colour_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours are written as text and read again."""
    size = F.col("p_size")
    text = F.format_string("(%d, %d, %d)", size % 7, size % 5, size % 3)
    rgb, grey = X.colour_literal(text), X.colour_literal(size.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", grey["r"].alias("grey"), *[rgb[c].alias(c) for c in "rgb"])


@query("skip_spaces", r"SELECT doc_id, length(text) - length(regexp_replace(substr(text, 11), '^\s+', '')) AS at FROM documents")
def skip_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14."""
    return table(spark, sf_dir, "documents").select("doc_id", X.skip_whitespace("text", 10).cast("long").alias("at"))


@query("longest_words_first", "SELECT item_id, list_transform(list_sort(list_transform(range(1, len(w) + 1), lambda i: {'n': -length(w[i]), 'i': i})), lambda s: w[s.i]) AS words FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def longest_words_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By length, longest first, stable."""
    return table(spark, sf_dir, "benchmark").select("item_id", N.longest_first(F.split("text", " ")).alias("words"))


@query("xml_text_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(node, {_SPLIT})) AS token FROM (SELECT unnest(regexp_split_to_array(html, '<[^>]*>')) AS node FROM pages)) WHERE NOT ({_BLANK}) GROUP BY token")
def xml_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the text between marks, each text by itself."""
    nodes = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "<[^>]*>")).alias("node"))
    return nodes.select(F.explode(X.tokenise("node")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("xml_text_content", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '\r', chr(10), 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'), '\n{2,}', chr(10), 'g') AS text FROM pages")
def xml_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text content with white space in its plain form."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_whitespace(F.regexp_replace("html", "<[^>]*>", "")).alias("text"))


@query("extract_regex", r"""
WITH p AS (SELECT doc_id, text, string_split_regex(text, '[0-9]+(?s:.)?') AS between, regexp_extract_all(text, '[0-9]+') AS hits FROM documents),
v AS (SELECT doc_id, text, len(hits) AS n, flatten(list_transform(range(1, len(between) + 1), lambda i: list_concat(CASE WHEN between[i] <> '' THEN [trim(between[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))] ELSE [] END, CASE WHEN i <= len(hits) THEN [hits[i]] ELSE [] END))) AS l FROM p)
SELECT doc_id, CASE WHEN n = 0 THEN text WHEN len(l) = 1 THEN l[1] ELSE array_to_string(list_append(l, text), '|') END AS pieces FROM v""")
def extract_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of whole texts, what stands between them, and the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.extract_with_regex_udf("([0-9]+)")(F.col("text")), "|").alias("pieces"))
