"""Queries on page documents: XML targets, alignment, blocks, images, sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators import alignment, blocks, joins, targets
from folio.plans.catalog import query, table
from folio.plans.pipelines import feature_rows

MAPPING = {"article": {"title": "front/title", "abstract": "front/abstract", "author": "front/authors/author", "author.match-multiple": "true", "author.bonding": "true", "author.children": ".//*", "author.sub.surname": "./surname"}}


def article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of documents: the first words as a title, the first line as an abstract, authors by source."""
    text = F.regexp_replace("text", "[&<>\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")
    words = F.split(text, r"\s+")
    title, abstract = F.array_join(F.slice(words, 1, 6), " "), F.split(text, "\n")[0]
    xml = F.concat(F.lit("<article><front><title>"), title, F.lit("</title><abstract>"), abstract, F.lit("</abstract><authors><author><surname>"), F.col("source"), F.lit("</surname></author></authors></front></article>"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), xml.alias("xml"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '\t', ' ', 'g'), ' {2,}', ' ', 'g'), '\r', chr(10), 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'))"


@query("xml_targets", rf"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, regexp_replace(text, '[&<>\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS t FROM documents),
v AS (SELECT doc_id, 0 AS k, 'title' AS name, {_PLAIN % "array_to_string(regexp_split_to_array(t, '[ \\t\\n\\r\\x0b\\f]+')[1:6], ' ')"} AS value, false AS match_multiple FROM t
UNION ALL SELECT doc_id, 1, 'abstract', {_PLAIN % "string_split(t, chr(10))[1]"}, false FROM t UNION ALL SELECT doc_id, 2, 'author', source, true FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS target_ord, name, value, match_multiple, CAST(NULL AS VARCHAR) AS error FROM v WHERE value <> ''""")
def xml_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by the mapping."""
    return targets.targets(article_xml(spark, sf_dir), MAPPING).select("doc_id", "target_ord", "name", F.array_join("value", " | ").alias("value"), "match_multiple", "error")


_WHOLE = rf"trim(regexp_replace({_PLAIN}, '\n{{2,}}', chr(10), 'g'), ' ' || chr(10))"


@query("xml_whole_targets", rf"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[&<>\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS k, unnest(string_split(t, chr(10))) AS p FROM t),
v AS (SELECT doc_id, 0 AS k, 'body' AS name, {_WHOLE % "t"} AS value, false AS match_multiple FROM t UNION ALL SELECT doc_id, k, 'paragraph', {_WHOLE % "p"}, true FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS target_ord, name, value, match_multiple, CAST(NULL AS VARCHAR) AS error FROM v WHERE value <> ''""")
def xml_whole_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as nested bodies with a paragraph a line; the body and each paragraph are targets."""
    text = F.regexp_replace("text", "[&<>\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")
    paragraphs = F.array_join(F.transform(F.split(text, "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    xml = F.concat(F.lit("<article><body><sec>"), paragraphs, F.lit("</sec></body></article>"))
    mapping = {"article": {"body": "body", "paragraph": "body/sec/p", "paragraph.match-multiple": "true"}}
    found = targets.targets(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), mapping)
    return found.select("doc_id", "target_ord", "name", F.array_join("value", " | ").alias("value"), "match_multiple", "error")


_ESCAPED = "array_to_string(list_transform(string_split(replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ''), lambda c: CASE WHEN ord(c) > 127 THEN '&#' || ord(c) || ';' ELSE c END), '')"
#: XML of rows t (doc_id, turn, tag, text): single fields take the first item and those that follow one of their tag.
_XML = f"""l AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY doc_id, tag ORDER BY turn) AS k FROM t),
kept AS (SELECT doc_id, turn, tag, CASE WHEN tag = 'author' THEN regexp_replace(text, '(?:[,+*0-9][.]?)+$', '') ELSE text END AS text FROM l WHERE tag = 'author' OR k = 1 OR before = tag),
own AS (SELECT doc_id, tag, turn, {_ESCAPED % "text"} AS text FROM kept),
node AS (SELECT doc_id, min(turn) AS place, CASE tag WHEN 'author' THEN '<contrib-group>' || string_agg(CASE WHEN text = '' THEN '<contrib contrib-type="author" />' ELSE '<contrib contrib-type="author">' || text || '</contrib>' END, '' ORDER BY turn) || '</contrib-group>'
WHEN 'abstract' THEN CASE WHEN string_agg(text, chr(10) ORDER BY turn) = '' THEN '<abstract />' ELSE '<abstract>' || string_agg(text, chr(10) ORDER BY turn) || '</abstract>' END
ELSE '<title-group>' || CASE WHEN string_agg(text, chr(10) ORDER BY turn) = '' THEN '<article-title />' ELSE '<article-title>' || string_agg(text, chr(10) ORDER BY turn) || '</article-title>' END || '</title-group>' END AS x FROM own GROUP BY doc_id, tag),
made AS (SELECT doc_id, '<article><front><article-meta>' || string_agg(x, '' ORDER BY place) || '</article-meta></front></article>' AS xml FROM node GROUP BY doc_id)"""
_TURNS = r"t AS (SELECT conv_id AS doc_id, turn, CASE role WHEN 'system' THEN 'manuscript_title' WHEN 'user' THEN 'abstract' ELSE %s END AS tag, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS text FROM conversations%s)"


@query("items_xml", f"""WITH {_TURNS % ("'author'", "")}, {_XML} SELECT doc_id, xml FROM made""")
def items_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of conversations as XML: system turns as titles, the user's as abstracts, answers as authors."""
    role = F.col("role")
    tag = F.when(role == "system", "manuscript_title").when(role == "user", "abstract").otherwise("author")
    kind = "array<struct<sub_ord: long, tag: string, text: string>>"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("item_ord"), tag.alias("tag"), F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ").alias("text"), F.lit(None).cast(kind).alias("sub_items"))
    return targets.documents_xml(rows)


@query("match_statistics")
def match_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole turn aligned with the next of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(w)).where("next IS NOT NULL")
    rows = joins.dealt(rows.select("conv_id", "turn", "text", "next"))
    return rows.select("conv_id", "turn", alignment.match_stats(F.col("text"), F.col("next")).alias("m")).select("conv_id", "turn", "m.match_count", F.round("m.ratio", 9).alias("ratio"), F.round("m.b_gap_ratio", 9).alias("b_gap_ratio"))


@query("annotated_benchmark")
def annotated_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the benchmark's passages are tagged by the passage as the target."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), "text")
    lines = items.select("doc_id", F.posexplode(F.split("text", r"(?<=[.,] )")).alias("line_idx", "line"))
    rows = lines.select("doc_id", F.lit(0).alias("page_idx"), "line_idx", F.posexplode(F.split(F.trim("line"), " ")).alias("token_idx", "text")).withColumn("tag", F.lit(None).cast("string"))
    off, none = F.lit(False), F.array().cast("array<struct<name: string, value: array<string>>>")
    wanted = items.select("doc_id", F.lit(0).alias("target_ord"), F.lit("passage").alias("name"), F.array("text").alias("value"), off.alias("is_list"), off.alias("match_multiple"), off.alias("bonding"), off.alias("require_next"), none.alias("sub"))
    return alignment.annotate(rows, wanted)


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("int")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "lineitem").withColumn("doc_id", F.col("l_orderkey").cast("string"))
    lying = joins.dealt(rows, "doc_id")  # by document once: merging and painting need no other shuffle of blocks
    return lying.select("doc_id", F.lit(0).alias("page_idx"), o.alias("block_ord"), F.col("l_returnflag").alias("tag"), d(F.col("l_partkey") % 50).alias("x"), d(F.col("l_suppkey") % 20).alias("y"), d(F.col("l_quantity")).alias("width"), d(F.col("l_linenumber") * 3).alias("height"))


@query("merged_blocks", """WITH RECURSIVE b AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_returnflag AS tag, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS o,
CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 20 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, CAST(l_linenumber * 3 AS DOUBLE) AS h FROM lineitem),
g AS (SELECT doc_id, tag, list({'o': o, 'x1': x, 'y1': y, 'x2': x + w - 1, 'y2': y + h - 1} ORDER BY o) AS l FROM b GROUP BY doc_id, tag),
r AS (SELECT doc_id, tag, l[1] AS lead, l[2:] AS rest, CASE WHEN false THEN l[1] END AS done FROM g UNION ALL
SELECT doc_id, tag, CASE WHEN len(hit) = 0 THEN rest[1] ELSE {'o': lead.o, 'x1': least(lead.x1, list_min(list_transform(hit, lambda e: e.x1))), 'y1': least(lead.y1, list_min(list_transform(hit, lambda e: e.y1))), 'x2': greatest(lead.x2, list_max(list_transform(hit, lambda e: e.x2))), 'y2': greatest(lead.y2, list_max(list_transform(hit, lambda e: e.y2)))} END,
CASE WHEN len(hit) = 0 THEN rest[2:] ELSE list_filter(rest, lambda e: NOT (e.x1 <= lead.x2 + 1 AND e.x2 >= lead.x1 - 1 AND e.y1 <= lead.y2 AND e.y2 >= lead.y1)) END, CASE WHEN len(hit) = 0 THEN lead END
FROM (SELECT *, list_filter(rest, lambda e: e.x1 <= lead.x2 + 1 AND e.x2 >= lead.x1 - 1 AND e.y1 <= lead.y2 AND e.y2 >= lead.y1) AS hit FROM r WHERE lead IS NOT NULL))
SELECT doc_id, 0 AS page_idx, done.o AS block_ord, tag, done.x1 - 4 AS x, done.y1 - 2 AS y, done.x2 - done.x1 + 9 AS width, done.y2 - done.y1 + 5 AS height FROM r WHERE done IS NOT NULL""")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring boxes of an order's line items as one, then widened."""
    return blocks.expanded_blocks(blocks.merged_blocks(order_blocks(spark, sf_dir)))


@query("block_images")
def block_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of merged blocks as images, by their digest."""
    rows = order_blocks(spark, sf_dir)
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_idx")).distinct().withColumns({"width": F.lit(64.0), "height": F.lit(48.0)})
    images = blocks.block_images(blocks.merged_blocks(rows), pages, {"A": (255, 0, 0), "R": (0, 255, 0)}, (32, 24))
    return images.select("doc_id", "page_idx", F.md5("png").alias("digest"))


@query("sequence_predictions")
def sequence_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model learns on the benchmark's words which begin with t, and labels them."""
    from folio.operators import crf

    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(0).alias("line_idx"), F.posexplode(F.split("text", " ")).alias("token_idx", "text"))
    rows = feature_rows(words)
    label = F.when(F.element_at("features", "word[:1]") == "t", "b-t").otherwise("O")
    model = crf.fit(rows.withColumn("label", label))
    return crf.predictions(rows, model)


@query("untagged_lines_and_items", f"""WITH {_TURNS % ("NULL", " WHERE role IN ('system', 'user')")}, {_XML} SELECT doc_id, coalesce(xml, '<article />') AS xml FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) LEFT JOIN made USING (doc_id)""")
def untagged_lines_and_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of conversations as tags: items, then XML by document."""
    from folio.plans.pipelines import extracted_xml

    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("turn").cast("int").alias("line_idx"), F.lit(0).alias("token_idx"), F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ").alias("text"), F.when(F.col("role") == "user", "b-abstract").when(F.col("role") == "system", "b-manuscript_title").alias("tag"))
    return extracted_xml(lines)


@query("saved_model_predictions", """SELECT item_id AS doc_id, (k - 1)::BIGINT AS ord, CASE WHEN w[1:1] = 't' THEN 'b-t' ELSE 'O' END AS prediction FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM benchmark)""")
def saved_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence model is saved, loaded by its path, and labels the words of the benchmark."""
    import numpy as np

    from folio.operators import crf
    from folio.sources.shared import new_path

    model = crf.Crf(["O", "b-t"], {"word[:1]=t": 0}, np.array([[-1.0, 1.0]]), np.zeros((2, 2)))
    path = new_path(spark, "model")
    crf.save(spark, model.to_json(), path)
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(0).alias("line_idx"), F.posexplode(F.split("text", " ")).alias("token_idx", "text"))
    return crf.predictions(feature_rows(words), crf.load(spark, path))


@query("values_cut_out", """SELECT s_suppkey, 'a' || s_suppkey AS given, s_suppkey::VARCHAR AS value, repeat('_', 7) || repeat('x', length(s_suppkey::VARCHAR) + 6) || repeat('_', 5) AS labels FROM supplier""")
def values_cut_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a character model cuts out of a text, and which characters of a text a value matches."""
    import numpy as np

    from folio.operators import crf

    digits = crf.Crf(["_", "x"], {"ch.isdigit": 0}, np.array([[-1.0, 1.0]]), np.zeros((2, 2)))
    s = F.col("s_suppkey").cast("string")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("a"), s).alias("given"), F.concat(F.lit("key #-"), s).alias("wanted"))
    labels = crf.aligned_labels(F.col("wanted"), F.concat(F.lit("some - "), F.col("wanted"), F.lit(" more")))
    return rows.select("s_suppkey", "given", crf.autocut_column(digits.to_json())("given").alias("value"), labels.alias("labels"))


@query("values_over_gaps", """WITH s AS (SELECT s_suppkey, s_suppkey % 9 AS k FROM supplier), t AS (SELECT s_suppkey::VARCHAR AS doc_id, 0 AS line_idx, j::INT AS token_idx, CASE WHEN j = 0 THEN 'b-part' ELSE 'i-part' END AS tag FROM s, range(3) r(j)
UNION ALL SELECT s_suppkey::VARCHAR, (k + 1)::INT, j::INT, 'i-part' FROM s, range(3) r(j) WHERE k + 1 <= 6) SELECT * FROM t""")
def values_over_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value in two lines is matched over at most five lines between them."""
    k = F.col("s_suppkey") % 9
    lines = F.concat(F.array(F.lit("wonderful quartz jump")), F.array_repeat(F.lit("0000"), k.cast("int")), F.array(F.lit("black vex sphinx")))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.posexplode(lines).alias("line_idx", "line"))
    rows = rows.select("doc_id", F.lit(0).alias("page_idx"), "line_idx", F.posexplode(F.split("line", " ")).alias("token_idx", "text")).withColumn("tag", F.lit(None).cast("string"))
    off, none = F.lit(False), F.array().cast("array<struct<name: string, value: array<string>>>")
    wanted = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("target_ord"), F.lit("part").alias("name"), F.array(F.lit("wonderful quartz jump black vex sphinx")).alias("value"))
    found = alignment.annotate(rows, wanted.withColumns({"is_list": off, "match_multiple": off, "bonding": off, "require_next": off, "sub": none}))
    return found.select("doc_id", "line_idx", "token_idx", "tag")
