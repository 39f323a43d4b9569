"""Queries that write files to the shared folder and read them back: sources and sinks on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import targets, weights
from folio.plans.catalog import query, table
from folio.plans.text_queries import TOKENS, document_tokens
from folio.sources import documents, files, sinks, tfrecord
from folio.sources.shared import new_path as scratch


@query("written_vocabulary", f"SELECT DISTINCT token FROM {TOKENS} WHERE token <> '\"'")
def written_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words as a table of text, and its tokens read back; quotes, which the format uses, aside."""
    path = scratch(spark, "counts")
    counts = document_tokens(spark, sf_dir).where("token <> '\"'").groupBy("token").agg(F.count("*").alias("count"))
    sinks.write_word_counts(counts, path, by_count=True)
    return files.vocabulary(spark, path)


@query("written_embeddings", "SELECT rtrim(source || ' ' || doc_id || ' ' || lang || '  ', ' ') AS value, source AS token FROM documents")
def written_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in packed files, without white space at their ends; read back with their first token."""
    path = scratch(spark, "lines")
    sinks.write_lines(table(spark, sf_dir, "documents").select(F.concat("source", F.lit(" "), "doc_id", F.lit(" "), "lang", F.lit("  ")).alias("value")), path, compression="gzip")
    return files.embedding_lines(spark, path)


@query("written_pairs", "SELECT 'a/' || o_orderkey || '.pdf' AS source_url, 'a/' || o_orderkey || '.xml' AS xml_url FROM orders")
def written_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of pairs of files, written and read."""
    path = scratch(spark, "pairs") + ".tsv"
    name = F.concat(F.lit("a/"), F.col("o_orderkey").cast("string"))
    sinks.write_table(table(spark, sf_dir, "orders").select(F.concat(name, F.lit(".pdf")).alias("source_url"), F.concat(name, F.lit(".xml")).alias("xml_url"), "o_orderpriority"), path)
    return files.listed_pairs(spark, path)


@query("written_list", "SELECT 'b/' || o_custkey || '/' || o_orderkey || '.pdf' AS pdf_url FROM orders")
def written_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of a list of files."""
    path = scratch(spark, "list") + ".csv"
    name = F.concat(F.lit("b/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    sinks.write_table(table(spark, sf_dir, "orders").select(name.alias("pdf_url"), "o_orderdate"), path, ",")
    return files.listed_files(spark, path, "pdf_url")


@query("packed_or_plain_files", "SELECT item_id, md5(text) AS digest FROM benchmark UNION ALL SELECT item_id + 1000000, NULL FROM benchmark")
def packed_or_plain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an item, every other one packed; asked for by its plain name, with names that are not there."""
    root = scratch(spark, "files")
    rows = table(spark, sf_dir, "benchmark")
    name = F.concat(F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".txt.gz").otherwise(".txt"))
    sinks.write_files(rows, root, name, F.col("text")).write.format("noop").mode("overwrite").save()
    ids = rows.select("item_id").union(rows.select(F.col("item_id") + 1000000))
    asked = ids.select("item_id", F.concat(F.lit(f"{root}/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.with_gz_fallback(asked).select("item_id", F.md5("content").alias("digest"))


def layout_xml(spark: SparkSession, sf_dir: str, tag: str = "") -> DataFrame:
    """Passages as layout documents: a line for each five words, a token a word; the first of a line may have a tag."""
    clean = F.regexp_replace("text", "[&<>\"]", "")
    words = F.filter(F.split(clean, " "), lambda w: w != "")
    token = lambda w, k: F.concat(F.lit('<TOKEN x="'), (k % 5 * 10).cast("string"), F.lit('" y="'), F.floor(k / 5).cast("string"), F.when(k % 5 == 0, F.lit(f'" width="8" height="1"{tag}>')).otherwise('" width="8" height="1">'), w, F.lit("</TOKEN>"))
    line = lambda n: F.concat(F.lit("<TEXT>"), F.array_join(F.transform(F.slice(words, n * 5 + 1, 5), lambda w, k: token(w, k + n * 5)), ""), F.lit("</TEXT>"))
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 5).cast("int")), line), "")
    xml = F.concat(F.lit('<DOCUMENT><PAGE width="50" height="90"/><PAGE width="60" height="80">'), lines, F.lit("</PAGE></DOCUMENT>"))
    return table(spark, sf_dir, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".lxml")).alias("path"), F.encode(xml, "UTF-8").alias("content"))


_WORDS = """w AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '[&<>"]', '', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
t AS (SELECT item_id, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS k FROM w)"""


@query("layout_documents", f"WITH {_WORDS} SELECT item_id || '.lxml' AS doc_id, 1 AS page_idx, CAST(k // 5 AS INT) AS line_idx, CAST(k % 5 AS INT) AS token_idx, text, CAST(k % 5 * 10 AS DOUBLE) AS x, CAST(k // 5 AS DOUBLE) AS y, 60.0::DOUBLE AS page_width FROM t")
def layout_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout XML to token rows; the first page, which is empty, is left out by number."""
    rows = documents.tokens(layout_xml(spark, sf_dir), (2, 2))
    return rows.select("doc_id", "page_idx", "line_idx", "token_idx", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), "page_width")


@query("svg_page_zips", f"WITH {_WORDS} SELECT item_id || '.lxml.svg.zip' AS doc_id, 0 AS page_idx, CAST(k // 5 AS INT) AS line_idx, CAST(k % 5 AS INT) AS token_idx, text, CAST(k % 5 * 10 AS DOUBLE) AS x, 8.0::DOUBLE AS width, 80.0::DOUBLE AS page_height FROM t")
def svg_page_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout documents to SVG pages in zips, and these to token rows."""
    pages = documents.svg_pages(documents.tokens(layout_xml(spark, sf_dir)))
    zips = sinks.zipped_pages(pages, ".svg", "svg").select(F.concat("doc_id", F.lit(".svg.zip")).alias("path"), F.col("zip").alias("content"))
    return documents.tokens(zips).select("doc_id", "page_idx", "line_idx", "token_idx", "text", F.col("bbox.x").alias("x"), F.col("bbox.width").alias("width"), "page_height")


@query("tfrecord_round_trip", "SELECT 'u/' || doc_id AS input_uri, md5(text) AS digest, n_chars AS page_no FROM documents")
def tfrecord_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as packed records of examples, and back."""
    path = scratch(spark, "records")
    spark.dataSource.register(tfrecord.TfRecordSource)
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("input_uri"), F.encode("text", "UTF-8").alias("input_image"), F.col("n_chars").cast("long").alias("page_no"))
    rows.write.format("tfrecord").mode("append").save(path)
    back = spark.read.format("tfrecord").schema("input_uri string, input_image binary, page_no long").load(path)
    return tfrecord.training_examples(back).select("input_uri", F.md5("input_image").alias("digest"), "page_no")


@query("tfrecord_keys", "SELECT count(*) AS records, 'input_image,input_uri,page_no' AS names FROM benchmark")
def tfrecord_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of records, and the features of the first."""
    path = scratch(spark, "records")
    spark.dataSource.register(tfrecord.TfRecordSource)
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("input_uri"), F.encode("text", "UTF-8").alias("input_image"), F.lit(1).cast("long").alias("page_no"))
    rows.write.format("tfrecord").mode("append").save(path)
    back = spark.read.format("tfrecord").load(path)
    return back.agg(F.count("*").alias("records")).withColumn("names", F.lit(",".join(back.columns)))


@query("written_class_weights", """WITH f AS (SELECT event_type AS label, count(*)::DOUBLE AS n FROM events GROUP BY 1), s AS (SELECT sum(n) AS total FROM f)
SELECT label, round(1 / ln(1.02 + n / total), 9) AS weight FROM f, s""")
def written_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class weights as a JSON file, and as a table again."""
    path = scratch(spark, "weights")
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").cast("double").alias("frequency"))
    sinks.write_json(weights.as_json(weights.enet_weights(counts)), path)
    found = spark.read.text(path).select(F.explode(F.from_json("value", "map<string, double>")).alias("label", "weight"))
    return found.select("label", F.round("weight", 9).alias("weight"))


_INI = """
[article]
Title = front/title
body = body/p
body.regex = ^(?:\\s*)([A-Za-z]+)
"""


@query("lenient_xml", r"""WITH t AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, item_id % 7 = 0 AS bad, trim(regexp_replace(regexp_replace(text, '[&<>\x00-\x1f]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM benchmark)
SELECT doc_id, 'title' AS name, trim(chr(8224) || ' ' || t) AS value, false AS failed FROM t WHERE NOT bad UNION ALL SELECT doc_id, 'body', coalesce(nullif(regexp_extract(t, '^([A-Za-z]+)', 1), ''), t), false FROM t WHERE NOT bad UNION ALL SELECT doc_id, NULL, NULL, true FROM t WHERE bad""")
def lenient_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space before the XML, an entity that it does not declare, a mapping from INI text, and documents that can't be read."""
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "[&<>\\x00-\\x1f]", " "), " +", " "))
    xml = F.concat(F.lit("  \n<article><front><title>&dagger; "), text, F.lit("</title></front><body><p>"), text, F.when(F.col("item_id") % 7 == 0, "</body>").otherwise("</p></body>"), F.lit("</article>"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), xml.alias("xml"))
    found = targets.targets(rows, targets.parse_mapping(_INI))
    return found.select("doc_id", "name", F.array_join("value", "|").alias("value"), F.col("error").isNotNull().alias("failed"))


@query("styled_pages", f"WITH {_WORDS} SELECT item_id || '.lxml' AS doc_id, count(*) AS titles, 'text.b-lead {{ fill: ' AS style FROM t WHERE k % 5 = 0 GROUP BY item_id")
def styled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SVG pages with a style for each tag and a title for each tagged token."""
    pages = documents.svg_pages(documents.tokens(layout_xml(spark, sf_dir, ' tag="b-lead"')))
    styled = pages.select("doc_id", F.udf(documents.styled_svg, "string", useArrow=True)("svg").alias("svg"))
    return styled.select("doc_id", F.regexp_count("svg", F.lit("<title>b-lead</title>")).cast("long").alias("titles"), F.regexp_extract("svg", r"text\.b-lead \{ fill: ", 0).alias("style"))


@query("items_with_errors", "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'fr'")
def items_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that have no output yet, with a computed key; those that fail are counted and dropped."""
    from folio.plans.pipelines import ItemPipeline

    process = lambda df: df.withColumns({"digest": F.md5("text"), "error": F.when(F.col("lang") == "fr", F.lit("no reader for fr"))})
    name = F.concat(F.lit("out/"), F.col("doc_id").cast("string"))
    done = table(spark, sf_dir, "labels").select(name.alias("path"))
    return ItemPipeline(process, lambda: name).run(table(spark, sf_dir, "documents"), done).select("doc_id", "digest")


@query("cropped_images", "SELECT vec_id, CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN i % 8 BETWEEN 2 AND 6 AND i // 8 BETWEEN 1 AND 3 THEN least(255, floor(abs(embedding[i + 1]::DOUBLE) * 255)) ELSE 0 END)) AS BIGINT) AS total FROM embeddings")
def cropped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 8 by 8, cropped, and their pixels summed."""
    import numpy as np

    from folio.functions.raster import crop, encode_png
    from folio.operators import raster

    @F.udf("binary", useArrow=True)
    def painted(v):
        return encode_png(np.minimum(255, np.floor(np.abs(np.array(v[:64], np.float64)) * 255)).astype(np.uint8).reshape(8, 8))

    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), painted("embedding").alias("png"))
    rows = raster.pixels(raster.mapped_images(images, lambda a: crop(a, 2, 1, 5, 3)))
    return rows.groupBy(F.col("image_id").cast("long").alias("vec_id")).agg(F.sum("r").cast("long").alias("total"))


@query("xml_paths", r"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[&<>\x00-\x08\x0b-\x1f]', '', 'g'), chr(10)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, array_to_string(l, chr(10)) AS value FROM t""")
def xml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a path selects in XML of whole documents, a line each."""
    lines = F.split(F.regexp_replace("text", "[&<>\\x00-\\x08\\x0b-\\x1f]", ""), "\n")
    xml = F.concat(F.lit("<d>"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit("</d>"))
    return files.xml_values(table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml")), "/d/p").select("doc_id", "value")


@query("flattened", "SELECT l_orderkey, l_linenumber, array_to_string(flatten([[l_partkey, l_suppkey], [], [l_orderkey]]), ',') AS flat FROM lineitem")
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lists as one."""
    c = lambda n: F.col(n).cast("string")
    nested = F.array(F.array(c("l_partkey"), c("l_suppkey")), F.array().cast("array<string>"), F.array(c("l_orderkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.flatten(nested), ",").alias("flat"))
