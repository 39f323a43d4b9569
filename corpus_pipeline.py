"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
Nulls: a document without words fails the quality rules, a null source is a source of its own, other columns are carried.
Rows that repeat share an id, and are kept or dropped together. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import common, mixing, near_dups, quality, suffix_dedup, tokens
from folio.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees, fitted on this corpus's labels, keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group linked by 5-word shingles at 0.8."""
    return near_dups.without_duplicates(docs, size=5, similarity=0.8)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes that occur elsewhere; a document may be left with an empty text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    return tokens.token_digests(docs, *vocabulary())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", no_repeated_passages),
    ("mix", mixed),
    ("tokens", token_ids),
]

#: Boosted trees, signatures and suffixes are not for SQL; tests/llm/test_pipeline_plain.py holds run() and each stage against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table goes once the next one is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        before, path = path, common.write_table(out, name)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.drop_table(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
