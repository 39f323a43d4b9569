"""The registered queries of the training-data operators, and their SQL where SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.chat import fit, parse_transcripts, transcripts

    turns = table(spark, sf_dir, "conversations")
    return parse_transcripts(transcripts(turns), fit(turns), ["conv_id", "true_roles"])


def vocabulary() -> tuple[str, str]:
    """The vocabulary file, and the pattern that cuts texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.token_files import tokens_of_documents

    return tokens_of_documents(table(spark, sf_dir), vocabulary()[0])


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir)).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))


def op5_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir), size=2, similarity=0.8)


def op6_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.tokens import token_digests

    return token_digests(table(spark, sf_dir), *vocabulary())


def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.quality import assess, fit

    docs = table(spark, sf_dir)
    return assess(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.media import media_columns

    out = media_columns(table(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")


def op9_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.suffix_dedup import removed

    return removed(table(spark, sf_dir))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.toxicity import fit, score

    docs = table(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_swap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.audit import audit_documents

    return audit_documents(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_heavy_path_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from folio.llm.sql import ORACLE

    return dict(ORACLE)
