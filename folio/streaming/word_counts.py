"""Word counts over a stream of document files: the batch operators on ``readStream``, with counts kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions import text as X


def counts(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """token, n over the Parquet files that arrive under ``path``. State grows with the vocabulary, not with documents."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.explode(X.tokenise("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def start(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run what has arrived and stop; state is in the shared checkpoint folder, so a new start goes on from there."""
    return df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
