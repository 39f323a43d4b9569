"""Files and lists of files: contents, pairs, vocabularies, embeddings, settings."""

from __future__ import annotations

import configparser
import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as X
from folio.operators import joins


def matching(spark: SparkSession, *patterns: str, content: bool = False) -> DataFrame:
    """path (and content) of the files that any of the patterns match. Without ``content`` no file is opened."""
    found = spark.read.format("binaryFile").load(list(patterns))
    return found.select("path", "content") if content else found.select("path")


def file_pairs(spark: SparkSession, sources: str, xmls: str, by: str = "directory", limit: int | None = None) -> DataFrame:
    return joins.file_pairs(matching(spark, sources), matching(spark, xmls), by, limit)


def listed_files(spark: SparkSession, path: str, column: str = "url", limit: int | None = None) -> DataFrame:
    """A file list: one path a line, or a column of a CSV or TSV file by its extension."""
    bare = path.removesuffix(".gz")
    if bare.endswith((".csv", ".tsv")):
        rows = spark.read.option("header", True).option("sep", "\t" if bare.endswith(".tsv") else ",").csv(path).select(column)
    else:
        rows = spark.read.text(path).select(F.col("value").alias(column)).where(f"trim({column}) <> ''")
    return rows.limit(limit) if limit else rows


def listed_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """source_url and xml_url of a list of pairs."""
    rows = spark.read.option("header", True).option("sep", "\t" if path.removesuffix(".gz").endswith(".tsv") else ",").csv(path).select("source_url", "xml_url")
    return rows.limit(limit) if limit else rows


def opened(files: DataFrame, column: str, name: str, endings: tuple[str, ...]) -> DataFrame:
    """``files`` with what is in the file that a column names, with the first of ``endings`` that is there; null if none is.

    Tasks open the files of their own rows through ``pyarrow.fs``, so no list of files passes through the driver.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index(column)
            for k in range(len(b)):
                cut = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array([_content(cut.column(at)[0].as_py(), endings)], pa.binary())], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(rows, f"{fields}, `{name}` binary")


def _content(path: str | None, endings: tuple[str, ...]) -> bytes | None:
    for ending in endings if path else ():
        store, place = fs.FileSystem.from_uri(path + ending)
        if store.get_file_info(place).is_file:
            with store.open_input_stream(place, compression=None) as f:
                data = f.read()
            return gzip.decompress(data) if ending == ".gz" else data
    return None


def contents(files: DataFrame, column: str, name: str = "content") -> DataFrame:
    """``files`` with the content of the file that a column names, as it is."""
    return opened(files, column, name, ("",))


def gunzipped(content, path):
    """A content column, unpacked if the path ends in .gz (binary files are not unpacked by the reader)."""

    @F.udf("binary", useArrow=True)
    def run(data, name):
        return gzip.decompress(bytes(data)) if data is not None and name.endswith(".gz") else data

    return run(content, path)


def with_gz_fallback(files: DataFrame, column: str = "path") -> DataFrame:
    """Content of ``<path>.gz``, unpacked, where there is one, else of ``<path>``, null where neither is."""
    return opened(files, column, "content", (".gz", ""))


def embedding_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, token: lines of an embeddings file (gz or not), empty ones left out."""
    return spark.read.text(path).where("value <> ''").withColumn("token", X.first_token("value"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token: distinct tokens of a word-count table; words such as NA are words."""
    rows = spark.read.option("header", True).option("sep", "\t").option("nullValue", "").csv(path)
    return rows.select("token").dropna().distinct()


def parse_colour_map(ini: str) -> dict[str, tuple[int, int, int]]:
    """Tags to colours from INI text: ``tag = n`` or ``tag = (r, g, b)``; tags come in lower case."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(ini)
    out = {}
    for section in parser.sections():
        for tag, value in parser.items(section):
            parts = [int(v) for v in value.strip().strip("()").split(",")]
            out[tag] = (parts[0],) * 3 if len(parts) == 1 else tuple(parts)
    return out


def colour_table(spark: SparkSession, colours: dict[str, tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, t, *c) for k, (t, c) in enumerate(colours.items())], "ordinal int, label string, r int, g int, b int")


def json_file(text: str) -> dict:
    return json.loads(text)


def xml_values(files: DataFrame, xpath: str, xml_col: str = "xml") -> DataFrame:
    """Text of what a path selects, joined by line feeds: the built-in function, for paths it knows."""
    return files.withColumn("value", F.array_join(F.xpath(F.col(xml_col), F.lit(f"{xpath}//text()")), "\n"))
