"""Outputs: tables as text, pages as zips, documents as files, JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as X


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited text with a header: word counts, evaluation rows, debug rows."""
    df.write.option("sep", sep).option("header", True).csv(path)


def write_word_counts(counts: DataFrame, path: str, by_count: bool = False) -> None:
    order = [F.desc("count"), F.asc("token")] if by_count else [F.asc("token")]
    write_table(counts.select("token", "count").orderBy(*order), path)


def write_lines(lines: DataFrame, path: str, column: str = "value", compression: str | None = None) -> None:
    """Lines without white space at their ends."""
    df = lines.select(X.rstrip(column).alias("value"))
    (df.write.option("compression", compression) if compression else df.write).text(path)


def write_json(df: DataFrame, path: str, column: str = "json") -> None:
    df.select(F.col(column).alias("value")).write.text(path)


def zipped_pages(pages: DataFrame, extension: str, content: str = "content") -> DataFrame:
    """doc_id, zip: a document's pages as ``page-1<ext>`` and so on in a deflated archive."""
    one = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", F.col(content).cast("binary").alias("c")))).alias("p"))

    @F.udf("binary", useArrow=True)
    def run(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for k, p in enumerate(parts, 1):
                info = zipfile.ZipInfo(f"page-{k}{extension}", (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, bytes(p["c"]))
        return out.getvalue()

    return one.select("doc_id", run("p").alias("zip"))


def write_files(df: DataFrame, root: str, name: Column, content: Column) -> DataFrame:
    """A file for each row under a shared folder: path, bytes. Written beside its place and moved, so a second run of a
    task leaves one file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            paths, sizes = [], []
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{base}/{n}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(own, compression="gzip" if n.endswith(".gz") else None) as f:
                    f.write(data)
                if store.get_file_info(path).type != fs.FileType.NotFound:  # some stores don't replace
                    store.delete_file(path)
                store.move(own, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return df.select(name.alias("name"), content.cast("binary").alias("content")).mapInArrow(rows, "path string, bytes long")


def page_records(pages: DataFrame) -> DataFrame:
    """Training records of pages (source_filename, xml_filename, page_no, png, blocks)."""
    return pages.select(X.page_uri(F.col("source_filename"), F.col("page_no")).alias("input_uri"), X.page_uri(F.col("source_filename"), F.col("page_no"), True).alias("annotation_uri"), F.col("png").alias("input_image"), F.col("blocks").alias("annotation_image"), F.col("page_no").cast("long").alias("page_no"))
