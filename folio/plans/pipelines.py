"""Whole jobs: items to outputs with resume, building training data, converting documents to XML."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folio.functions import tags as T
from folio.operators import alignment, blocks, crf, evaluation, features, islands, joins, line_numbers, targets
from folio.operators import tokens as tokens_ops
from folio.sources import documents


@dataclass
class ItemPipeline:
    """Items that have no output yet, put through ``process`` (DataFrame to DataFrame with an ``error`` column).

    With ``skip_errors`` rows with errors are set aside and counted; without it the first of them raises.
    """

    process: Callable[[DataFrame], DataFrame]
    output: Callable[[], object]
    resume: bool = True
    skip_errors: bool = True
    counts: Observation | None = field(default=None)

    def remaining(self, items: DataFrame, outputs: DataFrame) -> DataFrame:
        return joins.without_output(items, outputs, self.output()) if self.resume else items

    def run(self, items: DataFrame, outputs: DataFrame) -> DataFrame:
        self.counts = Observation()
        done = self.process(self.remaining(items, outputs))
        failed = F.col("error").isNotNull()
        done = done.observe(self.counts, F.count("*").alias("items"), F.coalesce(F.sum(failed.cast("long")), F.lit(0)).alias("errors"))
        if self.skip_errors:
            return done.where(~failed).drop("error")
        checked = F.when(failed, F.raise_error(F.col("error")).cast("string")).otherwise(F.lit(None).cast("string"))
        return done.withColumn("error", checked).where("error IS NULL").drop("error")


def annotated_tokens(token_rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Tokens with tags from line numbers and targets: tag, sub_tag. Native steps first, the matcher last."""
    clean = token_rows.where("error IS NULL").withColumns({"tag": T.get_tag("tags"), "x": F.coalesce(F.col("bbox.x"), F.col("x_raw").try_cast("double"))})
    keys = ["doc_id", "page_idx", "line_idx", "token_idx"]
    numbers = line_numbers.line_numbers(clean.where("x IS NOT NULL")).select(*keys, F.lit("b-line_no").alias("_line_no"))
    numbered = clean.join(numbers, keys, "left").withColumn("tag", F.coalesce("tag", "_line_no")).drop("_line_no")
    found = alignment.annotate(numbered, target_rows).select(*keys, F.col("tag").alias("_tag"), "sub_tag")
    return numbered.join(found, keys, "left").withColumn("tag", F.coalesce("tag", "_tag")).drop("_tag", "x")


def training_data(pairs: DataFrame, mapping: dict, colours: dict[str, tuple[int, int, int]], least: float = 0.0, pages: tuple[int, int] | None = None, size: tuple[int, int] | None = None) -> dict[str, DataFrame]:
    """From pairs (source_url, lxml, xml): tokens with tags, shares of tags, and block images of pages tagged enough."""
    token_rows = documents.tokens(pairs.select(F.col("source_url").alias("path"), F.col("lxml").alias("content")), pages)
    target_rows = targets.targets(pairs.select(F.col("source_url").alias("doc_id"), F.col("xml").cast("string").alias("xml")), mapping)
    tagged = annotated_tokens(token_rows, target_rows)
    shares = evaluation.tag_shares(tagged)
    kept = evaluation.pages_with_tags(shares, least)
    sizes = documents.pages(token_rows).join(kept, ["doc_id", "page_idx"], "left_semi")
    merged = blocks.expanded_blocks(blocks.merged_blocks(blocks.token_blocks(tagged)))
    images = blocks.block_images(merged, sizes, colours, size)
    return {"tokens": tagged, "evaluation": shares, "images": images, "errors": token_rows.where("error IS NOT NULL").select("doc_id", "error")}


def feature_rows(token_rows: DataFrame) -> DataFrame:
    """doc_id, ord, features of tokens for sequence models, in document order."""
    own = features.token_context(token_rows.select("doc_id", "page_idx", "line_idx", "token_idx", "text"))
    names = [c for c in own.columns if c not in ("doc_id", "page_idx", "line_idx", "token_idx", "text")]
    packed = own.withColumn("features", features.feature_map({n: F.col(f"`{n}`") for n in names}))
    return tokens_ops.with_ordinal(packed, "ord").select("doc_id", F.col("ord").cast("long").alias("ord"), "features")


def with_crf_tags(token_rows: DataFrame, model: str) -> DataFrame:
    """Tokens with ``crf_tag`` from a trained model."""
    found = crf.predictions(feature_rows(token_rows), model).withColumnRenamed("ord", "doc_ord")
    return joins.with_predictions(token_rows, found)


def extracted_xml(token_rows: DataFrame, tag: str = "tag") -> DataFrame:
    """doc_id, xml: items of tagged tokens as article XML, with second-level items where tokens have a ``sub_tag``."""
    rows = token_rows if "sub_tag" in token_rows.columns else token_rows.withColumn("sub_tag", F.lit(None).cast("string"))
    items = islands.items(rows, tag)
    subs = islands.sub_items(rows, tag, "sub_tag").where("sub_tag <> ''")
    one = subs.groupBy("doc_id", "item_ord").agg(F.array_sort(F.collect_list(F.struct("sub_ord", F.col("sub_tag").alias("tag"), "text"))).alias("sub_items"))
    return targets.documents_xml(items.join(one, ["doc_id", "item_ord"], "left").select("doc_id", "item_ord", "tag", "text", "sub_items"))


def converted(files: DataFrame, model: str | None = None, cv: tuple[DataFrame, dict] | None = None, cv_model: str | None = None) -> DataFrame:
    """Layout files to XML: tags of the documents themselves, else those of page images, and over them the sequence model's.

    ``cv`` has page images and the colours of tags; with ``cv_model`` (an artifact) the images are what the model makes of
    them, and pages that it fails on have no image tags.
    """
    from folio.operators import inference, raster

    rows = documents.tokens(files)
    good = rows.where("error IS NULL").withColumn("tag", T.get_tag("tags"))
    keys = ["doc_id", "page_idx", "line_idx", "token_idx"]
    if cv is not None:
        images, colours = cv
        if cv_model is not None:
            images = inference.predicted_images(images, cv_model, list(colours.values())).where("error IS NULL").drop("error")
        found = raster.annotate_by_images(good, images, documents.pages(rows), colours).select(*keys, "cv_tag")
        good = good.join(found, keys, "left").withColumn("tag", F.coalesce("cv_tag", "tag"))
    if model is not None:
        good = with_crf_tags(good, model).withColumn("tag", F.coalesce("crf_tag", "tag"))
    return extracted_xml(good)
