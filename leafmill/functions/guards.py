"""Checks inside a plan: a row that breaks one ends the job with a code, before anything of it is committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def required(value: Column, ok: Column, code: str, message: Column | str) -> Column:
    """``value`` where ``ok`` is true; else (false or null) the job ends with ``code: message``."""
    said = F.concat(F.lit(f"{code}: "), F.lit(message) if isinstance(message, str) else F.coalesce(message, F.lit("")))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(said))


def guarded(rows: DataFrame, ok: Column, code: str, message: Column | str) -> DataFrame:
    """The rows, if all of them are ``ok``."""
    return rows.where(required(F.lit(True), ok, code, message))


def page_count(count: Column) -> Column:
    """A page count that is one; a document without pages ends the job."""
    return required(count, count > 0, "FILE_CORRUPT", "the document has no pages")


def valid_output(content: Column, error: Column) -> Column:
    """Written bytes that nothing is wrong with (``error`` is null)."""
    return required(content, error.isNull(), "OUTPUT_INVALID", error)


def redaction_plan(documents: DataFrame, regions: DataFrame, rasters: DataFrame) -> DataFrame:
    """The marked regions (doc_id, page_number, ...) with the rasters (doc_id, page_number, raster) that will replace their pages.

    A document (doc_id) without any region, or a region whose page has no raster, ends the job."""
    page = ["doc_id", "page_number"]
    some = documents.select("doc_id").distinct().join(regions, "doc_id", "left")
    some = guarded(some, F.col("page_number").isNotNull(), "INVALID_INPUT", "mark at least one area to redact")
    one = rasters.select(*page, "raster").withColumn("_n", F.row_number().over(Window.partitionBy(*page).orderBy("raster"))).where("_n = 1").drop("_n")
    met = some.join(one, page, "left")
    missing = F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(" is missing its rendered image"))
    return guarded(met, F.col("raster").isNotNull(), "INVALID_INPUT", missing)
