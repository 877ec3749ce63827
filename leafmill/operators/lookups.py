"""Joins, filters and sums between documents, pages and what belongs to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import named_output, output_stem

PAGE = ["doc_id", "page_number"]
#: The languages that recognition knows, and the kinds of editor objects that hold text.
LANGUAGES, TEXTUAL = ("eng", "spa"), ("text", "replace-text")
#: What a slide's parts are counted by.
SLIDE_MARKS = {"gradients": "<a:gradFill", "groups": "<p:grpSp>", "frames": "<p:graphicFrame", "transitions": "<p:transition"}


def recognised_items(items: DataFrame, recognised: DataFrame) -> DataFrame:
    """The items of every page, or those of its recognition where a page has any (same columns)."""
    return items.join(recognised.select(*PAGE).distinct(), PAGE, "left_anti").unionByName(recognised)


def pages_with_rasters(pages: DataFrame, rasters: DataFrame) -> DataFrame:
    """Every page with its raster (doc_id, page_number, raster), null where it has none."""
    return pages.join(rasters.select(*PAGE, "raster"), PAGE, "left")


def regions_without_raster(regions: DataFrame, rasters: DataFrame) -> DataFrame:
    """The marked regions on pages that have no raster; a redaction must not go on while there are any."""
    return regions.join(rasters.select(*PAGE).distinct(), PAGE, "left_anti")


def region_totals(regions: DataFrame) -> DataFrame:
    """doc_id, regions, pages: how many regions are marked, on how many pages."""
    return regions.groupBy("doc_id").agg(F.count("*").alias("regions"), F.countDistinct("page_number").alias("pages"))


def objects_with_images(objects: DataFrame, images: DataFrame) -> DataFrame:
    """Editor objects (image_ref) with their images (image_ref, image); those whose image is missing go."""
    return objects.join(images.select("image_ref", "image"), "image_ref")


def blocks_with_rows(blocks: DataFrame, tables: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Blocks with the rows of the tables they name: empty where a table is missing, or without such blocks."""
    rows = tables.select(*PAGE, "table_id", "rows")
    if not keep_missing:
        return blocks.where("table_id is null").withColumn("rows", F.lit(None).cast(rows.schema["rows"].dataType)).unionByName(blocks.join(rows, [*PAGE, "table_id"]), allowMissingColumns=True)
    return blocks.join(rows, [*PAGE, "table_id"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))


def chosen(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The rows of the named sheets or slides; all where no name is given."""
    return rows.where(F.col(column).isin(names)) if names else rows


def known_language(code: Column) -> Column:
    return F.coalesce(code.isin(*LANGUAGES), F.lit(False))


def is_textual(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TEXTUAL), F.lit(False))


def tool(tools: DataFrame, tool_id: str) -> DataFrame:
    return tools.where(F.col("id") == tool_id)


def available_tools(tools: DataFrame, category: str | None = None) -> DataFrame:
    """The tools that can be used, of one category if it is named."""
    t = tools.where(F.coalesce("available", F.lit(False)))
    return t if category is None else t.where(F.col("category") == category)


def distinct_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, values: the distinct values of each key in the order of their first sight."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("l")).select(key, F.transform("l", lambda x: x["v"]).alias("values"))


def slide_counts(slides: DataFrame) -> DataFrame:
    """doc_id and how many gradients, groups, frames and transitions the slides (doc_id, xml) hold."""
    return slides.groupBy("doc_id").agg(*[F.sum(F.regexp_count("xml", F.lit(mark))).alias(name) for name, mark in SLIDE_MARKS.items()])


def workbook_counts(sheets: DataFrame) -> DataFrame:
    """doc_id with formulas, missing_values, merged and cut_rows of all sheets."""
    names = ("formulas", "missing_values", "merged", "cut_rows")
    return sheets.groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])


def in_order(matches: DataFrame) -> DataFrame:
    """Matches with ``place``, their order within a document: by start, then by detector and match."""
    w = Window.partitionBy("doc_id").orderBy("start", "detector_ord", "match_ord")
    return matches.withColumn("place", F.row_number().over(w) - 1)


def same_manifest(left: DataFrame, right: DataFrame) -> DataFrame:
    """The entries (name, digest) that only one of two manifests has; none if they are equal."""
    a, b = left.select("name", "digest"), right.select("name", "digest")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def merged_names(files: DataFrame, keys: list[str], order: str, extension: str, suffix: str | None = None) -> DataFrame:
    """keys and ``name``: one file name for the files (keys, order, name) of each group.

    Only a group's first three stems and their number are needed, so no task gathers a group."""
    stems = files.select(*keys, F.col(order).alias("_at"), output_stem(F.col("name")).alias("_stem"))
    some = stems.where("_stem <> ''")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    first = some.withColumn("_place", place).where("_place <= 3").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_stem"))).alias("_l"))
    counts = stems.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(F.coalesce((F.col("_stem") != "").cast("long"), F.lit(0))).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys])
    name = named_output(F.transform(F.coalesce("_l", F.array().cast("array<struct<_place:int,_stem:string>>")), lambda x: x["_stem"]), F.col("_n"), extension, suffix)
    return counts.join(first, same, "left").select(*[F.col(f"_{k}").alias(k) for k in keys], name.alias("name"))
