"""Page algebra: ranges, segments, runs, labels, reordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.scalars import strip_space
from ..functions.spread import with_offsets

FILES_A_BUCKET = 10_000

RANGE = r"^[0-9]+$|^([0-9]+)\s*-\s*([0-9]+)$"


def parse_ranges(expression: Column, page_count: Column) -> Column:
    """struct(segments, pages, warnings, error) of an expression such as ``1-3,5``.

    Segments keep overlaps, pages are distinct in order of first sight, reversed ranges are
    turned with a warning. ``error`` says what is wrong; then the rest is null."""
    tokens = F.transform(F.split(strip_space(expression), ","), lambda x: strip_space(x))
    low = lambda t: F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("int")
    high = lambda t: F.regexp_extract(t, r"([0-9]+)$", 1).try_cast("int")
    segment = lambda t: F.struct(F.least(low(t), high(t)).alias("start"), F.greatest(low(t), high(t)).alias("end"))

    def parsed(ts: Column) -> Column:
        error = (
            F.when(strip_space(expression) == "", F.lit("empty expression"))
            .when(F.exists(ts, lambda t: t == ""), F.lit("empty page range"))
            .when(F.exists(ts, lambda t: ~t.rlike(RANGE)), F.lit("invalid page range"))
            .when(F.exists(ts, lambda t: low(t).isNull() | high(t).isNull() | (F.least(low(t), high(t)) < 1) | (F.greatest(low(t), high(t)) > page_count)), F.lit("page range out of bounds"))
        )
        segments = F.transform(ts, segment)
        pages = F.array_distinct(F.flatten(F.transform(segments, lambda s: F.sequence(s["start"], s["end"]))))
        turned = F.filter(ts, lambda t: low(t) > high(t))
        warnings = F.transform(turned, lambda t: F.concat(F.lit("reversed range "), t))
        ok = error.isNull()
        return F.struct(F.when(ok, segments).alias("segments"), F.when(ok, pages).alias("pages"), F.when(ok, warnings).alias("warnings"), error.alias("error"))

    return let(tokens, parsed)


def every_n(page_count: Column, n: Column) -> Column:
    """array<struct<start, end>>: consecutive segments of floor(n) pages."""
    size = F.greatest(F.floor(n), F.lit(1)).cast("int")
    starts = F.when(page_count >= 1, F.sequence(F.lit(1), page_count.cast("int"), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size - 1, page_count.cast("int")).alias("end")))


def target_pages(requested: Column, page_count: Column, empty_means_all: bool = True) -> Column:
    """Requested pages that exist, distinct and sorted; none requested means all or none."""
    valid = F.array_sort(F.array_distinct(F.filter(requested, lambda p: (p >= 1) & (p <= page_count))))
    everything = F.when(page_count >= 1, F.sequence(F.lit(1), page_count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(everything if empty_means_all else F.array().cast("array<int>"))


def runs(rows: DataFrame, group: str, position: str) -> DataFrame:
    """Contiguous positions of each group as (start, end, length): gaps and islands."""
    d = rows.select(group, position).where(F.col(position).isNotNull()).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(group).orderBy(position))
    return d.withColumn("_i", island).groupBy(group, "_i").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("length")).drop("_i")


def page_labels(targets: DataFrame, start: int = 1, skip_first: bool = False) -> DataFrame:
    """Numbers the target pages (doc_id, page) of each document from ``start``: n, total, label."""
    t = targets.where(F.col("page") > 1) if skip_first else targets
    w = Window.partitionBy("doc_id")
    n = F.row_number().over(w.orderBy("page")) + max(1, start) - 1
    total = F.count("*").over(w)
    return t.select("doc_id", "page", n.alias("n"), total.alias("total"), F.concat(n.cast("string"), F.lit(" / "), total.cast("string")).alias("label"))


def arrange(pages: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Pages (doc_id, page, rotation) in the order of descriptors (doc_id, out_idx, src_idx,
    rotate_delta); repeated descriptors duplicate pages, unnamed pages are dropped."""
    d = descriptors.join(pages.withColumnRenamed("page", "src_idx"), ["doc_id", "src_idx"])
    return d.select("doc_id", "out_idx", F.col("src_idx").alias("page"), F.pmod(F.col("rotation") + F.col("rotate_delta"), F.lit(360)).alias("rotation"))


def rotated(pages: DataFrame, delta: int, only: list[int] | None = None) -> DataFrame:
    """Descriptors (doc_id, out_idx, src_idx, rotate_delta) that turn every page; with ``only``, the other pages are left out."""
    kept = pages if only is None else pages.where(F.col("page").isin(only))
    return kept.select("doc_id", F.col("page").alias("out_idx"), F.col("page").alias("src_idx"), F.lit(delta).alias("rotate_delta"))


def edited(descriptors: DataFrame, removed: DataFrame | None = None, doubled: DataFrame | None = None) -> DataFrame:
    """Descriptors (doc_id, out_idx, ...) after edits of a page grid: ``removed`` and ``doubled`` (doc_id, out_idx);
    a doubled page stands after its first, and out_idx counts from 0 again."""
    by = ["doc_id", "out_idx"]
    d = descriptors if removed is None else descriptors.join(removed.select(*by).distinct(), by, "left_anti")
    d = d.withColumn("_copy", F.lit(0))
    if doubled is not None:
        d = d.unionByName(d.join(doubled.select(*by).distinct(), by, "left_semi").withColumn("_copy", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("out_idx", "_copy")) - 1
    return d.withColumn("_at", place).drop("out_idx", "_copy").withColumnRenamed("_at", "out_idx")


def chunks(pages: DataFrame, span: int) -> DataFrame:
    """doc_id, chunk (from 0), first, last: the pages (doc_id, page) in chunks of ``span``."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    g = pages.select("doc_id", "page").distinct().withColumn("chunk", F.floor(at / max(1, span)))
    return g.groupBy("doc_id", "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last"))


def merged(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Pages (file, page) of several files as one document: out_page continues over the files
    in the order of files (file, file_ord).

    Files are cut into buckets of FILES_A_BUCKET by their order; a bucket's offset comes from the sums of the
    buckets, a file's from those of its bucket, so no task sees all files."""
    counts = pages.groupBy("file").agg(F.max("page").alias("_n")).join(files, "file")
    counts = counts.withColumn("_bucket", F.floor(F.col("file_ord") / FILES_A_BUCKET))
    sums = with_offsets(counts.groupBy("_bucket").agg(F.sum("_n").alias("_all")), [], "_bucket", {"_all": "_before"}).select("_bucket", "_before")
    run = Window.partitionBy("_bucket").orderBy("file_ord", "file").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.join(sums, "_bucket").withColumn("_before", F.col("_before") + F.sum("_n").over(run) - F.col("_n"))
    return pages.join(counts.select("file", "file_ord", "_before"), "file").select("file", "file_ord", "page", (F.col("_before") + F.col("page")).alias("out_page"))
