"""Ranks and running sums over groups of any size.

A window over a whole group puts that group into one task. Here every group is cut into
buckets of a uniform key; sums by (group, bucket) are small, their running sums give each
bucket its offset, and only the rows of one bucket meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 2000
SUPER = 1024


def shuffle_key(seed: str, *columns: str) -> Column:
    """A uniform long in [0, 2^32), from a digest of the seed and the columns (nulls empty)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 8), 16, 10).cast("long")


def buckets_for(rows: int) -> int:
    """How many buckets a table of so many rows is cut into."""
    return max(1, rows // ROWS_A_BUCKET)


def with_offsets(sums: DataFrame, groups: list[str], bucket: str, values: dict[str, str]) -> DataFrame:
    """Adds to each (group, bucket) row the sums over all earlier buckets of its group.

    ``values`` maps a value column to the name of its offset; ``<name>_all`` gets the
    group's whole sum. Two levels: a task sees the SUPER buckets of one super-bucket, or one row
    for every SUPER buckets of a group."""
    t = sums.withColumn("_super", F.floor(F.col(bucket) / SUPER))
    tops = t.groupBy(*groups, "_super").agg(*[F.sum(v).alias(f"_s_{o}") for v, o in values.items()])
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = over.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_super").alias("_top"),
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in values.values()],
        *[F.sum(f"_s_{o}").over(over).alias(f"{o}_all") for o in values.values()],
    )
    same = F.col("_super") == F.col("_top")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inner = Window.partitionBy(*groups, "_super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    joined = t.join(tops, same).drop("_top", *[f"_g_{g}" for g in groups])
    for v, o in values.items():
        joined = joined.withColumn(o, F.col(f"_b_{o}") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return joined.drop("_super", *[f"_b_{o}" for o in values.values()])
