"""Usage events and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The keys that an event may keep, and the longest text value.
ALLOWED_KEYS = ("toolId", "eventName", "deviceClass", "fileSizeBucket", "pageCountBucket", "durationBucket", "success", "errorCode")
LONGEST_VALUE = 64
#: Records of a history that are kept.
KEPT = 50


def sanitized(event: Column, allowed: tuple[str, ...] = ALLOWED_KEYS) -> Column:
    """struct(sanitized, dropped_keys) of a map<string,string>: allowed keys with short values stay."""
    ok = lambda k, v: k.isin(*allowed) & (F.coalesce(F.length(v), F.lit(0)) <= LONGEST_VALUE)
    return F.struct(F.map_filter(event, ok).alias("sanitized"), F.array_sort(F.map_keys(F.map_filter(event, lambda k, v: ~ok(k, v)))).alias("dropped_keys"))


def recent(history: DataFrame, keep: int = 50, group: str | None = None) -> DataFrame:
    """The newest ``keep`` records (ts, event_id breaks ties), overall or of each group."""
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    if group is None:
        return history.orderBy(*order).limit(keep)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return history.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")


def recorded(history: DataFrame, record: DataFrame, keep: int = KEPT) -> DataFrame:
    """A history after new records: of one id the newest stays, and of all the newest ``keep``."""
    every = history.unionByName(record)
    last = F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("ts").desc()))
    return recent(every.withColumn("_last", last).where("_last = 1").drop("_last"), keep)


def deleted(history: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """A history without the records of those ids; without any where no ids are given."""
    return history.where("false") if ids is None else history.where(~F.col("event_id").isin(ids))
