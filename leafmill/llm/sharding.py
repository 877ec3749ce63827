"""Sharding by proportional stratified interleaving (law ``rows``).

The rows of each source are ranked in a seeded shuffle; a row's fractional rank is
(rank - 1/2) / rows of its source. Sorted by fractional rank, every stretch of the table
holds each source in proportion, so cutting it into equal stretches gives shards that match
the mixture and whose row counts differ by one at most.

Defined cases: a null text counts 16 bytes and has the CRC of the empty text; a null source
is a source of its own; repeated rows are separate rows, ties are broken by doc_id, size and
CRC; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import written
from ..functions.spread import buckets_for, shuffle_key, with_offsets

SHARDS = 40
OVERHEAD = 16


def interleaved(docs: DataFrame, seed: str = "shard") -> DataFrame:
    """doc_id, source, size, text_crc32, frac and ``place``: the row's place (from 0) in the interleaved order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    rows = written(rows.withColumn("_key", shuffle_key(seed, "doc_id")), "shard-rows")
    n = buckets_for(rows.count())
    # Ranks within each source, by buckets of the uniform shuffle key.
    t = rows.withColumn("_bucket", F.floor(F.col("_key") * n / F.lit(1 << 32)))
    sums = with_offsets(t.groupBy("source", "_bucket").agg(F.count("*").alias("_n")), ["source"], "_bucket", {"_n": "_before"})
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_before", "_before_all")
    t = t.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", "text_crc32"))
    t = t.withColumn("frac", (2 * (F.col("_before") + rank) - 1) / (2 * F.col("_before_all")))
    t = t.select("doc_id", "source", "size", "text_crc32", "frac")
    # Places in the whole order, by ranges of the fractional rank, which is uniform.
    t = written(t.withColumn("_range", F.floor(F.col("frac") * n)), "shard-fractions")
    ranges = with_offsets(t.groupBy("_range").agg(F.count("*").alias("_n")), [], "_range", {"_n": "_before"})
    t = t.join(ranges.select(F.col("_range").alias("_r"), "_before", "_before_all"), F.col("_range") == F.col("_r"))
    order = Window.partitionBy("_range").orderBy("frac", F.col("source").asc_nulls_last(), "doc_id", "size", "text_crc32")
    return t.withColumn("place", F.col("_before") + F.row_number().over(order) - 1).withColumnRenamed("_before_all", "n_rows").drop("_range", "_r", "_before")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: str = "shard") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source.

    Shard k holds the places p with floor(p * shards / rows) = k; the slot counts from 0."""
    t = interleaved(docs, seed)
    t = t.withColumn("_s", F.expr(f"place * {int(shards)} div n_rows")).withColumn("_first", F.expr(f"(_s * n_rows + {int(shards) - 1}) div {int(shards)}"))
    return t.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_s").cast("int").alias("shard"),
        (F.col("place") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
