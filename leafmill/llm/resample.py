"""Importance resampling towards a target distribution.

Features are the runs of 1 to ``longest`` consecutive words of a text. The words of a block of
documents are numbered, and the suffixes of the block are sorted down to ``longest`` words, never beyond
a document's end. Neighbours in that order that share their first d words form a run: one n-gram
with all its occurrences. Each run is hashed once, and its bucket is scattered back to the occurrences.

A first pass counts buckets of all documents and of the target texts, a second sums each
document's gains, and its score adds Gumbel noise that follows from its id, so that the highest
scores are a draw without replacement by weight. Ranks come from a range sort of narrow rows and the
sizes of the ranges, so no task sees more than a range.

Defined cases: a null or wordless text has no features and weight 0; a null doc_id is hashed as an
empty one and stands after all others at ties; repeated rows are separate documents (equal ones get
neighbouring ranks); an empty table gives an empty result, and without target texts the gains follow
from the documents alone; texts of any length are read whole; further columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import written
from .ngram_join import small_batches
from .terms import Vocabulary, translated

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words in a block, about: a text that has more is a block of its own.
BLOCK_WORDS = 1 << 20
#: Rows in a range of the sort by score, about, and ranges whose sizes are broadcast at most.
RANGE_ROWS, MOST_BROADCAST = 100_000, 1_000_000


def suffix_order(ids: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``longest`` words, words that each shares with the one before).

    ``ends`` has for each place the end of its document. Words past it sort first and are shared with none."""
    n = len(ids)
    place = np.arange(n)
    keys = [np.where(place + d < ends, ids[np.minimum(place + d, n - 1)], -1) for d in range(longest)]
    order = np.argsort(keys[0], kind="stable") if longest == 1 else np.lexsort(keys[::-1])
    shared, alike = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in keys:
        k = k[order]
        alike &= (k[1:] == k[:-1]) & (k[1:] >= 0)
        shared[1:] += alike
    return order, shared


def bucket_rows(ids: np.ndarray, ends: np.ndarray, words: list[bytes], longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, (places of all n-grams of that length, their buckets)."""
    order, shared = suffix_order(ids, ends, longest)
    for d in range(1, longest + 1):
        whole = order + d <= ends[order]
        first = np.flatnonzero(whole & (shared < d))
        heads = order[first]
        code = np.fromiter((zlib.crc32(b" ".join([words[w] for w in ids[p : p + d].tolist()])) % buckets for p in heads.tolist()), np.int64, len(heads))
        # Suffixes too short for d words stand before those that share fewer, so runs of whole ones are unbroken.
        run = np.cumsum(whole & (shared < d)) - 1
        yield order[whole], code[run[whole]]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, word numbers, words of each row, words by number) of stretches of rows."""
    first, parts, words, vocabulary = 0, [], 0, Vocabulary()
    for r, data in translated(texts):
        parts.append(vocabulary.ids(data))
        words += len(parts[-1])
        if words >= BLOCK_WORDS:
            yield first, np.concatenate(parts), np.array(list(map(len, parts))), list(vocabulary.number)
            first, parts, words, vocabulary = r + 1, [], 0, Vocabulary()
    if parts:
        yield first, np.concatenate(parts), np.array(list(map(len, parts))), list(vocabulary.number)


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of column ``text`` by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, ids, sizes, words in _blocks(b.column(0)):
                for _, code in bucket_rows(ids, np.repeat(np.cumsum(sizes), sizes), words, longest, buckets):
                    total += np.bincount(code, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    small_batches(texts)
    return texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(rate in the target / rate in the documents)) of each bucket, both with one more in every bucket."""
    found = []
    for table in (target, docs):
        n = np.zeros(buckets)
        for r in bucket_counts(table, longest, buckets).collect():  # one row a bucket at most
            n[r["bucket"]] = r["n"]
        found.append(n)
    t, s = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for first, ids, sizes, words in _blocks(b.column(1)):
                rows = slice(first, first + len(sizes))
                ends = np.cumsum(sizes)
                out[0, rows] = sizes
                row, before = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], ends])
                for place, code in bucket_rows(ids, np.repeat(ends, sizes), words, longest, len(held.value)):
                    here = np.zeros(len(ids) + 1, np.int64)
                    here[1:][place] = held.value[code]
                    run = np.cumsum(here)
                    out[1, rows] += np.bincount(row[place], minlength=len(sizes))
                    out[2, rows] += run[before[1:]] - run[before[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null for documents that are not drawn)."""
    w = weighed(docs, gains(docs, target, longest, buckets), longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    # Equal rows must not meet in one range, so each has a number of its own.
    rows = written(w.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id()), "weights")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.xxhash64("_row")]
    n_ranges = max(1, n // RANGE_ROWS)
    ranges = able.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    # The number of a row holds its range and its place there.
    ranges = written(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    dense = ranges.withColumn("_range", F.shiftrightunsigned("_at", 33).cast("int")).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dense.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")
    sizes = sizes.select(F.col("_range").alias("_of"), before.alias("_before"))
    ranked = dense.join(F.broadcast(sizes) if n_ranges <= MOST_BROADCAST else sizes, F.col("_range") == F.col("_of")).withColumn("rank", F.col("_before") + F.col("_place") + 1)
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank")).cast("long")
    out = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*out, drawn.alias("rank")).unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
