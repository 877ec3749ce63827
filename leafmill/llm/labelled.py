"""Labelled rows for training: a bounded, seeded sample, never the held-out fifth."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spread import shuffle_key

#: Bytes of the longest text that a model is trained on, so that the one training task is bounded.
LONGEST_SAMPLE = 1 << 16


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], seed: str) -> DataFrame:
    """(y, key, doc_id, text): at most ``most[label]`` documents each, the first of a seeded shuffle.

    The ids are picked in the label table, so at most sum(most) rows are broadcast. Ids
    labelled twice count with the larger label; null texts and those over LONGEST_SAMPLE bytes are left
    out; of a repeated doc_id the smallest text counts."""
    key = shuffle_key(seed, "doc_id")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    marked = marked.where(~held_out(F.col("doc_id"))).withColumn("_key", key)
    picked = None
    for y, n in most.items():
        part = marked.where(F.col("_y") == y).orderBy("_key", "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST_SAMPLE).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.first("_y").cast("int").alias("y"), F.first("_key").alias("key"), F.min("text").alias("text")).select("y", "key", "doc_id", "text")


def trained_in_a_task(sample: DataFrame, train: Callable[[dict[int, list[str]]], tuple | None]) -> tuple | None:
    """What ``train`` makes of the sample's texts by label, run in one task of an executor.

    The sample is bounded, so the task is; the driver sees the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        texts: dict[int, list[str]] = {}
        for y, _, _, text in rows:
            texts.setdefault(y, []).append(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts))], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return found and pickle.loads(bytes(found["model"]))
