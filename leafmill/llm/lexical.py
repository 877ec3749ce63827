"""Ranked lexical search over document-sharded postings.

The index: each task cuts its documents into shards. A shard holds its terms and, by term, a stretch of
(document, impact) postings, as arrays of a sparse matrix by rows (CSR). The impact of tf occurrences in
a document of n terms is SCALE * tf div (1000 * tf + 8 * m) with m = 25 + 75 * n * N div L, where N
counts the documents with terms and L their terms. It is an integer and known without the queries, so texts are
never shuffled and never read again.

A search reads the index for a block of queries at a time, twice: once for the number of documents that
hold each query term, which gives the term's weight, then for the scores. A shard adds weight times impact term
after term into a dense array over its documents, cuts it at the k-th highest score, keeps all ties there and
orders them by doc_id. The shards' best are merged by a ranking window that Spark also limits before its shuffle.

Defined cases: null and termless texts are not in the index, a query without terms finds nothing; rows without
doc_id are ranked after all others at ties and returned with a null; repeated rows and repeated queries are
separate; an empty table of documents or queries gives an empty result; texts of any length are read whole; further
columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import written
from .ngram_join import small_batches
from .terms import TERM, Vocabulary, terms_of, translated

SCALE = 1_000_000_000
TOP = 10
#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 21
#: Queries and bytes of their texts that are searched at a time.
BLOCK_QUERIES, BLOCK_BYTES = 2000, 8 << 20

INDEX = "terms binary, starts binary, docs binary, impacts binary, ids binary, named binary"


@dataclass
class LexicalIndex:
    """The written shards, and the counts of documents with terms and of their terms."""

    shards: DataFrame
    documents: int
    terms: int


class Shard:
    """Documents on their way into one shard."""

    def __init__(self) -> None:
        self.vocabulary, self.postings = Vocabulary(), 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.term: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []

    def add(self, doc_id: int | None, words: np.ndarray) -> None:
        term, tf = np.unique(words, return_counts=True)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.term.append(term)
        self.tf.append(tf)
        self.postings += len(term)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self, documents: int, terms: int) -> list[bytes]:
        """The values of INDEX."""
        m = np.array([25 + 75 * n * documents // terms for n in self.sizes], np.int64)
        doc = np.repeat(np.arange(len(m), dtype=np.int32), list(map(len, self.term)))
        term, tf = np.concatenate(self.term), np.concatenate(self.tf).astype(np.int64)
        order = np.argsort(term, kind="stable")
        doc, tf = doc[order], tf[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))]).astype(np.int32)
        impact = (SCALE * tf // (1000 * tf + 8 * m[doc])).astype(np.int32)
        named = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        return [b" ".join(self.vocabulary.number), *(a.tobytes() for a in (starts, doc, impact, ids, named))]


def build_index(docs: DataFrame) -> LexicalIndex:
    """The index of columns doc_id (a whole number) and text, written to the shared folder."""
    size = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    n, length = docs.select(size.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda s: pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in s.row(n, length)], [c.split()[0] for c in INDEX.split(", ")])
        shard = Shard()
        for b in batches:
            ids = b.column(0).to_pylist()
            for r, data in translated(b.column(1)):
                words = shard.vocabulary.ids(data)
                if len(words):
                    shard.add(ids[r], words)
                if shard.full():
                    yield rows(shard)
                    shard = Shard()
        if shard.ids:
            yield rows(shard)

    small_batches(docs)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, INDEX)
    return LexicalIndex(written(table, "postings"), n, length)


@dataclass
class QueryBlock:
    """Some queries: their row numbers, the distinct terms of all, and of each query the (term, repeats)."""

    rows: list[int]
    terms: list[bytes]
    wanted: list[list[tuple[int, int]]]


def query_blocks(items: Iterable[tuple[int, str | None]]) -> Iterator[QueryBlock]:
    """Blocks of bounded size of (row, text)."""
    vocabulary, rows, wanted, size = Vocabulary(), [], [], 0
    for row, text in items:
        found = Counter(terms_of(text))
        if not found:
            continue
        rows.append(row)
        wanted.append([(vocabulary.number[t], c) for t, c in found.items()])
        size += len(text)
        if len(rows) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
            yield QueryBlock(rows, list(vocabulary.number), wanted)
            vocabulary, rows, wanted, size = Vocabulary(), [], [], 0
    if rows:
        yield QueryBlock(rows, list(vocabulary.number), wanted)


def _lookup(terms: pa.Array, vocabulary: bytes) -> np.ndarray:
    """The place of each term in a shard's vocabulary, -1 where it is not there."""
    return pc.fill_null(pc.index_in(terms, pa.array(vocabulary.split(b" "), pa.binary())), -1).to_numpy(zero_copy_only=False)


def document_counts(index: LexicalIndex, block: QueryBlock) -> np.ndarray:
    """How many documents hold each term of the block."""
    held = index.shards.sparkSession.sparkContext.broadcast(block.terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(held.value, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for vocabulary, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, size = _lookup(terms, vocabulary), np.diff(np.frombuffer(starts, np.int32))
                total += np.where(at >= 0, size[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    sums = index.shards.select("terms", "starts").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(block.terms), np.int64)
    for r in sums.collect():  # one row a term of the block at most
        out[r["term"]] = r["df"]
    held.unpersist()
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores above 0; ties in order of ids, unnamed ones last."""
    some = np.flatnonzero(scores)
    if len(some) > k:
        least = scores[some][np.argpartition(scores[some], len(some) - k)[len(some) - k]]
        some = some[scores[some] >= least]
    return some[np.lexsort((ids[some], ~named[some], -scores[some]))][:k]


def _searched(index: LexicalIndex, block: QueryBlock, k: int) -> DataFrame:
    """(query, doc_id, score): the best k of each shard for each query of the block."""
    df = document_counts(index, block)
    weight = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(d) + 1))) for d in df]
    held = index.shards.sparkSession.sparkContext.broadcast((block, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = held.value
        terms = pa.array(queries.terms, pa.binary())
        for b in batches:
            for vocabulary, *arrays in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts, docs, impacts, ids, named = (np.frombuffer(a, t) for a, t in zip(arrays, (np.int32, np.int32, np.int32, np.int64, bool), strict=True))
                at = _lookup(terms, vocabulary)
                begins, ends = starts[at], starts[at + 1]
                out = []
                for row, wanted in zip(queries.rows, queries.wanted, strict=True):
                    total = np.zeros(len(ids), np.int64)
                    for t, repeats in wanted:
                        if at[t] >= 0 and w[t]:
                            here = slice(begins[t], ends[t])
                            total[docs[here]] += impacts[here] * np.int64(w[t] * repeats)
                    best = best_of(total, ids, named, k)
                    out.append((np.full(len(best), row), ids[best], named[best], total[best]))
                row, doc, known, score = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(doc, mask=~known), pa.array(score)], ["query", "doc_id", "score"])

    return index.shards.mapInArrow(search, "query long, doc_id long, score long")


def ranked_search(index: LexicalIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents for each row of ``items`` (item_id, text).

    Queries come through the driver a bounded block at a time, each block against all shards."""
    spark = items.sparkSession
    numbered = written(items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "queries")
    texts = ((r["query"], r["text"]) for r in numbered.select("query", "text").toLocalIterator())
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    if index.documents:
        for block in query_blocks(texts):
            found = found.unionByName(_searched(index, block, k))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
