r"""Nearest neighbours by multi-index hashing.

A vector becomes a code: the signs of its coordinates under rotations that are learned on a bounded
sample so that the signs lose least (iterative quantisation). A code is cut into SUBSTRINGS
substrings of BITS bits. The index is a table of postings, one row per vector and substring, dealt by
(substring, first bits of the value); it is written once, and no vector is in it. A query is sent only to the
parts that hold values within ``flips`` bits of its own and looks those values up there. By the
pigeonhole principle that retrieves every code within the Hamming radius
SUBSTRINGS * (flips + 1) - 1; a code at a larger angle is retrieved with the known probability that
one of its substrings is that near. A pair is made at the first substring that finds it, so none is
made twice; codes beyond the distance at which hardly any neighbour lies are passed over. The pairs then
meet their vectors in equi-joins and are ranked by cosine in double precision.

The search begins with the flips that would do for half of the sample. From there
the radius grows per query: its k-th vector found gives the chance that one as near was missed.
Where that is over MISS, the query looks up values of more bits (FLIPS at most), now only for codes within the distance
that such a cosine allows. A query that still has too few neighbours, or whose k-th would have been missed with a
chance over LEFT, is compared with all rows, in blocks: no table of this index finds far neighbours cheaply.

Equal vectors are one row of the index: with k * 2 of their ids for the answers, as no query can need more.
Vectors of one length are compared with one another. Parts that hold more rows or queries than a task should are split.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part;
rows that repeat a vec_id are
candidates of their own (but none of a query with that id); ties go to the smaller vec_id; a
query with fewer candidates than k gets them all; an empty table gives an empty result;
further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import dropped, written

SAMPLE, PROBES = 4096, 512
#: Pairs of near vectors of the sample that the code distance is taken from at least.
NEAR = 200
SUBSTRINGS, BITS = 24, 16
#: Flips of a substring that are looked up at most.
FLIPS = 3
#: Chances of missing the k-th neighbour beyond which a query goes on: to more flips, to all rows.
MISS, LEFT = 0.05, 0.15
QUANTILE = 0.995
#: Rows of a part of the index, rows and queries of a task at most, blocks of the comparison with all rows.
PART, ROWS, QUERIES = 4096, 32768, 8192
QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def usable(v: Column) -> Column:
    """True for vectors that can be compared."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0), F.lit(False))


def learn_rotations(x: np.ndarray, tables: int, seed: int = 3, steps: int = 20) -> np.ndarray:
    """(dimension, tables * dimension): rotations that bring unit vectors near their signs."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        r, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(steps):
            u, _, w = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ w
        out.append(r)
    return np.concatenate(out, 1)


def codes_of(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(rows, SUBSTRINGS) substrings of the codes of unit vectors."""
    some = rotations[:, : SUBSTRINGS * BITS]
    bits = np.packbits(x @ some > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.uint16)


def code_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the codes of each row of ``a`` and the same row of ``b``."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def masks(flips: int, bits: int = BITS) -> np.ndarray:
    """The values of so many bits that differ from 0 in ``flips`` bits at most."""
    return np.array([sum(1 << b for b in some) for n in range(min(flips, bits) + 1) for some in combinations(range(bits), n)], np.int64)


class Postings:
    """The rows of one part of the index: those whose substring ``j`` begins with the ``s`` bits of ``part``."""

    def __init__(self, codes: np.ndarray, j: int, s: int = 0, part: int = 0):
        self.codes, self.j, self.part, self.low = codes, j, part, BITS - s
        value = codes[:, j].astype(np.int64) & ((1 << self.low) - 1)
        self.order = np.argsort(value, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << self.low))])

    def near(self, queries: np.ndarray, flips: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of the postings read, in pieces: those within each query's flips."""
        value = queries[:, self.j].astype(np.int64)
        rest = flips - np.bitwise_count((value >> self.low) ^ self.part)
        value &= (1 << self.low) - 1
        for r in np.unique(rest[rest >= 0]):
            flip, mine = masks(int(r), self.low), np.flatnonzero(rest == r)
            for at in range(0, len(mine), 64):
                some = mine[at : at + 64]
                v = value[some, None] ^ flip[None, :]
                start, size = self.first[v].ravel(), (self.first[v + 1] - self.first[v]).ravel()
                hit = np.flatnonzero(size)
                start, size = start[hit], size[hit]
                ends = np.cumsum(size)
                place = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                yield some[np.repeat(hit // len(flip), size)], self.order[place]

    def pairs(self, queries: np.ndarray, flips: np.ndarray, seen: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of the codes within ``reach`` that this substring is the first to find, and that
        ``seen`` flips did not find."""
        for x, y in self.near(queries, flips):
            for at in range(0, len(x), 1 << 16):
                i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                apart = np.bitwise_count(queries[i] ^ self.codes[j])
                fine = (apart.sum(1, dtype=np.int64) <= reach[i]) & ((apart <= flips[i, None]).argmax(1) == self.j) & (apart.min(1) > seen[i])
                yield i[fine], j[fine]


def miss_chance(cosine: np.ndarray, flips: int) -> np.ndarray:
    """The chance that a vector of that cosine is not retrieved."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    near = sum(comb(BITS, n) * p**n * (1 - p) ** (BITS - n) for n in range(flips + 1))
    return (1 - np.minimum(near, 1)) ** SUBSTRINGS


def reach_of(cosine: np.ndarray) -> np.ndarray:
    """The code distance that a vector of that cosine hardly ever exceeds (three deviations)."""
    p, n = np.arccos(np.clip(cosine, -1, 1)) / np.pi, SUBSTRINGS * BITS
    return np.ceil(n * p + 3 * np.sqrt(n * p * (1 - p))).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def fit_index(vectors: DataFrame, d: int, k: int, n: int) -> tuple[np.ndarray, int, int]:
    """(rotations, code distance beyond which hardly any neighbour lies, flips that would do for half of the
    queries) from at most SAMPLE vectors of length d, the first of a digest order. The k-th neighbour among all n
    vectors lies where a sample has its (k * sample / n)-th, so that many neighbours of the sample are looked at. Where that is less
    than one a probe, the nearest ones of all probes are, so that the distance falls as n grows; NEAR of them at least, which
    holds it where it is beyond k * SAMPLE ** 2 / NEAR vectors."""
    sample = vectors.orderBy("ca", "cb").select("embedding").limit(SAMPLE).toArrow()
    x = _unit(_matrix(sample["embedding"]))
    rotations = learn_rotations(x, -(-SUBSTRINGS * BITS // d))
    c = codes_of(x, rotations)
    if len(x) <= k + 1:
        return rotations, SUBSTRINGS * BITS, FLIPS
    r = max(1, -(-k * len(x) // n))
    # Among n vectors so many of a probe's neighbours lie as near as its k-th: less than one of them is in a small sample.
    share = min(1.0, k * len(x) / (n * r))
    probes = min(len(x), max(PROBES, int(np.ceil(NEAR / (share * r)))))
    scores, far = [], []
    for at in range(0, probes, PROBES):
        some = np.arange(at, min(at + PROBES, probes))
        cos = x[some] @ x.T
        cos[np.arange(len(some)), some] = -2
        best = np.argpartition(-cos, r, axis=1)[:, :r]
        scores.append(np.take_along_axis(cos, best, 1))
        far.append(code_distance(np.repeat(c[some], r, axis=0), c[best.ravel()]))
    scores, far = np.concatenate(scores), np.concatenate(far)
    last = np.median(scores.min(1))
    flips = next((f for f in range(1, FLIPS) if miss_chance(last, f) <= MISS), FLIPS)
    nearest_pairs = np.argsort(-scores.ravel(), kind="stable")[: max(NEAR, int(np.ceil(share * len(far))))]
    far = far[nearest_pairs]
    return rotations, int(np.ceil(np.quantile(far, QUANTILE))), flips


def _codes(column: pa.Array) -> np.ndarray:
    """(rows, SUBSTRINGS) from a column of codes in bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SUBSTRINGS)


def coded(rows: DataFrame, index: tuple[np.ndarray, int, int]) -> DataFrame:
    """(id, code) of rows (id, embedding)."""
    held = rows.sparkSession.sparkContext.broadcast(index[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codes_of(_unit(_matrix(b.column(1))), held.value) if b.num_rows else ()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return rows.select("id", "embedding").mapInArrow(encode, "id long, code binary")


def _values(codes: DataFrame) -> DataFrame:
    """A row per code and substring: ``j`` and its ``value``."""
    at = codes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SUBSTRINGS - 1))))
    # The bytes of a substring stand in the order of the machine's integers: the smaller first.
    byte = lambda k: F.conv(F.hex(F.substring("code", F.col("j") * 2 + k, F.lit(1))), 16, 10).cast("int")
    return at.withColumn("value", byte(1) + byte(2) * 256)


def prefix_bits(rows: int) -> int:
    """How many first bits of a value name a part, so that an even part holds about PART rows."""
    return min(BITS, max(0, (max(rows, 1) - 1) // PART).bit_length())


def postings(codes: DataFrame, s: int) -> DataFrame:
    """The index: (j, part, id, code)."""
    return _values(codes).select("j", F.shiftright("value", BITS - s).alias("part"), "id", "code")


def _heavy(table: DataFrame, most: int, name: str) -> DataFrame | None:
    """(j, part, name): in how many the parts with more than ``most`` rows are split; None where there are none."""
    sizes = table.groupBy(F.col("j").alias(f"{name}_j"), F.col("part").alias(f"{name}_part")).agg(F.count("*").alias("_n"))
    heavy = sizes.where(F.col("_n") > most).select(f"{name}_j", f"{name}_part", F.ceil(F.col("_n") / most).cast("int").alias(name))
    return None if heavy.isEmpty() else heavy


def _retrieved(asking: DataFrame, index: DataFrame, s: int, wide: DataFrame | None) -> DataFrame:
    """(q, r): the pairs of queries (id, code, flips, seen, reach) and rows of ``index`` that the codes let through.
    ``wide`` is the parts of the index that are split, None where there are none."""
    own = F.shiftright("value", BITS - s)
    flip = F.array(*[F.array(*[F.lit(int(m)) for m in masks(f, s)]) for f in range(FLIPS + 1)])
    near = F.transform(F.element_at(flip, F.col("flips") + 1), lambda m: m.bitwiseXOR(own))
    sent = _values(asking).withColumn("part", F.explode(near)).drop("value")
    heavy = {n: t for n, t in (("wide", wide), ("deep", _heavy(sent, QUERIES, "deep"))) if t is not None}

    def dealt(t: DataFrame, mine: str, other: str) -> DataFrame:
        for name, parts in heavy.items():
            t = t.join(parts, (F.col("j") == F.col(f"{name}_j")) & (F.col("part") == F.col(f"{name}_part")), "left").drop(f"{name}_j", f"{name}_part")
        of = {name: F.coalesce(F.col(name), F.lit(1)) if name in heavy else F.lit(1) for name in (mine, other)}
        t = t.withColumn(f"_{mine}", F.pmod(F.xxhash64("id"), of[mine]).cast("int"))
        t = t.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), of[other] - 1)))
        return t.select(*[F.col(c).alias(f"{mine}_{c}") for c in t.columns])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            j, part = left["deep_j"][0].as_py(), left["deep_part"][0].as_py()
            asked, ids = np.asarray(left["deep_id"]), np.asarray(right["wide_id"])
            flips, seen, reach = (np.asarray(left[f"deep_{c}"]) for c in ("flips", "seen", "reach"))
            for x, y in Postings(_codes(right["wide_code"]), j, s, part).pairs(_codes(left["deep_code"]), flips, seen, reach):
                q.append(asked[x])
                r.append(ids[y])
        return pa.table({"q": np.concatenate(q), "r": np.concatenate(r)})

    by = lambda side: [f"{side}_{c}" for c in ("j", "part", "_wide", "_deep")]
    asked = dealt(sent, "deep", "wide").groupBy(*by("deep"))
    return asked.cogroup(dealt(index, "wide", "deep").groupBy(*by("wide"))).applyInArrow(look_up, "q long, r long")


def _scored(pairs: DataFrame, queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, r, least, score): the cosines of the pairs, with the smallest id of the row's vector."""
    asked = queries.select(F.col("id").alias("q"), F.col("embedding").alias("asked"))
    met = pairs.join(rows.select(F.col("id").alias("r"), "embedding", F.col("ids")[0].alias("least")), "r").join(asked, "q").select("q", "r", "least", "asked", "embedding")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_cosine(_matrix(b.column(3)), _matrix(b.column(4))))], ["q", "r", "least", "score"])

    return met.mapInArrow(cosine, "q long, r long, least long, score double")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _compared(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(q, r, least, score): of each query the k + 1 nearest of each block of all rows."""
    across, down = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-rows.count() // ROW_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = queries.select("id", "embedding", deal(across).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("b"))
    b = rows.select("id", "embedding", F.col("ids")[0].alias("least"), deal(down).alias("b_"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a_"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            x, y = _matrix(left["embedding"]), _matrix(right["embedding"])
            q, r, least = np.asarray(left["id"]), np.asarray(right["id"]), np.asarray(right["least"])
            unit = _unit(y).T
            for i in range(len(x)):
                about = (x[i] / np.sqrt(x[i] @ x[i])) @ unit
                bound = np.partition(about, -(k + 1))[-(k + 1)] if len(about) > k + 1 else -2
                some = np.flatnonzero(about >= bound - 1e-9)
                score = _cosine(np.broadcast_to(x[i], (len(some), x.shape[1])), y[some])
                top = np.lexsort((least[some], -score))[: k + 1]
                out.append((np.full(len(top), q[i]), r[some[top]], least[some[top]], score[top]))
        return pa.table(dict(zip(("q", "r", "least", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return a.groupBy("a", "b").cogroup(b.groupBy("a_", "b_")).applyInArrow(cell, "q long, r long, least long, score double")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "least")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)


def _ends(best: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries with ``last``, the score of their k-th neighbour (theirs is one of the k + 1); null where fewer were found."""
    last = best.where(F.col("place") == k + 1).select(F.col("q").alias("_q"), F.col("score").alias("last"))
    return queries.join(last, F.col("id") == F.col("_q"), "left").drop("_q")


def _next(asked: DataFrame, far: int, first: int) -> DataFrame:
    """Of queries (id, code, last) those that are not done after ``first`` flips, with the flips and reach they need."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = np.asarray(b.column(2).fill_null(float("nan")), np.float64)
            none = np.isnan(last)
            score = np.where(none, 0, last)
            flips = np.full(len(score), FLIPS)
            for f in range(FLIPS - 1, first - 1, -1):
                flips[(miss_chance(score, f) <= MISS) & ~none] = f
            reach = np.where(none, far, np.minimum(far, reach_of(score)))
            ints = [pa.array(v, pa.int32()) for v in (flips, np.full(len(flips), first), reach)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *ints], ["id", "code", "flips", "seen", "reach"]).filter(pa.array(flips > first))

    return asked.select("id", "code", "last").mapInArrow(judge, "id long, code binary, flips int, seen int, reach int")


def _lowest(flips: int, chance: float) -> float:
    """The smallest cosine of a vector that is missed with at most that chance."""
    grid = np.linspace(-1, 1, 2001)
    return float(grid[np.argmax(miss_chance(grid, flips) <= chance)])


def found_by_codes(queries: DataFrame, rows: DataFrame, k: int, index: tuple[np.ndarray, int, int]) -> DataFrame:
    """(q, r, least, score, place): the k + 1 nearest rows found of each query; rows and queries are (id, embedding, ids)."""
    n, (_, far, flips) = rows.count(), index
    s = prefix_bits(n)
    table = written(postings(coded(rows, index), s), "postings")
    wide = _heavy(table, ROWS, "wide")
    asking = table.where("j = 0").select("id", "code").join(queries.select("id"), "id", "left_semi")
    first = asking.select("id", "code", F.lit(flips).alias("flips"), F.lit(-1).alias("seen"), F.lit(far).alias("reach"))
    best = written(_best(_scored(_retrieved(first, table, s, wide), queries, rows), k), "nearest")
    if flips < FLIPS:
        scored = best
        more = _retrieved(_next(_ends(scored, asking, k), far, flips), table, s, wide)
        best = written(_best(scored.drop("place").unionByName(_scored(more, queries, rows)), k), "nearest")
        dropped(scored)
    dropped(table)
    left = _ends(best, queries, k).where(F.col("last").isNull() | (F.col("last") < _lowest(FLIPS, LEFT))) if n > 1 else queries.where("false")
    left = written(left.drop("last"), "unfinished")
    if left.isEmpty():
        dropped(left)
        return best
    exact = written(_best(_compared(left, rows, k), k), "nearest")
    out = written(best.join(left.select(F.col("id").alias("q")), "q", "left_anti").unionByName(exact), "nearest")
    dropped(best, left, exact)
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    rows = rows.withColumn("ca", F.xxhash64("embedding")).withColumn("cb", F.xxhash64(F.lit(1), "embedding"))
    # Of equal vectors no answer holds more than k rows, none of them with the query's id: k rows of an id and 2 k in all will do.
    copy = F.row_number().over(Window.partitionBy("ca", "cb", "vec_id").orderBy("vec_id"))
    place = F.row_number().over(Window.partitionBy("ca", "cb").orderBy("vec_id"))
    few = rows.withColumn("_copy", copy).where(F.col("_copy") <= k).withColumn("_place", place).where(F.col("_place") <= 2 * k)
    classes = few.groupBy("ca", "cb").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    asking = written(rows.where("asks").select("vec_id", "ca", "cb").distinct(), "queries")
    found = None
    for (d,) in sorted(classes.select(F.size("embedding")).distinct().collect()):
        mine = classes.where(F.size("embedding") == d)
        wanted = mine.join(asking.select("ca", "cb").distinct(), ["ca", "cb"], "left_semi")
        part = found_by_codes(wanted, mine, k, fit_index(mine, d, k, mine.count())).select("q", "r", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    who = asking.join(classes.select("ca", "cb", F.col("id").alias("q")), ["ca", "cb"]).select(F.col("vec_id").alias("query_id"), "q")
    pairs = found.join(classes.select(F.col("id").alias("r"), "ids"), "r").join(who, "q").select("query_id", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.where("query_id <> vec_id").withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
