r"""Near-duplicate documents by an n-gram Jaccard join: a blocked sparse product.

Documents times shingles is a sparse 0/1 matrix M, and M times its transpose holds all
overlaps. Only the blocks that can hold an overlap large enough are multiplied:

1. Texts with one and the same shingle set are one row of M (a class).
2. The first block of columns takes those whose digest is small. Of two rows with
   similarity t, the smaller (n shingles) lacks at most e = floor(n (1 - t) / (1 + t)) of its
   columns in the larger. So it need only be looked up in e + 1 of its columns: those
   with the fewest rows, counted over all documents. A row with more than e columns of its
   own alone needs none, which rules out documents that share passages only. A larger row
   is found in all its columns of the block. (Where a row has fewer than e + 1 columns in the
   block, the classical prefix of n - ceil(t n) + 1 columns of both stands in.)
3. Columns are cut by size: a row stands in its own class of sizes (each 1 / t times the one
   before) and is looked up in that and the next. So rows meet only rows of like size, and no
   pair of rows is written: an aggregate by (column, size class) tells who meets anyone.
4. The rows that meet are read in full. A row shares t n columns with some other of them at
   least, and as the smaller row of a link all but e; the others go.
5. Meeting rows form groups. A group is cut into blocks of bounded size, and each two blocks are
   multiplied, some columns at a time: overlap counts accumulate, and pairs whose count cannot
   reach ceil(t / (1 + t) (n_a + n_b)) any more are discarded. What leaves a block is the
   number of links of each row and a spanning forest of them, never the pairs.
6. Components come from the forest by large-star and small-star steps.

So no link between different texts is lost, while copies are never expanded into all pairs.

Defined cases: a null text or one without words has no shingles and stands alone; fewer than
five words are one shingle; rows that repeat a doc_id with one text are one node; rows without doc_id
take no part and get a null component; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from ..functions.durable import dropped, written
from .shingles import least_overlap, mix, shingle_sets

PERCENT = 80
#: Rows and shingles in a block of a group, about; columns multiplied at a time; what a pair by
#: itself costs, in pairs of a dense product.
BLOCK, BLOCK_SHINGLES, WIDE, PAIR_COST = 2048, 1 << 20, 2048, 20
#: The Bloom filter that spares reading texts in full: 16 bits an id, 32 MB at most.
FILTER_WORDS, FILTER_HASHES = 1 << 22, 4


def small_batches(df: DataFrame) -> None:
    """Arrow batches of whole texts stay small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64, copy=False))


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if a is None else len(a) for a in arrays], np.int64)
    flat = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.uint64)])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([a is None for a in arrays] + [False]))
    return pa.ListArray.from_arrays(offsets, _i64(flat))


def set_digests(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two digests that identify a set of shingles; the first is the id of its class."""
    return mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)


def block_part(n: int) -> float:
    """The part of the digests that the first block takes of a row of n shingles."""
    return 1.0 if n <= 40 else min(1.0, 0.15 + 1.2 / n**0.5)


def shingle_rows(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, fa, fb, tokens, x, quota for every document.

    (fa, fb) identify the set. ``tokens`` are the row's columns in the first block, by digest;
    null where the task has met the set before and in rows without doc_id. The first ``x`` of them may be looked up, and
    ``quota`` of those must be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for b in batches:
            m = b.num_rows
            n, x, quota = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
            fa, fb = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            tokens: list[np.ndarray | None] = [None] * m
            named = np.asarray(b.column(0).is_valid())
            for r, s in shingle_sets(b.column(1)):
                k = n[r] = len(s)
                fa[r], fb[r] = set_digests(s)
                prefix = k - least_overlap(k, percent) + 1
                need = k * (100 - percent) // (100 + percent) + 1
                inside = lambda part, s=s: int(np.searchsorted(s, np.uint64(min(part * 2.0**64, 2.0**64 - 2048)), "right")) if part < 1 else len(s)
                own = inside(block_part(k * 100 // percent + 1))
                x[r], quota[r] = (own, need) if own >= need else (prefix, prefix)
                key = (int(fa[r]), int(fb[r]))
                if key in met or not named[r]:
                    continue
                if len(met) < 1 << 18:
                    met.add(key)
                tokens[r] = s[: max(prefix, inside(block_part(k)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), _i64(n), _i64(fa), _i64(fb), _lists(tokens), _i64(x), _i64(quota)], ["doc_id", "n", "fa", "fb", "tokens", "x", "quota"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, fa long, fb long, tokens array<long>, x long, quota long")


def looked_up(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, cid, n): the columns in which each row is looked up.

    ``shared`` holds (h, cid, n2, rows), the columns that several rows have; ``classes`` has cid, x, quota."""
    # Of its x columns a row has x - mine alone; they count among its quota.
    mine = shared.where("n2 % 2 = 1").withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("rows", "h")))
    mine = mine.withColumn("mine", F.count("*").over(Window.partitionBy("cid")))
    looked = mine.join(classes.select(F.col("cid").alias("_cid"), "x", "quota"), F.col("cid") == F.col("_cid"))
    return looked.where("place <= quota - (x - mine)").select("h", "cid", F.expr("n2 div 2").alias("n"))


def size_class(n: Column, percent: int) -> Column:
    """Sizes of one class, or of two that follow each other, hold every two sizes that can be linked."""
    return F.floor(F.log(n) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("int")


def meetings(shared: DataFrame, looked: DataFrame, percent: int) -> DataFrame:
    """(h, s, cid, n, asks): the rows that meet another in column h and size class s, as those
    looked up (asks) and as those found."""
    s = size_class(F.col("n"), percent)
    asks = looked.select("h", F.explode(F.array(s, s + 1)).alias("s"), "cid", "n")
    by = ["h", "s"]
    # Sums by column are written before they are joined: then both sides are plain shuffles, and a column
    # that very many rows have can be split between tasks.
    asked = written(asks.groupBy(*by).agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")), "asked")
    rows = shared.select("h", "cid", F.expr("n2 div 2").alias("n")).select("h", s.alias("s"), "cid", "n")
    other = (F.col("lo") != F.col("cid")) | (F.col("hi") != F.col("cid"))
    fits = (F.col("n") >= F.col("least")) & (F.col("n") * percent <= F.col("most") * 100)
    found = written(rows.join(asked, by).where(other & fits).select(*by, "cid", "n"), "found")
    met = written(found.groupBy(*by).agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")), "met")
    asking = asks.join(met, by).where(other).select(*by, "cid", "n", F.lit(True).alias("asks"))
    out = written(found.withColumn("asks", F.lit(False)).union(asking), "meetings")
    dropped(asked, found, met)
    return out


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids (doc_id), of a power of two of 64-bit words, FILTER_WORDS at most.

    Built by a grouped bit_or; no more rows than words reach the driver. It only spares work: an
    exact join drops what it lets through by chance."""
    size = 1
    while size < FILTER_WORDS and size * 4 < ids.count():
        size *= 2
    spots = F.array(*[_spot(k, size) for k in range(FILTER_HASHES)])
    spot = ids.select(F.explode(spots).alias("p"))
    words = spot.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size, np.int64)
    out[np.asarray(words["w"])] = np.asarray(words["bits"])
    return out.view(np.uint64)


def _spot(k: int, words: int) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit(k)).bitwiseAND(F.lit(words * 64 - 1))


def full_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, s): the shingle sets of the classes in ``wanted`` (cid, class_id), some of them repeated.

    The texts are not shuffled: each task passes over those that a filter does not know."""
    words = id_filter(wanted.select(F.col("class_id").alias("doc_id")))
    held = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = held.value, set()
        for b in batches:
            known = np.ones(b.num_rows, bool)
            for k in range(FILTER_HASHES):
                p = np.asarray(b.column(1 + k)).astype(np.uint64)
                known &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            some = b.filter(pa.array(known))
            sets: list[np.ndarray] = []
            cid: list[np.uint64] = []
            for _, s in shingle_sets(some.column(0)):
                c = set_digests(s)[0]
                if c not in met:
                    sets.append(s)
                    cid.append(c)
                    if len(met) < 1 << 18:
                        met.add(c)
            yield pa.RecordBatch.from_arrays([_i64(np.array(cid, np.uint64)), _lists(sets)], ["cid", "s"])

    table = docs.where("doc_id is not null and text is not null").select("text", *[_spot(k, len(words)).alias(f"p{k}") for k in range(FILTER_HASHES)])
    return table.mapInArrow(rows, "cid long, s array<long>").join(wanted.select("cid"), "cid", "left_semi")


def still_open(meets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``meets`` without the rows that share too few of all their columns with the others of ``sets``.

    Both rows of a link are among ``sets``, so a row's columns that another of them has too bound its overlaps."""
    columns = sets.select("cid", F.explode("s").alias("h"))
    twice = written(columns.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select(F.col("h").alias("_h")), "twice")
    can = columns.join(twice.hint("shuffle_hash"), F.col("h") == F.col("_h")).groupBy("cid").agg(F.count("*").alias("m"))
    enough = F.when(F.col("asks"), (F.col("n") - F.col("m")) * (100 + percent) <= F.col("n") * (100 - percent)).otherwise(F.col("m") * 100 >= F.col("n") * percent)
    left = written(meets.join(can, "cid").where(enough).select("h", "s", "cid", "asks"), "open")
    dropped(twice)
    return left


def grouped(meets: DataFrame) -> DataFrame:
    """(node, component): the rows that meet, directly or through others."""
    first = F.min(F.when(F.col("asks"), F.col("cid"))).alias("v")
    buckets = meets.groupBy("h", "s").agg(first, F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("v is not null and lo <> hi")
    buckets = written(buckets.select("h", "s", "v"), "buckets")
    out = connected_components(meets.join(buckets, ["h", "s"]).select(F.col("cid").alias("u"), "v"))
    dropped(buckets)
    return out


def cells_of(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, p, q, cid, block, s), sorted by (g, p, q): each group in blocks of about BLOCK rows and
    BLOCK_SHINGLES shingles, and a cell for every two blocks."""
    rows = sets.join(groups.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid")
    sizes = groups.select(F.col("node").alias("cid"), F.col("component").alias("g")).join(sets.select("cid", F.size("s").alias("n")), "cid")
    blocks = sizes.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    rows = rows.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "cid", "block", "s")
    return rows.repartition("g", "p", "q").sortWithinPartitions("g", "p", "q")


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """(cid, other, links) of the links between the rows of each cell: how many each row has, and
    edges (links null) that join the linked rows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, ...] | None = None
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            key = np.column_stack([np.asarray(b.column(i)) for i in range(3)])
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
            for at, to in zip(begin, [*begin[1:], len(key)], strict=True):
                if tuple(key[at]) != last and held:
                    made += links_of(held, last)
                    held = []
                last = tuple(key[at])
                held.append(b.slice(at, to - at))
            if sum(len(x[0]) for x in made) > 1 << 14:
                yield batch_of(made)
                made = []
        if held:
            made += links_of(held, last)
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cid, other, links = (np.concatenate(x) for x in zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([_i64(cid), _i64(other), pa.array(links, mask=links < 0)], ["cid", "other", "links"])

    def links_of(held: list[pa.RecordBatch], key: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, p, q = key
        cid, once = np.unique(np.concatenate([np.asarray(b.column(3)) for b in held]), return_index=True)
        block = np.concatenate([np.asarray(b.column(4)) for b in held])[once]
        sets = [x for b in held for x in _parts(b.column(5))]
        sets = [sets[i] for i in once]
        x, y = linked_pairs(sets, np.flatnonzero(block == p), np.flatnonzero(block == q), percent)
        if not len(x):
            return []
        m = len(cid)
        root = np.arange(m)
        while True:
            down = root.copy()
            least = np.minimum(root[x], root[y])
            np.minimum.at(down, x, least)
            np.minimum.at(down, y, least)
            down = down[down]
            if (down == root).all():
                break
            root = down
        count = np.bincount(x, minlength=m) + np.bincount(y, minlength=m)
        some, edge = np.flatnonzero(count), np.flatnonzero(root != np.arange(m))
        return [(cid[some], cid[some], count[some].astype(np.int64)), (cid[edge], cid[root[edge]], np.full(len(edge), -1))]

    return cells.mapInArrow(meet, "cid long, other long, links long")


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def linked_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links between the rows ``a`` and the rows ``b`` of ``sets`` (each pair once, if ``a`` is ``b``).

    The product of both blocks, WIDE columns at a time: pairs whose count cannot reach the
    bound any more are discarded, and rows without pairs; few pairs left are counted one by one."""
    n = np.array([len(s) for s in sets])
    todo = 100 * np.minimum.outer(n[a], n[b]) >= percent * np.maximum.outer(n[a], n[b])
    if len(a) == len(b) and (a == b).all():
        todo &= np.less.outer(a, b)
    shared = np.zeros(todo.shape, np.float32)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def narrowed() -> None:
        nonlocal a, b, todo, shared
        i, j = todo.any(axis=1), todo.any(axis=0)
        if not (i.all() and j.all()):
            a, b, todo, shared = a[i], b[j], todo[np.ix_(i, j)], shared[np.ix_(i, j)]

    def few() -> bool:
        return int(todo.sum()) * PAIR_COST <= todo.size or todo.size < 64

    narrowed()
    if len(a) and not few():
        values = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), n)
        _, at, times = np.unique(values, return_inverse=True, return_counts=True)
        keep = times[at] > 1
        at, row = (np.cumsum(times > 1) - 1)[at[keep]], row[keep]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        left = np.bincount(row, minlength=len(sets))
        columns = int((times > 1).sum())
        for c in range(0, columns, WIDE):
            bound = (percent * np.add.outer(n[a], n[b]) + percent + 99) // (100 + percent)
            todo &= shared + np.minimum.outer(left[a], left[b]) >= bound
            narrowed()
            if not len(a) or few():
                break
            lo, hi = np.searchsorted(at, (c, c + WIDE))
            dense = np.zeros((len(sets), min(WIDE, columns - c)), np.float32)
            dense[row[lo:hi], at[lo:hi] - c] = 1
            shared += dense[a] @ dense[b].T
            left = left - np.bincount(row[lo:hi], minlength=len(sets))
        else:
            x, y = np.nonzero(todo)
            s = shared[x, y].astype(np.int64)
            ok = 100 * s >= percent * (n[a[x]] + n[b[y]] - s)
            found.append((a[x[ok]], b[y[ok]]))
            todo = todo[:0]
    x, y = np.nonzero(todo)
    if len(x):
        pairs = zip(a[x], b[y], strict=True)
        s = np.array([int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum()) for u, v in ((sets[i], sets[j]) for i, j in pairs)])
        ok = 100 * s >= percent * (n[a[x]] + n[b[y]] - s)
        found.append((a[x[ok]], b[y[ok]]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([x for x, _ in found] or [none]), np.concatenate([y for _, y in found] or [none]))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, class_links for every document.

    ``class_id`` is the smallest doc_id of the same shingle set, ``class_links`` the number of
    other classes that are linked to that class."""
    named = F.col("doc_id").isNotNull()
    return labelled_rows(docs, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("class_links", F.lit(0)).cast("long").alias("class_links"),
    )


def labelled_rows(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, fa, fb, class_id, component, class_links for every document; rows without doc_id
    have the last three too if another row of their set has one."""
    small_batches(docs)
    rows = written(shingle_rows(docs, percent), "shingle-rows")
    of_class = rows.where("n > 0 and doc_id is not null").groupBy("fa", "fb", "n", "x", "quota")
    classes = of_class.agg(F.min("doc_id").alias("class_id"), F.first("tokens", ignorenulls=True).alias("tokens"))
    classes = written(classes.withColumn("cid", F.col("fa")), "classes")
    keys = classes.drop("tokens")
    entries = classes.select(F.posexplode("tokens").alias("pos", "h"), "cid", "n", "x").select("h", "cid", (F.col("n") * 2 + (F.col("pos") < F.col("x")).cast("long")).alias("n2"))
    counts = written(entries.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("h").alias("_h"), "rows"), "counts")
    shared = written(entries.join(counts.hint("shuffle_hash"), F.col("h") == F.col("_h")).select("h", "cid", "n2", "rows"), "shared")
    dropped(counts)
    looked = written(looked_up(shared, keys), "looked-up")
    meets = meetings(shared, looked, percent)
    dropped(shared, looked)
    wanted = written(keys.select("cid", "class_id").join(meets.select("cid").distinct(), "cid", "left_semi"), "wanted")
    sets = written(full_rows(docs, wanted), "sets")
    left = still_open(meets, sets, percent)
    dropped(meets, wanted)
    groups = grouped(left)
    dropped(left)
    found = written(cell_links(cells_of(groups, sets), percent), "cell-links")
    dropped(groups, sets)
    labels = connected_components(found.where("links is null").select(F.col("cid").alias("u"), F.col("other").alias("v")))
    linked = found.where("links is not null").groupBy("cid").agg(F.sum("links").alias("class_links"))
    # The component's id is the smallest doc_id of its classes.
    of = labels.withColumnRenamed("node", "cid").join(keys.select("cid", "class_id"), "cid")
    of = of.join(of.groupBy("component").agg(F.min("class_id").alias("least")), "component").select("cid", F.col("least").alias("component"))
    of = keys.select("fa", "fb", "n", "cid", "class_id").join(of, "cid", "left").join(linked, "cid", "left")
    of = written(of.select("fa", "fb", "n", "class_id", F.coalesce("component", "class_id").alias("component"), "class_links"), "class-labels")
    dropped(classes, found, labels)
    return rows.select("doc_id", "n", "fa", "fb").join(of, ["fa", "fb", "n"], "left").select("doc_id", "n", "fa", "fb", "class_id", "component", "class_links")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id.

    Rows without doc_id stay if no row with one has their set, one row for each set; a row without
    id and words stands alone. Where an id is on several rows, the rows are told apart by their sets."""
    rows = written(labelled_rows(docs, percent).select("doc_id", "n", "fa", "fb", "component"), "labelled")
    empty = F.col("n") == 0
    group = F.coalesce("component", "doc_id")
    kept = rows.where("doc_id is not null").groupBy(group.alias("group"), empty.alias("empty")).agg(F.min(F.struct("doc_id", "fa", "fb")).alias("k")).select("k.*")
    kept = kept.union(rows.where("doc_id is null and component is null").select("doc_id", "fa", "fb").distinct())
    kept = written(kept, "kept")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("_id"))
    several = written(several, "repeated-ids")
    single = kept.where("doc_id is not null").select(F.col("doc_id").alias("_id")).join(several, "_id", "left_anti")
    of = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_mine"), "text")
    out = of.join(single, F.col("_mine") == F.col("_id"), "left_semi").select("_doc")
    again = of.where("_mine is null").union(of.join(several, F.col("_mine") == F.col("_id"), "left_semi"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fa, fb = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for r, s in shingle_sets(b.column(2)):
                fa[r], fb[r] = set_digests(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _i64(fa), _i64(fb)], ["_doc", "_mine", "text", "_fa", "_fb"])

    schema = StructType(again.schema.fields + [StructField("_fa", LongType()), StructField("_fb", LongType())])
    again = again.mapInArrow(digests, schema)
    lone = (F.col("_mine").isNull()) & (F.col("_fa") == 0) & (F.col("_fb") == 0)
    same = F.col("_mine").eqNullSafe(F.col("doc_id")) & (F.col("_fa") == F.col("fa")) & (F.col("_fb") == F.col("fb"))
    chosen = again.where(~lone).join(kept, same, "left_semi").groupBy("_mine", "_fa", "_fb").agg(F.min_by("_doc", F.coalesce("text", F.lit(""))).alias("_doc"))
    out = out.union(chosen.select("_doc")).union(again.where(lone).select("_doc"))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
