"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its seeded-shuffled documents, repeated up to ``max_epochs``
times. A document's virtual finish time is the tokens its queue has sent when it ends,
divided by the source's weight. All queues together are cut into ranges of finish time,
ordered, and truncated where the budget ends. As a queue that runs dry leaves its share to
the others by weight, the served amounts follow the water-filled targets
``min(max_epochs * size, weight * V)``.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a
source of its own, after all others; repeated rows are separate documents and ties of the
shuffle are broken by doc_id, then by size; an empty table gives an empty result; further
columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import dropped, written
from ..functions.spread import buckets_for, shuffle_key, with_offsets

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Sources whose cuts are broadcast at most; beyond that they are joined like any table.
MOST_BROADCAST = 100_000


def words_in(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, total, level, target.

    Weights repeat over the sources by code point (null last). ``level`` is the virtual
    time V at which the budget is spent."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.row_number().over(by_name) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), at + 1).cast("long"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    s = s.withColumn("budget", F.floor(F.col("total") * F.lit(share)))
    s = s.withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("full_at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.col("budget") - capped) / rest).withColumn("_at", F.row_number().over(order))
    fits = F.when(F.col("_level") <= F.col("full_at"), F.struct("_at", "_level"))
    s = s.withColumn("level", F.coalesce(F.min(fits).over(Window.partitionBy(F.lit(0)))["_level"], F.max("full_at").over(Window.partitionBy(F.lit(0)))))
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).select("source", "source_size", "weight", "budget", "level", "target")


def queued(table: DataFrame, sized: DataFrame, rows: int, targets: DataFrame, seed: str) -> DataFrame:
    """``table`` with its source's target and ``sent``: the tokens that its queue has sent
    when the document ends in the first epoch. ``sized`` is the same table's doc_id, source
    and size."""
    n = buckets_for(rows)
    keyed = lambda x: x.withColumn("_key", shuffle_key(seed, "doc_id")).withColumn("_bucket", F.floor(F.col("_key") * n / F.lit(1 << 32)))
    t = keyed(table)
    sums = keyed(sized).groupBy("source", "_bucket").agg(F.sum("size").alias("_size"))
    sums = with_offsets(sums, ["source"], "_bucket", {"_size": "_before"})
    named = targets.withColumnRenamed("source", "_of")
    sums = sums.join(named, F.col("source").eqNullSafe(F.col("_of"))).select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "_before", "source_size", "weight", "level", "target"
    )
    t = t.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    run = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("sent", F.col("_before") + F.sum("size").over(run)).drop("_bucket", "_source", "_b", "_before")


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: str = "mix", keep_rows: bool = False) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, level, target, _key, sent, epochs, taken.

    ``epochs`` is how often the mix takes the document, ``taken`` its words times that.
    With ``keep_rows`` the input row comes along as the struct ``_doc``."""
    size = words_in(F.col("text")).alias("size")
    sized = written(docs.select("doc_id", "source", size), "sized")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sized, weights, share, max_epochs)
    narrow = queued(sized, sized, rows, targets, seed)
    out = queued(docs.select("doc_id", "source", size, F.struct("*").alias("_doc")), sized, rows, targets, seed) if keep_rows else narrow
    never = F.lit(0)
    if not total:
        return _counted(out, never)
    level, budget = targets.agg(F.max("level"), F.max("budget")).first()
    # One entry per document and epoch, ordered by (finish, source, doc_id, size, epoch).
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    entries = narrow.where("size > 0").select("source", "doc_id", "size", "weight", "sent", "source_size", epoch.alias("epoch"))
    entries = entries.withColumn("finish", _finish(F.col("epoch")))
    width = level / buckets_for(rows * max_epochs)
    entries = entries.withColumn("_range", F.floor(F.col("finish") / F.lit(width)))
    ranges = with_offsets(entries.groupBy("_range").agg(F.sum("size").alias("_size")), [], "_range", {"_size": "_before"})
    cut = ranges.where(F.col("_before") + F.col("_size") > budget).agg(F.min(F.struct("_range", "_before"))).first()[0]
    if cut is None:
        return _counted(out, F.when(F.col("size") > 0, F.lit(max_epochs)).otherwise(never))
    order = Window.partitionBy(F.lit(0)).orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "size", "epoch")
    edge = entries.where(F.col("_range") == cut["_range"]).withColumn("_sum", cut["_before"] + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("_place", F.row_number().over(order)).where(F.col("_sum") <= budget)
    end = edge.agg(F.max(F.struct("_place", "finish", "source", "doc_id", "size", "epoch"))).first()[0]

    def inside(e: int) -> Column:
        finish = _finish(F.lit(e))
        if end is None:
            return F.floor(finish / F.lit(width)) < cut["_range"]
        mine = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("doc_id"), F.col("size"), F.lit(e))
        last = F.struct(F.lit(end["source"] is None), F.lit(end["source"] or ""), F.lit(end["doc_id"]).cast("long"), F.lit(end["size"]).cast("long"), F.lit(end["epoch"]))
        return (finish < F.lit(end["finish"])) | ((finish == F.lit(end["finish"])) & (mine <= last))

    return _counted(out, sum((F.when((F.col("size") > 0) & inside(e), 1).otherwise(0) for e in range(max_epochs)), never))


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("sent")) / F.col("weight")


def _counted(q: DataFrame, epochs: Column) -> DataFrame:
    return q.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size")).cast("long"))


def _place(key: Column, size: Column) -> Column:
    """A document's place in its source's queue; rows with one place are copies of an id and size."""
    doc_id = F.col("doc_id")
    return F.struct(key.alias("key"), doc_id.isNotNull().alias("named"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("doc_id"), size.alias("size"))


def cuts(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = "mix", **options) -> DataFrame:
    """Per source (``of``) and epoch e: ``e{e}`` with the last place in the queue that the mix takes
    (``top``), how many rows have that place (``here``) and how many of them are taken (``in_mix``).

    A queue sends its documents in order, so the mix takes of each source the rows up to one place."""
    mix = fair_mix(docs, max_epochs=max_epochs, seed=seed, **options).where("size > 0")
    rows = written(mix.select("source", _place(F.col("_key"), F.col("size")).alias("place"), "epochs"), "places")
    each = range(max_epochs)
    tops = rows.groupBy(F.col("source").alias("of")).agg(*[F.max(F.when(F.col("epochs") > e, F.col("place"))).alias(f"t{e}") for e in each])
    tops = written(tops, "tops")
    few = tops.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    at_top = rows.join(F.broadcast(tops) if few else tops, F.col("source").eqNullSafe(F.col("of")))
    last = lambda e: F.col("place") == F.col(f"t{e}")
    sums = [F.struct(F.first(f"t{e}").alias("top"), F.sum(last(e).cast("long")).alias("here"), F.sum((last(e) & (F.col("epochs") > e)).cast("long")).alias("in_mix")).alias(f"e{e}") for e in each]
    out = written(at_top.groupBy("of").agg(*sums), "cuts")
    dropped(rows, tops)
    return out


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with its columns.

    Texts are not shuffled: the last place taken of each source and epoch is compared where a row is
    read. Where copies of an id and size share that place and only some are taken, those rows are
    counted (equal ones before any shuffle) and the first by their columns taken."""
    ends = cuts(docs, max_epochs, seed, **options)
    of = F.broadcast(ends) if ends.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else ends
    rows = docs.select(F.struct("*").alias("_doc"), F.col("source").alias("_source"), _place(shuffle_key(seed, "doc_id"), words_in(F.col("text"))).alias("_at"))
    rows = rows.where("_at.size > 0").join(of, F.col("_source").eqNullSafe(F.col("of")))
    partial = lambda e: F.col(f"e{e}.here") > F.col(f"e{e}.in_mix")
    taken = lambda e: (F.col("_at") < F.col(f"e{e}.top")) | ((F.col("_at") == F.col(f"e{e}.top")) & ~partial(e))
    times = sum((F.when(taken(e), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    out = rows.select("_doc", times.alias("_times")).where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc")
    for e in range(max_epochs):
        if ends.where(partial(e)).isEmpty():
            continue
        kinds = rows.where((F.col("_at") == F.col(f"e{e}.top")) & partial(e)).groupBy("_doc", "_source").agg(F.count("*").alias("_n"), F.first(f"e{e}.in_mix").alias("_left"))
        before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_doc").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        some = kinds.withColumn("_left", F.least("_n", F.col("_left") - before)).where("_left > 0")
        out = out.union(some.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left")))).select("_doc"))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def mix_in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with their ``epoch`` and ``finish``, range-sorted by finish time."""
    q = fair_mix(docs, keep_rows=True, **options).where("epochs > 0")
    q = q.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("finish", _finish(F.col("epoch")))
    return q.orderBy("finish", F.col("source").asc_nulls_last(), "doc_id", "size", "epoch").select("_doc.*", F.col("epoch").alias("mix_epoch"), F.col("finish").alias("mix_finish"))
