"""Which of many terms occur in many texts: a join on grams, then an exact test.

White space and case are ignored. Each term picks one gram of its squeezed text, the one that the fewest texts of a sample
hold (the sample changes the cost only), so common grams are met by few terms. Texts give each distinct gram that a filter
of the chosen ones lets through; these meet terms in an equi-join whose heavy grams Spark splits. Terms no longer than a gram are found by
that; for others the texts in question, equal ones once, are tested whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import dropped, written
from ..functions.scalars import squeezed, strip_space

GRAM, LEAST = 6, 3
#: Characters in a piece of a text, and one of how many texts is in the sample.
PIECE, SAMPLED = 1 << 20, 32
#: Bits of a place in the filter of grams.
FILTER = 23


def _places(points: np.ndarray, size: int) -> np.ndarray:
    """The place in the filter of the stretch of ``size`` characters from each character on."""
    n = len(points) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : n + k]
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FILTER)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _passing(text: str, sizes: list[int], words: np.ndarray, most: int) -> set[str]:
    """The distinct stretches of those sizes that the filter lets through, piece by piece; pieces overlap by a gram."""
    out = set()
    for at in range(0, len(text), most):
        piece = text[at : at + most + GRAM - 1]
        points = _points(piece)
        for size in sizes:
            place = _places(points, size)
            hit = np.flatnonzero((words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            out.update(piece[i : i + size] for i in hit.tolist())
    return out


def _exploded(rows: DataFrame, grams: Callable[[str], Iterable[str]]) -> DataFrame:
    """key, gram: the grams of rows (key, hay)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [list(grams(t)) for t in b["hay"].to_pylist()]
            key = b["key"].take(pa.array(np.repeat(np.arange(len(each)), [len(g) for g in each])))
            yield pa.RecordBatch.from_arrays([key, pa.array([g for some in each for g in some], pa.string())], ["key", "gram"])

    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return rows.select("key", "hay").mapInArrow(found, "key string, gram string")


def _filter(grams: DataFrame) -> np.ndarray:
    """A bit for the place of every gram, in words: 1 MB whatever their number. An exact join stands behind it."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.array([_places(_points(g), len(g))[0] for g in b["gram"].to_pylist()], np.uint64)
            bit = np.left_shift(np.uint64(1), place & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit)], ["word", "bit"])

    t = grams.select("gram").distinct().mapInArrow(placed, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER - 6), np.uint64)
    words[np.asarray(t["word"])] = np.asarray(t["bits"]).view(np.uint64)
    return words


def _text_grams(texts: DataFrame, sizes: list[int], wanted: DataFrame) -> DataFrame:
    """key, gram: of the grams of (key, hay), those that may be wanted (column gram)."""
    held = texts.sparkSession.sparkContext.broadcast(_filter(wanted))
    most = PIECE
    return _exploded(texts, lambda t: _passing(t, sizes, held.value, most))


def _own_grams(needle: str) -> set[str]:
    size = min(len(needle), GRAM)
    return {needle[i : i + size] for i in range(len(needle) - size + 1)}


def checked_terms(terms: DataFrame) -> DataFrame:
    """The distinct terms (trimmed, LEAST characters and more) with ``needle``, their squeezed text."""
    t = terms.select(strip_space(F.col("term")).alias("term")).where(F.length("term") >= LEAST).distinct()
    return t.withColumn("needle", squeezed(F.col("term"))).where("needle <> ''")


def terms_found(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct terms (column term) that occur in some text (column text), with any number of either.

    Null texts and terms hold and are nothing; a text of any length is read whole."""
    t = written(checked_terms(terms).withColumn("size", F.least(F.length("needle"), F.lit(GRAM))), "terms")
    sizes = [r["size"] for r in t.select("size").distinct().orderBy("size").collect()]  # GRAM values at most
    if not sizes:
        return t.select("term")
    # Texts may cost much to make (redaction), so they are squeezed once and read thrice.
    hays = written(texts.where("text is not null").select(F.md5("text").alias("key"), squeezed(F.col("text")).alias("hay")), "squeezed-texts")
    own = written(_exploded(t.select(F.col("term").alias("key"), F.col("needle").alias("hay")), _own_grams), "own-grams")
    sample = hays.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0)
    common = _text_grams(sample, sizes, own).join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram"))
    chosen = own.join(common, "gram", "left").groupBy(F.col("key").alias("term")).agg(rarest.alias("gram")).join(t.select("term", "needle"), "term")
    chosen = written(chosen, "chosen-grams")
    met = written(_text_grams(hays, sizes, chosen).join(chosen, "gram").select("key", "term", "needle").distinct(), "terms-to-test")
    dropped(own)
    short = F.length("needle") <= GRAM
    sure, asked = met.where(short).select("term").distinct(), met.where(~short)
    some = hays.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("hay").alias("hay"))
    tested = some.join(asked, "key").where(F.contains("hay", F.col("needle"))).select("term").distinct()
    return sure.unionByName(tested)
