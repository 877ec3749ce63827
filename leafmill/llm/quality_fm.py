r"""Quality classifier: a factorisation machine.

A text becomes a sparse vector of hashed words (log counts over all its words, of unit
length) and of structure statistics and metadata (lengths, shares of byte classes, of repeated
words, lines and passages), scaled on the training sample. The machine scores

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with the pairwise part in linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 over the
factors. It is trained by adaptive gradient steps on the logistic loss.

Defined cases: a null, empty or wordless text has zero words and is scored by its statistics
alone; texts of any length are read to their end; repeated rows score alike; without
training documents of both kinds every score is 0; an empty table gives an empty result;
further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample, trained_in_a_task
from .ngram_join import small_batches
from .shingles import _COEF, byte_pieces, mix, word_digests

BUCKETS = 1 << 14
FACTORS = 8
#: The training sample is at most so many documents of each label.
MOST = {0: 1500, 1: 3000}
EPOCHS, BATCH, RATE, HOLD = 12, 64, 0.05, 1e-5

STATISTICS = (
    "log_words", "log_bytes", "bytes_a_word", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share",
    "stop_share", "high_share", "line_rate", "space_share", "distinct_share", "top_word_share", "next_same_share",
    "repeated_trigram_share", "bracket_share", "comma_share",
)
_CLASSES = {
    "upper_share": range(65, 91), "digit_share": range(48, 58), "symbol_share": b"#*$%&|<>", "bang_share": b"!", "bar_share": b"|",
    "stop_share": b".", "high_share": range(128, 256), "line_rate": b"\n", "space_share": b" \t\r\n", "bracket_share": b"{}[]();=_/\\", "comma_share": b",",
}
_MASKS = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES.values()):
    _MASKS[_i, list(_c)] = True


def _by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the distinct keys of each row, and the number of them by row."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[new], k[new], np.diff(np.append(new, len(r))), np.bincount(r[new], minlength=n)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row starts, buckets, values, statistics) of stretches of rows."""
    for first, raw, offsets in byte_pieces(texts):
        n = len(offsets) - 1
        size = np.diff(offsets)
        words, rows = word_digests(raw, offsets)
        count = np.bincount(rows, minlength=n)
        per = np.maximum(count, 1)
        stats = np.zeros((n, len(STATISTICS)))
        col = {name: i for i, name in enumerate(STATISTICS)}
        for name, mask in zip(_CLASSES, _MASKS, strict=True):
            stats[:, col[name]] = _by_row(mask[raw], offsets) / np.maximum(size, 1)
        stats[:, col["log_words"]], stats[:, col["log_bytes"]] = np.log1p(count), np.log1p(size)
        stats[:, col["bytes_a_word"]] = np.minimum(size / per, 50)
        r, k, c, distinct = _distinct(rows, words, n)
        stats[:, col["distinct_share"]] = distinct / per
        top = np.zeros(n)
        np.maximum.at(top, r, c)
        stats[:, col["top_word_share"]] = top / per
        if len(words) > 1:
            same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
            stats[:, col["next_same_share"]] = np.bincount(rows[1:][same], minlength=n) / per
        if len(words) > 2:
            three = mix(words[2:] * _COEF[0] + words[1:-1] * _COEF[1] + words[:-2] * _COEF[2])
            inside = rows[2:] == rows[:-2]
            *_, kinds = _distinct(rows[2:][inside], three[inside], n)
            stats[:, col["repeated_trigram_share"]] = 1 - kinds / np.maximum(np.bincount(rows[2:][inside], minlength=n), 1)
        value = np.log1p(c.astype(float))
        norm = np.sqrt(np.bincount(r, weights=value**2, minlength=n))
        starts = np.concatenate([[0], np.cumsum(distinct)])
        yield first, starts, (k >> np.uint64(50)).astype(np.int64), value / np.maximum(norm[r], 1e-12), stats


class Machine:
    """A factorisation machine over BUCKETS hashed words and the scaled statistics."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) * 0.5

    def raw(self, starts: np.ndarray, buckets: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Scores by the sum-of-squares identity."""
        n = len(starts) - 1
        rows = np.repeat(np.arange(n), np.diff(starts))
        d = dense.shape[1]
        out = self.w0 + dense @ self.w[-d:] + np.bincount(rows, weights=self.w[buckets] * values, minlength=n)
        vd = self.v[-d:]
        for f in range(self.v.shape[1]):
            x = self.v[buckets, f] * values
            total = np.bincount(rows, weights=x, minlength=n) + dense @ vd[:, f]
            squares = np.bincount(rows, weights=x * x, minlength=n) + (dense**2) @ (vd[:, f] ** 2)
            out += 0.5 * (total**2 - squares)
        return out


def _gather(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    sparse: list[tuple[np.ndarray, np.ndarray]] = []
    stats = []
    for _, starts, buckets, values, s in features(pa.array(texts, pa.string())):
        sparse += [(buckets[a:b], values[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        stats.append(s)
    return sparse, np.concatenate(stats)


def train(texts: dict[int, list[str]], seed: int = 7) -> Machine | None:
    """A machine from texts by label; None if a kind is missing."""
    if not texts.get(0) or not texts.get(1):
        return None
    sparse, stats = _gather(texts[0] + texts[1])
    y = np.array([0.0] * len(texts[0]) + [1.0] * len(texts[1]))
    m = Machine(0.0, np.zeros(BUCKETS + stats.shape[1]), np.zeros((BUCKETS + stats.shape[1], FACTORS)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    rng = np.random.default_rng(seed)
    m.v = rng.normal(0, 0.02, m.v.shape)
    dense = m.dense(stats)
    k = dense.shape[1]
    g0, gw, gv = 1e-8, np.full_like(m.w, 1e-8), np.full_like(m.v, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            starts = np.concatenate([[0], np.cumsum([len(sparse[i][0]) for i in pick])])
            b, x = np.concatenate([sparse[i][0] for i in pick]), np.concatenate([sparse[i][1] for i in pick])
            rows = np.repeat(np.arange(len(pick)), np.diff(starts))
            e = (1 / (1 + np.exp(-np.clip(m.raw(starts, b, x, dense[pick]), -30, 30))) - y[pick]) / len(pick)
            total = np.stack([np.bincount(rows, weights=m.v[b, f] * x, minlength=len(pick)) for f in range(FACTORS)], 1) + dense[pick] @ m.v[-k:]
            used, where = np.unique(b, return_inverse=True)
            n = len(used)
            dw = np.bincount(where, weights=e[rows] * x, minlength=n) + HOLD * m.w[used]
            xx = np.bincount(where, weights=e[rows] * x * x, minlength=n)
            dv = np.stack([np.bincount(where, weights=e[rows] * x * total[rows, f], minlength=n) for f in range(FACTORS)], 1) - xx[:, None] * m.v[used] + HOLD * m.v[used]
            tail = np.arange(len(m.w) - k, len(m.w))
            used, dw = np.concatenate([used, tail]), np.concatenate([dw, dense[pick].T @ e])
            dv = np.concatenate([dv, (dense[pick] * e[:, None]).T @ total - ((dense[pick] ** 2).T @ e)[:, None] * m.v[-k:]])
            g0 += e.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            m.w0 -= RATE * e.sum() / np.sqrt(g0)
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
    return m


def learn_quality(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST) -> Machine | None:
    """The machine of the labelled documents outside the held-out fifth."""

    def parts(texts: dict[int, list[str]]) -> tuple | None:
        m = train(texts)
        return m and (m.w0, m.w, m.v, m.mean, m.scale)

    machine = trained_in_a_task(labelled_sample(docs, labels, "quality", most, "quality"), parts)
    return machine and Machine(*machine)


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` as the struct ``_doc`` with their ``score``."""
    small_batches(docs)
    table = docs.select(F.struct("*").alias("_doc"), "text")
    schema = f"_doc {table.schema['_doc'].dataType.simpleString()}, score double"
    held = docs.sparkSession.sparkContext.broadcast(machine and (machine.w0, machine.w, machine.v, machine.mean, machine.scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value and Machine(*held.value)
        for b in batches:
            out = np.zeros(b.num_rows)
            if m is not None:
                for first, starts, buckets, values, stats in features(b.column(1)):
                    raw = m.raw(starts, buckets, values, m.dense(stats))
                    out[first : first + len(raw)] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["_doc", "score"])

    return table.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) for every document."""
    s = scored(docs.select("doc_id", "text"), learn_quality(docs, labels))
    return s.select("_doc.doc_id", held_out(F.col("_doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
