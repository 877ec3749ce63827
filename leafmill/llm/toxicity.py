r"""Toxicity by compression distance.

The windows of a text are its words; each is written as 8-byte digests of its beginnings of 2 to 8
bytes and of the whole word, so that words of one stem share a beginning (a word's own bytes are too few for
their compressed length to tell anything). Two zstandard dictionaries compress every window. The ordinary one is made of the
windows that the most ordinary documents hold. As most of a toxic document is ordinary text, the toxic one is made of
the windows that are LIFT times as frequent in toxic documents as in ordinary ones, those of the most documents last, where
they are cheapest to name. Both leave out windows of a single document if there are others.

The evidence of a window is the logarithm of how much more frequent its pair of compressed lengths is in toxic than in
ordinary documents, counted across FOLDS: each fold's lengths are under dictionaries that have not seen it. A document's
largest evidence, its sum above ln NEED and its number of words go into a logistic curve, fitted
across the folds, so that a score of 0.5 is the calibrated threshold.

Training text is cleaned first: documents that largely repeat earlier ones are left out, and
words in five-word passages that several documents share are not learned from. A document counts once for each of its
windows. The table of evidence takes lengths over LENGTHS and savings beyond half of SAVINGS as those limits.

Defined cases: a null, empty or wordless text has no evidence and score 0; texts of any length are
read to their end; repeated rows score alike; without training documents
of both kinds every score is 0; an empty table gives an empty result; further columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample, trained_in_a_task
from .ngram_join import small_batches
from .shingles import _COEF, _LOWER, _VALUE, WIDTH, _power, byte_pieces, mix, shingle_sets, word_spans

SHORTEST, LONGEST = 2, 8
LEVEL = 5
ORDINARY_BYTES, TOXIC_BYTES = 112 << 10, 16 << 10
FOLDS, LIFT, NEED = 4, 4.0, 2.0
#: Lengths and savings that the table of evidence tells apart.
LENGTHS, SAVINGS = 96, 128
#: The training sample is at most so many documents of each kind.
MOST = {1: 1000, 0: 2000}
#: Words whose evidence a task remembers; then it begins anew.
REMEMBERED = 1 << 20


def word_windows(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The window of each word that begins at ``starts`` with ``sizes`` bytes."""
    ends = np.cumsum(sizes)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    value = _VALUE[_LOWER[raw[np.repeat(starts, sizes) + within]]] * _power(int(sizes.max(initial=0)) + 1)[within]
    sums = np.cumsum(value)
    before = np.concatenate([np.zeros(1, np.uint64), sums])[ends - sizes]
    last = np.zeros(len(value), bool)
    last[ends - 1] = True
    pick = ((within >= SHORTEST - 1) & (within < LONGEST)) | last
    code = mix(sums - np.repeat(before, sizes))
    code[last] = mix(code[last] ^ np.uint64(0x5DEECE66D))
    cut = np.concatenate([[0], np.cumsum(pick)[ends - 1]]) * 8
    data = code[pick].tobytes()
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def lengths(c: zstd.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    """The compressed length of each window."""
    if not windows:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, windows), np.int64, len(windows))
    segments = np.column_stack([np.cumsum(size) - size, size]).astype(np.uint64).tobytes()
    out = c.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(windows), segments), threads=1)
    return np.fromiter((len(x) for x in out), np.int64, len(windows))


def cells(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The cell of the evidence table for each pair of lengths."""
    return np.minimum(ordinary, LENGTHS - 1) * SAVINGS + np.clip(ordinary - toxic + SAVINGS // 2, 0, SAVINGS - 1)


@dataclass
class ToxicityModel:
    """Both dictionaries, the evidence of each cell and the calibration (weights of the largest
    evidence, of the logarithms of its sum and of the words, and the shift)."""

    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:3] + self.weights[3]
        return np.where(features[:, 2] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


class Evidence:
    """The evidence of words, each distinct one compressed once."""

    def __init__(self, ordinary: bytes, toxic: bytes, table: np.ndarray):
        self.ordinary, self.toxic, self.table = compressor(ordinary), compressor(toxic), table
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)

    def of_windows(self, windows: list[bytes]) -> np.ndarray:
        return self.table[cells(lengths(self.ordinary, windows), lengths(self.toxic, windows))]

    def features(self, texts: pa.Array) -> np.ndarray:
        """(largest evidence, ln(1 + sum above ln NEED), ln(1 + words)) of each text."""
        out = np.zeros((len(texts), 3))
        for first, raw, offsets in byte_pieces(texts):
            digest, row, starts, sizes = word_spans(raw, offsets)
            if not len(digest):
                continue
            word, at, which = np.unique(digest, return_index=True, return_inverse=True)
            place = np.minimum(np.searchsorted(self.known, word), max(len(self.known) - 1, 0))
            new = self.known[place] != word if len(self.known) else np.ones(len(word), bool)
            if new.any():
                value = self.of_windows(word_windows(raw, starts[at[new]], sizes[at[new]]))
                if len(self.known) > REMEMBERED:
                    keep = place[~new]
                    self.known, self.value = self.known[keep], self.value[keep]
                known, order = np.unique(np.concatenate([self.known, word[new]]), return_index=True)
                self.known, self.value = known, np.concatenate([self.value, value])[order]
                place = np.searchsorted(self.known, word)
            out[first : first + len(offsets) - 1] = document_features(self.value[place][which], row, len(offsets) - 1)
        return out


def document_features(evidence: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    most = np.zeros(rows)
    np.maximum.at(most, row, evidence)
    above = np.bincount(row, weights=np.maximum(evidence - np.log(NEED), 0), minlength=rows)
    return np.column_stack([most, np.log1p(above), np.log1p(np.bincount(row, minlength=rows))])


def _distinct(texts: list[str]) -> list[str]:
    """Texts less those of which a fifth and more repeats earlier ones."""
    met: set[int] = set()
    out = []
    for r, s in shingle_sets(pa.array(texts, pa.string())):
        mine = set(s.tolist())
        if 5 * len(mine & met) <= len(mine):
            out.append(texts[r])
        met |= mine
    return out


def _training_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct windows, and the (number of a window, text) that are learned from, each once."""
    digests, rows, windows, seen = [], [], [], {}
    for first, raw, offsets in byte_pieces(pa.array(texts, pa.string())):
        d, r, starts, sizes = word_spans(raw, offsets)
        digests.append(d)
        rows.append(r + first)
        word, at = np.unique(d, return_index=True)
        new = np.array([w not in seen for w in word.tolist()], bool)
        windows += word_windows(raw, starts[at[new]], sizes[at[new]])
        seen.update(zip(word[new].tolist(), range(len(seen), len(seen) + int(new.sum())), strict=True))
    d, r = np.concatenate(digests), np.concatenate(rows)
    word, which = np.unique(d, return_inverse=True)
    number = np.array([seen[w] for w in word.tolist()], np.int64)[which]
    fresh = np.ones(len(d), bool)
    if len(d) >= WIDTH:
        m = len(d) - WIDTH + 1
        passage = mix(sum(d[j : m + j] * _COEF[j] for j in range(WIDTH)))
        whole = r[WIDTH - 1 :] == r[:m]
        _, which = np.unique(passage, return_inverse=True)
        low, high = np.full(which.max() + 1, len(texts)), np.full(which.max() + 1, -1)
        np.minimum.at(low, which[whole], r[:m][whole])
        np.maximum.at(high, which[whole], r[:m][whole])
        shared = whole & (low[which] != high[which])
        for j in range(WIDTH):
            fresh[j : m + j] &= ~shared
    pairs = np.unique(number[fresh] * len(texts) + r[fresh])
    return windows, pairs // len(texts), pairs % len(texts)


def _dictionary(windows: list[bytes], counts: np.ndarray, size: int) -> bytes:
    """The windows with the largest counts, the largest last."""
    some = np.flatnonzero(counts >= 2)
    some = some if len(some) else np.flatnonzero(counts)
    return b"".join(windows[i] for i in some[np.argsort(counts[some], kind="stable")])[-size:]


def _dictionaries(windows: list[bytes], usual: np.ndarray, found: np.ndarray, documents: tuple[int, int]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from how many ordinary and toxic documents hold each window."""
    more = (found + 0.5) * documents[0] >= LIFT * (usual + 0.5) * documents[1]
    return _dictionary(windows, usual, ORDINARY_BYTES), _dictionary(windows, np.where(more, found, 0), TOXIC_BYTES)


def _evidence(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """ln(rate in toxic / rate in ordinary text) of each cell from the counts of words, shrunk
    towards the ratio of all cells of one saving where that is below 1, else towards 1."""
    alike = toxic.sum() / ordinary.sum()
    by_saving = lambda x: x.reshape(LENGTHS, SAVINGS).sum(0)
    usual = np.minimum((by_saving(toxic) + 1) / (by_saving(ordinary) * alike + 1), 1)
    return np.log((toxic + 5 * np.tile(usual, LENGTHS)) / (ordinary * alike + 5))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and shift of a logistic curve by Newton steps, lightly held."""
    a = np.column_stack([x, np.ones(len(x))])
    b, hold = np.zeros(a.shape[1]), np.array([1e-2] * x.shape[1] + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + np.diag(hold)
        step = np.linalg.solve(h, a.T @ (y - p) - hold * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(texts: dict[int, list[str]]) -> ToxicityModel | None:
    """A model from texts by label; None if a kind is missing."""
    toxic, ordinary = _distinct(texts.get(1, [])), _distinct(texts.get(0, []))
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    documents = toxic + ordinary
    windows, word, row = _training_words(documents)
    is_toxic, fold = np.arange(len(documents)) < len(toxic), np.arange(len(documents)) % FOLDS
    counted = lambda of: np.bincount(word[of[row]], minlength=len(windows))
    usual, found = ([counted(kind & (fold == f)) for f in range(FOLDS)] for kind in (~is_toxic, is_toxic))
    unseen, cell = [], []
    for f in range(FOLDS):
        rest = int((~is_toxic & (fold != f)).sum()), int((is_toxic & (fold != f)).sum())
        unseen.append(_dictionaries(windows, sum(usual) - usual[f], sum(found) - found[f], rest))
        cell.append(cells(*(lengths(compressor(d), windows) for d in unseen[f])))
    table = _evidence(*(sum(np.bincount(cell[f], weights=c[f], minlength=LENGTHS * SAVINGS) for f in range(FOLDS)) for c in (found, usual)))
    features = np.zeros((len(documents), 3))
    for f in range(FOLDS):
        held = np.flatnonzero(fold == f)
        features[held] = Evidence(*unseen[f], table).features(pa.array([documents[i] for i in held], pa.string()))
    weights = _logistic(features, is_toxic.astype(float))
    return ToxicityModel(*_dictionaries(windows, sum(usual), sum(found), (len(ordinary), len(toxic))), table, weights)


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST) -> ToxicityModel | None:
    """The model of the labelled documents outside the held-out fifth."""

    def parts(texts: dict[int, list[str]]) -> tuple | None:
        model = train(texts)
        return model and astuple(model)

    model = trained_in_a_task(labelled_sample(docs, labels, "toxic", most, "toxicity"), parts)
    return model and ToxicityModel(*model)


def scored(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of ``docs`` as the struct ``_doc`` with ``distance`` (the largest evidence) and ``score``."""
    small_batches(docs)
    table = docs.select(F.struct("*").alias("_doc"), "text") if "text" in docs.columns else docs
    schema = f"_doc {docs.select(F.struct('*').alias('_doc')).schema['_doc'].dataType.simpleString()}, distance double, score double"
    held = docs.sparkSession.sparkContext.broadcast(model and astuple(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value and ToxicityModel(*held.value)
        evidence = m and Evidence(m.ordinary, m.toxic, m.evidence)
        for b in batches:
            x = evidence.features(b.column(1)) if m else np.zeros((b.num_rows, 3))
            s = m.scores(x) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(s)], ["_doc", "distance", "score"])

    return table.mapInArrow(score, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, distance for every document."""
    s = scored(docs.select("doc_id", "text"), learn_toxicity(docs, labels))
    return s.select("_doc.doc_id", held_out(F.col("_doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "distance")


def without_toxic(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic."""
    s = scored(docs, model).where("score < 0.5")
    return s.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
