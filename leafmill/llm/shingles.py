r"""Word shingles of whole texts as 64-bit digests, computed over Arrow buffers with numpy.

A-Z are lower-cased and words are ``[^\x20\x09-\x0D]+``. A word's digest is a polynomial
over its bytes modulo 2^64, a shingle's digest mixes those of its words; work goes through
the bytes in pieces of bounded size, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
PIECE = 1 << 20
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COEF = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _STEP)]))
    return _powers


def byte_pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of about ``most`` bytes, whole rows each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, row, first byte and size of each word."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    solid = ~_SPACE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = solid[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    spans = np.diff(np.append(starts, len(raw)))
    within = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    value = _VALUE[_LOWER[raw[starts[0] :]]] * _power(int(spans.max()) + 1)[within]
    value[~solid[starts[0] :]] = 0
    digests = mix(np.add.reduceat(value, starts - starts[0]))
    sizes = np.add.reduceat(solid[starts[0] :].astype(np.int64), starts - starts[0])
    return digests, np.searchsorted(offsets, starts, "right") - 1, starts, sizes


def word_digests(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digest and row of each word."""
    return word_spans(raw, offsets)[:2]


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle digests) for every row that has words."""
    for first, raw, offsets in byte_pieces(texts):
        words, rows = word_digests(raw, offsets)
        if not len(words):
            continue
        n = np.bincount(rows, minlength=len(offsets) - 1)
        ends = np.cumsum(n)
        if len(words) >= WIDTH:
            full = sum(words[j : len(words) - WIDTH + 1 + j] * _COEF[j] for j in range(WIDTH))
            full = mix(full)
        for r in np.flatnonzero(n):
            a, b = ends[r] - n[r], ends[r]
            if n[r] >= WIDTH:
                yield first + int(r), np.unique(full[a : b - WIDTH + 1])
            else:
                short = (words[a:b] * _COEF[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + int(r), mix(np.array([short], np.uint64))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set of that similarity."""
    return (n * percent + 99) // 100
