r"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The pieces of a public model span a lattice over the UTF-8 bytes of a text (a space is the
model's U+2581). Forward filtering sums the weights of all segmentations up to each byte,
alpha[e] = sum over pieces that end at e of weight * alpha[start]; backward sampling walks from the
end and draws each piece with probability weight * alpha[start] / alpha[e]. So a segmentation
is drawn in proportion to the product of its pieces' weights. A byte of a character that is no
piece is a byte piece.

As no piece goes on into a space, the lattice falls apart into units, a run of spaces with the
word after it each (a model with such pieces has one unit a text). Units of up to SHORT bytes are
filtered all at a time and once for each stretch of text, however often it occurs; longer ones, of
any length, one after the other with alpha scaled in a window of the longest piece. Texts are read
in stretches of units, so memory follows the longest unit only.

Every draw is a digest of (seed, row key, place in the text), so reruns, other batches and other
machines give the same ids. Decoding joins the pieces' bytes and gives back the text exactly.

Piece weights follow Zipf's law over the model's order of pieces to the power ``power``, as a
BPE model holds ranks and no probabilities.

Defined cases: a null text gives null ids; an empty text no ids; texts of any length are
encoded to their end; a null row key draws as key 0, and repeated rows alike; an empty table
gives an empty result; further columns play no part. Strings of control pieces in a text are
ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import small_batches
from .shingles import _VALUE, _power, byte_pieces, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the units that are filtered together, and of the stretches that a text is read in.
SHORT, STRETCH = 64, 1 << 19
BYTE_WEIGHT = 0.05
#: Every weight is taken times SCALE to the number of its bytes, which no ratio shows, so that alpha of SHORT bytes fits a double.
SCALE = 100.0


@dataclass
class Lattice:
    """Pieces as a double-array trie over their reversed bytes.

    ``base`` and ``check`` hold the transitions, ``piece`` the id that ends at a state (or -1),
    ``weight`` by id, ``byte_id`` by byte, ``flat`` and ``offset`` the bytes of each id, ``longest``
    the bytes of the longest piece; ``cuts`` says that no piece goes on into a space."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    byte_id: np.ndarray
    flat: np.ndarray
    offset: np.ndarray
    longest: int
    cuts: bool


def build_lattice(pieces: dict[int, bytes], byte_id: list[int], power: float = 1.0) -> Lattice:
    """A lattice from the bytes of each id, in order of rank, and the ids of the 256 bytes."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i, b in pieces.items():
        if not b:
            continue
        node = 0
        for c in reversed(b):
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
        ends.setdefault(node, i)
    # Nodes of several children go into ever later cells, only children fill the gaps.
    used = bytearray(8 * len(children) + 1024)
    base, check = np.zeros(len(used), np.int32), np.full(len(used), -1, np.int32)
    state = {0: 0}
    used[0] = 1
    gap = several = 1
    for node in _by_level(children):
        kids = sorted(children[node])
        if not kids:
            continue
        if len(kids) == 1:
            gap = max(gap, kids[0] + 1)
            while used[gap]:
                gap += 1
            at = gap - kids[0]
        else:
            while any(used[several + c] for c in kids):
                several += 1
            at = several
        base[state[node]] = at
        for c in kids:
            used[at + c], check[at + c] = 1, state[node]
            state[children[node][c]] = at + c
    end = max(state.values()) + 257
    base, check = base[:end], check[:end]
    piece = np.full(len(base), -1, np.int32)
    for node, i in ends.items():
        piece[state[node]] = i
    top = max([*pieces, *byte_id]) + 1
    weight = np.zeros(top)
    rank = (1.0 + np.arange(len(pieces))) ** -power
    weight[list(pieces)] = rank / rank.sum()
    weight[byte_id] = BYTE_WEIGHT
    of = [pieces.get(i, b"") for i in range(top)]
    for b, i in enumerate(byte_id):
        of[i] = bytes([b])
    offset = np.concatenate([[0], np.cumsum([len(b) for b in of])])
    return Lattice(base, check, piece, weight, np.array(byte_id, np.int32), np.frombuffer(b"".join(of), np.uint8), offset, max(map(len, pieces.values())), not any(b" " in b.lstrip(b" ") for b in pieces.values()))


def _by_level(children: list[dict[int, int]]) -> Iterator[int]:
    level = [0]
    while level:
        yield from level
        level = [k for n in level for k in children[n].values()]


@lru_cache(maxsize=2)
def lattice_of(model: str = MODEL, power: float = 1.0) -> Lattice:
    """The lattice of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return build_lattice({i: sp.id_to_piece(i).replace("▁", " ").encode() for i in plain}, byte_id, power)


def _units(raw: np.ndarray, offsets: np.ndarray, cuts: bool) -> np.ndarray:
    """The byte at which each unit begins."""
    begins = np.zeros(len(raw), bool)
    if cuts:
        space = raw == 0x20
        begins[1:] = space[1:] & ~space[:-1]
    begins[0] = True
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(begins)


def _pieces_at(text: np.ndarray, starts: np.ndarray, spans: np.ndarray, z: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last byte, length, id) of every piece within a unit, by last byte and length."""
    room = np.arange(len(text)) - np.repeat(starts, spans) + 1
    # Characters that are no piece are bytes: of a lead byte, the length of its character.
    lead = (text & 0xC0) != 0x80
    begins = np.flatnonzero(lead)
    long = np.diff(np.append(begins, len(text)))
    known = np.ones(len(begins), bool)
    state = np.zeros(len(begins), np.int64)
    for k in range(int(long.max(initial=0))):
        on = known & (long > k)
        c = text[begins[on] + long[on] - 1 - k]
        to = z.base[state[on]] + c
        fine = (z.base[state[on]] > 0) & (z.check[to] == state[on])
        known[np.flatnonzero(on)[~fine]] = False
        state[on] = to
    known &= z.piece[np.where(known, state, 0)] >= 0
    byte = np.flatnonzero(np.repeat(~known, long))
    ends, sizes, ids = [byte], [np.ones(len(byte), np.int64)], [z.byte_id[text[byte]]]
    at, state = np.arange(len(text)), np.zeros(len(text), np.int64)
    for k in range(z.longest):
        inside = room[at] > k
        at, state = at[inside], state[inside]
        b = z.base[state]
        to = b + text[at - k]
        fine = (b > 0) & (z.check[to] == state)
        at, state = at[fine], to[fine]
        if not len(at):
            break
        hit = z.piece[state] >= 0
        ends.append(at[hit])
        sizes.append(np.full(int(hit.sum()), k + 1))
        ids.append(z.piece[state[hit]])
    end, size, i = np.concatenate(ends), np.concatenate(sizes), np.concatenate(ids)
    order = np.argsort(end, kind="stable")
    return end[order], size[order], i[order]


def _filtered(text: np.ndarray, starts: np.ndarray, spans: np.ndarray, z: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward filtering of units: (first, running, size, id).

    ``size`` and ``id`` are the pieces by last byte, those that end at byte e from ``first[e]`` on;
    ``running`` are the running sums of their probabilities, plus the number of last bytes before."""
    end, size, ids = _pieces_at(text, starts, spans, z)
    mass = z.weight[ids]
    first = np.searchsorted(end, np.arange(len(text) + 1))
    unit = np.repeat(np.arange(len(starts)), spans)
    place = np.arange(len(text)) - starts[unit] + 1
    part = np.zeros(len(end))
    short = np.flatnonzero((spans <= SHORT)[unit[end]])
    wave = place[end[short]].astype(np.uint16)
    short = short[np.argsort(wave, kind="stable")]
    bounds = np.cumsum(np.bincount(wave, minlength=SHORT + 1))
    end_, size_, scaled = end[short], size[short], (mass * (SCALE ** np.arange(z.longest + 1))[size])[short]
    whole = size_ == place[end_]
    # alpha[e + 1] belongs to last byte e; what a unit begins with has 1.
    alpha = np.zeros(len(text) + 1)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if lo == hi:
            continue
        e = end_[lo:hi]
        share = scaled[lo:hi] * np.where(whole[lo:hi], 1.0, alpha[e + 1 - size_[lo:hi]])
        new = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        total = np.add.reduceat(share, new)
        alpha[e[new] + 1] = total
        part[short[lo:hi]] = share / np.repeat(np.where(total > 0, total, 1), np.diff(np.append(new, hi - lo)))
    for u in np.flatnonzero(spans > SHORT):
        lo, hi = first[starts[u]], first[starts[u] + spans[u]]
        part[lo:hi] = _long_unit((end[lo:hi] - starts[u] + 1).tolist(), size[lo:hi].tolist(), mass[lo:hi].tolist(), int(spans[u]), z.longest)
    sums = np.concatenate([[0.0], np.cumsum(part)])
    running = sums[1:] - sums[first[end]] + end
    return first, running, size, ids


def _long_unit(end: list[int], size: list[int], mass: list[float], n: int, longest: int) -> list[float]:
    """The probabilities of the pieces of one unit, by last byte."""
    alpha = [0.0] * (n + 1)
    alpha[0] = 1.0
    part: list[float] = []
    at, most = 0, len(end)
    while at < most:
        e, to, total = end[at], at, 0.0
        shares = []
        while to < most and end[to] == e:
            share = mass[to] * alpha[e - size[to]]
            shares.append(share)
            total += share
            to += 1
        alpha[e] = total
        part += [x / total for x in shares] if total else shares
        if 0 < total < 1e-100:
            for k in range(max(0, e - longest), e + 1):
                alpha[k] /= total
        at = to
    return part


def encode_bytes(raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray, z: Lattice, seed: int, before: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each row) of rows whose draws are keyed by ``keys``.

    ``before`` is how many bytes of each row's text came earlier."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    starts = _units(raw, offsets, z.cuts)
    spans = np.diff(np.append(starts, len(raw)))
    within = np.arange(len(raw)) - np.repeat(starts, spans)
    digest = mix(np.add.reduceat(_VALUE[raw] * _power(int(spans.max()) + 1)[within], starts) + spans.astype(np.uint64))
    _, some, unit = np.unique(digest, return_index=True, return_inverse=True)
    lengths = spans[some]
    own = np.concatenate([[0], np.cumsum(lengths)])
    text = raw[np.repeat(starts[some] - own[:-1], lengths) + np.arange(own[-1])]
    first, running, size, ids = _filtered(text, own[:-1], lengths, z)
    row = np.searchsorted(offsets, starts, "right") - 1
    key = mix(keys.astype(np.uint64) + np.uint64(seed))[row]
    place = starts - offsets[row] + (before[row] if isinstance(before, np.ndarray) else before)
    out = np.full(len(raw), -1, np.int32)
    on, left = np.arange(len(starts)), spans.copy()
    while len(on):
        e = own[unit[on]] + left[on] - 1
        draw = mix(key[on] ^ mix((place[on] + left[on]).astype(np.uint64)))
        u = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        m, most, aim = first[e], first[e + 1] - 1, e + u
        behind = np.flatnonzero((running[m] <= aim) & (m < most))
        while len(behind):
            m[behind] += 1
            behind = behind[(running[m[behind]] <= aim[behind]) & (m[behind] < most[behind])]
        k = size[m]
        out[starts[on] + left[on] - k] = ids[m]
        left[on] -= k
        on = on[left[on] > 0]
    ends = np.concatenate([[0], np.cumsum(out >= 0)])
    return out[out >= 0], np.diff(ends[offsets])


def stretches(raw: np.ndarray, cuts: bool, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of about ``most`` bytes, whole units each."""
    at = 0
    while at < len(raw):
        to = min(at + most, len(raw))
        if to < len(raw):
            if not cuts:
                to = len(raw)
            else:
                tail = raw[to - 1 :]
                gap = np.flatnonzero((tail[1:] == 0x20) & (tail[:-1] != 0x20))
                to = to + int(gap[0]) if len(gap) else len(raw)
        yield at, to
        at = to


def encode_long(raw: np.ndarray, key: np.ndarray, z: Lattice, seed: int) -> np.ndarray:
    """The ids of one text of any length."""
    parts = [encode_bytes(raw[a:b], np.array([0, b - a]), key, z, seed, a)[0] for a, b in stretches(raw, z.cuts, STRETCH)]
    return np.concatenate(parts or [np.zeros(0, np.int32)])


def decode_ids(ids: np.ndarray, z: Lattice) -> np.ndarray:
    """The bytes of a run of ids."""
    size = z.offset[ids + 1] - z.offset[ids]
    ends = np.cumsum(size)
    return z.flat[np.repeat(z.offset[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def sampled_pieces(docs: DataFrame, model: str = MODEL, power: float = 1.0, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids, lossless: a sampled segmentation of every whole text.

    ``lossless`` says that the decoded ids are the text, byte by byte."""
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(astuple(lattice_of(model, power)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Lattice(*held.value)
        for b in batches:
            key = np.asarray(b.column(1).fill_null(0)).astype(np.int64).view(np.uint64)
            for first, raw, offsets in byte_pieces(b.column(2), STRETCH):
                mine = key[first : first + len(offsets) - 1]
                if len(raw) > STRETCH and len(mine) == 1:
                    ids = encode_long(raw, mine, z, seed)
                    counts = np.array([len(ids)])
                else:
                    ids, counts = encode_bytes(raw, offsets, mine, z, seed)
                back = decode_ids(ids, z)
                ends = np.concatenate([[0], np.cumsum(counts)])
                size = np.concatenate([[0], np.cumsum(z.offset[ids + 1] - z.offset[ids])])[ends]
                same = np.array_equal(size, offsets)
                wrong = np.concatenate([[0], np.cumsum(back != raw)])[offsets] if same else None
                fine = (np.diff(wrong) == 0) if same else np.array([np.array_equal(back[size[i] : size[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i in range(len(counts))])
                m = len(counts)
                null = b.column(2).slice(first, m).is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, m), pa.array(counts, mask=null), lists, pa.array(fine, mask=null)], ["doc_id", "n_tokens", "ids", "lossless"])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("key"), "text")
    return table.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(astuple(lattice_of(model)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Lattice(*held.value)
        for b in batches:
            texts = [None if x is None else decode_ids(np.array(x, np.int64), z).tobytes().decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")
