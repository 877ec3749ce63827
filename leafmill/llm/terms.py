"""Terms of whole texts: runs of 0-9, A-Z, a-z and characters beyond ASCII, A-Z lower-cased.

UTF-8 keeps those characters apart by bytes, so a text is cut by one table of bytes and one split."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa

from .shingles import byte_pieces

#: The same terms as a pattern.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE = 1 << 20
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(data: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of translated bytes, piece by piece, so that a long text is no long list of terms."""
    at = 0
    while at < len(data):
        to = len(data) if len(data) - at <= most else data.find(b" ", at + most)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


class Vocabulary:
    """Numbers of the terms met so far."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)

    def __len__(self) -> int:
        return len(self.number)

    def ids(self, data: bytes) -> np.ndarray:
        """The numbers of the terms of translated bytes, in their order."""
        found = [np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)) for words in _pieces(data)]
        return found[0] if len(found) == 1 else np.concatenate(found or [np.zeros(0, np.int32)])


def translated(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, bytes for ``Vocabulary.ids``) of every row; nulls are empty."""
    for first, raw, offsets in byte_pieces(texts):
        data = raw.tobytes().translate(_BYTES)
        for r in range(len(offsets) - 1):
            yield first + r, data[offsets[r] : offsets[r + 1]]


def terms_of(text: str | None) -> list[bytes]:
    """All terms of one text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()
