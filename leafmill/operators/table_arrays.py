r"""Tables of whole pages as array operations, a batch of pages at a time.

Used inside tasks by ``layout.tables_of`` and ``layout.page_tables``: Spark deals the pages, numpy and Arrow see one batch of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .line_arrays import medians

#: A cell with a number; as in Java a dollar also stands before a last end of line, and a vertical tab is white space.
NUMERIC = r"(?:^|[\t\n\x0b\f\r ])[-+]?[$€£¥]?[0-9,.]+%?(?:[\t\n\x0b\f\r ]|[\x{85}\x{2028}\x{2029}]?\z)"


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Whether each row, in order of the keys, is the first with its values."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _within(starts: np.ndarray, n: int) -> np.ndarray:
    """The number, from 0, of each of n rows inside its group."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def table_arrays(l: dict[str, np.ndarray], text: pa.Array) -> dict[str, object]:
    """The figures of every island of at least three near bands of 2 to 12 lines each.

    ``l`` holds page, band, seg, x, width, font_size, bold, band_top, band_bottom of lines in any order."""
    o = np.lexsort((l["seg"], l["band"], l["page"]))
    l, text = {k: v[o] for k, v in l.items()}, text.take(pa.array(o))
    # Bands: page, number, place and how many lines they hold.
    at = np.flatnonzero(_begins(l["page"], l["band"]))
    cells = np.diff(np.append(at, len(o)))
    page, number, top, bottom = (l[c][at] for c in ("page", "band", "band_top", "band_bottom"))
    fits = (cells >= 2) & (cells <= 12)
    joins = np.zeros(len(at), bool)
    near = top[1:] - bottom[:-1] <= np.maximum(24.0, (bottom[1:] - top[1:]) * 2.2)
    joins[1:] = fits[:-1] & (page[1:] == page[:-1]) & (number[1:] - number[:-1] == 1) & near
    fit = np.flatnonzero(fits)
    first = np.flatnonzero(~joins[fit])
    size = np.diff(np.append(first, len(fit)))
    big = size >= 3
    rows = fit[np.repeat(big, size)]
    size = size[big]
    starts = np.cumsum(size) - size
    table = np.repeat(np.arange(len(size)), size)
    # The commonest number of cells, the larger of equals.
    kinds, times = np.unique(table * 16 + cells[rows], return_counts=True)
    columns = np.maximum.reduceat(times * 16 + kinds % 16, np.flatnonzero(_begins(kinds // 16))) % 16 if len(size) else size
    even = cells[rows] == columns[table]
    # The lines of the tables, band after band.
    n = cells[rows]
    line = np.repeat(at[rows], n) + _within(np.cumsum(n) - n, n.sum())
    row, of = np.repeat(np.arange(len(rows)), n), np.repeat(table, n)
    aligned = even[row]
    l, text = {k: v[line] for k, v in l.items()}, text.take(pa.array(line))
    begun = np.flatnonzero(_begins(of))
    # The columns' beginnings: of aligned rows, the median of each place.
    who = np.flatnonzero(aligned)
    who = who[np.lexsort((l["seg"][who], of[who]))]
    new = _begins(of[who], l["seg"][who])
    edge = medians(l["x"][who], np.cumsum(new) - 1, np.flatnonzero(new))
    apart = np.zeros(len(line))
    apart[who] = np.abs(l["x"][who] - edge[np.cumsum(new) - 1])
    edges = np.bincount(of[who][new], minlength=len(size))
    total = lambda v: np.add.reduceat(v.astype(np.int64), begun)
    head = _within(starts, len(rows))[row] == 0
    lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
    pages = page[rows][starts]
    numeric = pc.fill_null(pc.match_substring_regex(text, NUMERIC), False).to_numpy(zero_copy_only=False)
    if not len(size):
        none = np.zeros(0)
        return {c: none.astype(np.int64) for c in ("page", "number", "n_rows", "n_aligned", "n_cells", "bold_first", "first_cells", "numeric")} | {c: none for c in ("font", "deviation", "x", "right", "y", "bottom")} | {"edges": lists([], pa.array([], pa.float64())), "rows": lists([], lists([], text))}
    return {
        "page": pages, "number": _within(np.flatnonzero(_begins(pages)), len(pages)) + 1, "n_rows": size, "font": medians(l["font_size"], of, begun), "deviation": np.add.reduceat(apart, begun) / total(aligned),
        "n_aligned": np.add.reduceat(even.astype(np.int64), starts), "n_cells": total(np.ones(len(line))), "bold_first": total(head & l["bold"]), "first_cells": total(head), "numeric": total(numeric),
        "x": np.minimum.reduceat(l["x"], begun), "right": np.maximum.reduceat(l["x"] + l["width"], begun), "y": np.minimum.reduceat(top[rows], starts), "bottom": np.maximum.reduceat(bottom[rows], starts),
        "edges": lists(edges, pa.array(edge)), "rows": lists(size, lists(n, text)),
    }
