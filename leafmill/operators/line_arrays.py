r"""Lines of whole pages as array operations, a batch of pages at a time.

Used inside tasks by ``layout.set_lines``: Spark deals the pages, numpy and Arrow see one batch of them. Bands are
a sequential rule, so the places of a page (glyphs of one y and height) are walked; all else is sorts and reductions over the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}"
#: An item that no space follows, or precedes; as in Java a dollar also stands before a last end of line.
ENDS_TIGHT, BEGINS_TIGHT = rf"[{CJK}\t\n\x0b\f\r ](?:\r\n|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])?\z", rf"^[{CJK}\t\n\x0b\f\r ]"


def medians(values: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The median of each group of values; groups are numbered from 0 and begin at ``starts``."""
    v = values[np.lexsort((values, group))]
    n = np.diff(np.append(starts, len(values)))
    return (v[starts + (n - 1) // 2] + v[starts + n // 2]) / 2


def band_begins(page: np.ndarray, y: np.ndarray, height: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Whether each glyph, in order of (page, y, x), begins a band: its centre is not within ``near`` of the last band's.

    Glyphs of one place join as one, as a band's centre never moves away from a glyph that joined."""
    place = np.ones(len(y), bool)
    place[1:] = (page[1:] != page[:-1]) | (y[1:] != y[:-1]) | (height[1:] != height[:-1])
    at = np.flatnonzero(place)
    begins = np.zeros(len(y), bool)
    last, top, bottom = -1, 0.0, 0.0
    for i, p, t, h, n in zip(at.tolist(), page[at].tolist(), y[at].tolist(), height[at].tolist(), near[at].tolist(), strict=True):
        if p == last and abs((top + bottom) / 2 - (t + h / 2)) <= n:
            top, bottom = min(top, t), max(bottom, t + h)
        else:
            begins[i], last, top, bottom = True, p, t, t + h
    return begins


def line_arrays(g: dict[str, np.ndarray], text: pa.Array, page_width: np.ndarray) -> dict[str, object]:
    """The lines of usable glyphs: ``page``, band, seg, text and the columns of ``layout.lines_of``.

    ``g`` holds page (from 0, without gaps), y, x, item_id, width, height, font_size, rotation, bold, rtl; every page of ``page_width`` has a glyph."""
    o = np.lexsort((g["item_id"], g["x"], g["y"], g["page"]))
    g, text = {k: v[o] for k, v in g.items()}, text.take(pa.array(o))
    page = g["page"]
    pages = np.searchsorted(page, np.arange(len(page_width)))
    font = medians(g["font_size"], page, pages)
    begins = band_begins(page, g["y"], g["height"], np.maximum(1.5, font * 0.38)[page])
    starts, band = np.flatnonzero(begins), np.cumsum(begins) - 1
    first_band = band[pages]
    top, bottom = np.minimum.reduceat(g["y"], starts), np.maximum.reduceat(g["y"] + g["height"], starts)
    rtl = (np.add.reduceat(g["rtl"].astype(np.int64), starts) > np.diff(np.append(starts, len(page))) / 2)[band]
    o = np.lexsort((g["item_id"], g["y"], np.where(rtl, -g["x"], g["x"]), band))
    g, text = {k: v[o] for k, v in g.items()}, text.take(pa.array(o))
    x, right = g["x"], g["x"] + g["width"]

    def gaps(backward: np.ndarray) -> np.ndarray:
        return np.where(backward[1:], x[:-1] - right[1:], x[1:] - right[:-1])

    new = np.ones(len(x), bool)
    split = np.maximum(page_width * 0.075, font * 3.2)[page]
    new[1:] = (band[1:] != band[:-1]) | (gaps(rtl) > split[1:])
    starts, line = np.flatnonzero(new), np.cumsum(new) - 1
    n = np.diff(np.append(starts, len(x)))
    total = lambda c: np.add.reduceat(g[c].astype(np.int64), starts)
    backward = total("rtl") > n / 2
    space = np.zeros(len(x), bool)
    space[1:] = ~new[1:] & (gaps(backward[line]) > np.maximum(1.5, g["font_size"] * 0.2)[1:])
    if pc.any(pc.match_substring_regex(text, rf"[{CJK}\t\n\x0b\f\r ]")).as_py():
        tight = lambda p: pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False)
        space[1:] &= ~(tight(ENDS_TIGHT)[:-1] | tight(BEGINS_TIGHT)[1:])
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), text, "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), pieces), "")
    of = band[starts]
    begun = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    left, upper = np.minimum.reduceat(x, starts), np.minimum.reduceat(g["y"], starts)
    return {
        "page": page[starts], "band": of - first_band[page[starts]], "seg": np.arange(len(of)) - begun[np.cumsum(np.append(True, of[1:] != of[:-1])) - 1],
        "text": pc.replace_substring_regex(joined, "[ \t]{2,}", " "), "x": left, "y": upper, "width": np.maximum.reduceat(right, starts) - left, "height": np.maximum.reduceat(g["y"] + g["height"], starts) - upper,
        "font_size": medians(g["font_size"], line, starts), "bold": total("bold") >= np.ceil(n / 2), "rotation": medians(g["rotation"], line, starts), "rtl": backward,
        "band_top": top[of], "band_bottom": bottom[of], "font": font[page[starts]], "page_width": page_width[page[starts]],
    }


def baseline_arrays(g: dict[str, np.ndarray], text: pa.Array, off_part: float, off_least: float, space_part: float, usual: float) -> dict[str, object]:
    """The lines by baselines of items with text: ``page``, line, y, text, n_items.

    ``g`` holds page (from 0, without gaps), y, x, item_id, width, height. The running mean is walked item by item."""
    o = np.lexsort((g["x"], g["item_id"], -g["y"], g["page"]))
    g, text = {k: v[o] for k, v in g.items()}, text.take(pa.array(o))
    page, tall = g["page"], np.abs(g["height"])
    height = np.full(page[-1] + 1, usual)
    some = tall > 0
    if some.any():
        of, renumbered, n = np.unique(page[some], return_inverse=True, return_counts=True)
        height[of] = medians(tall[some], renumbered, np.cumsum(n) - n)
    off = np.maximum(off_least, height * off_part)
    new, means = np.zeros(len(page), bool), []
    last, mean, n, near = -1, 0.0, 0, 0.0
    for i, (p, y) in enumerate(zip(page.tolist(), g["y"].tolist(), strict=True)):
        if p == last and abs(y - mean) <= near:
            mean, n = (mean * n + y) / (n + 1), n + 1
            means[-1] = mean
        else:
            new[i], last, mean, n, near = True, p, y, 1, off[p]
            means.append(y)
    starts, line = np.flatnonzero(new), np.cumsum(new) - 1
    o = np.lexsort((np.arange(len(page)), g["x"], line))
    x, right, text = g["x"][o], (g["x"] + g["width"])[o], text.take(pa.array(o))
    space = np.zeros(len(x), bool)
    space[1:] = ~new[1:] & (x[1:] - right[:-1] > (height * space_part)[page[1:]])
    if pc.any(pc.match_substring_regex(text, "[\t\n\x0b\f\r ]")).as_py():
        blank = lambda p: pc.match_substring_regex(text, p).to_numpy(zero_copy_only=False)
        space[1:] &= ~(blank(r"[\t\n\x0b\f\r ](?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z")[:-1] | blank("^[\t\n\x0b\f\r ]")[1:])
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(space), " ", ""), text, "")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(x)), pa.int32()), pieces), "")
    at = page[starts]
    return {
        "page": at, "line": np.arange(len(at)) - np.searchsorted(at, at), "y": np.array(means), "text": pc.replace_substring_regex(joined, "[ \t]{2,}", " "), "n_items": np.diff(np.append(starts, len(x))),
    }
