"""Rectangles and page sizes as Spark columns; a rectangle is a struct of x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page sizes in points, and points by unit.
PAGE_SIZES = {"a3": (841.89, 1190.55), "a4": (595.28, 841.89), "letter": (612.0, 792.0), "legal": (612.0, 1008.0)}
POINTS = {"mm": 72 / 25.4, "in": 72.0, "pt": 1.0}
MOST_SIDE, LEAST_SIDE = 14_400, 36


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def drag_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle between two corners in any order."""
    return rect(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def intersect(a: Column, b: Column) -> Column:
    """The common part; all zeros if there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - x
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - y
    zero = F.lit(0.0)
    some = (w > 0) & (h > 0)
    return rect(*[F.when(some, v).otherwise(zero) for v in (x, y, w, h)])


def clamp_inside(r: Column, width: Column, height: Column) -> Column:
    """The rectangle moved, and if need be cut, to lie on the page."""
    w, h = F.least(r["width"], width), F.least(r["height"], height)
    zero = F.lit(0.0)
    return rect(clamp(r["x"], zero, width - w), clamp(r["y"], zero, height - h), w, h)


def fit_scale(mode: str, source_w: Column, source_h: Column, target_w: Column, target_h: Column) -> Column:
    """``fit`` inside, ``fill`` the target, or ``center`` without enlarging."""
    sx, sy = target_w / source_w, target_h / source_h
    return {"fit": F.least(sx, sy), "fill": F.greatest(sx, sy), "center": F.least(sx, sy, F.lit(1.0))}[mode]


def contain(source_w: Column, source_h: Column, target_w: Column, target_h: Column) -> Column:
    """The source scaled to fit and centred in the target."""
    s = fit_scale("fit", source_w, source_h, target_w, target_h)
    return rect((target_w - source_w * s) / 2, (target_h - source_h * s) / 2, source_w * s, source_h * s)


def zone_x(zone: Column, page_width: Column, text_width: Column, margin: Column) -> Column:
    """Where a left, right or centred header or footer text begins."""
    right = F.greatest(margin, page_width - text_width - margin)
    middle = F.greatest(F.lit(0.0), (page_width - text_width) / 2)
    return F.when(zone == "left", margin).when(zone == "right", right).otherwise(middle)


def zone_y(band: Column, page_height: Column, margin: Column) -> Column:
    """The baseline of a header or a footer."""
    return F.when(band == "header", page_height - margin).otherwise(margin)


def header_zones(template: Column) -> Column:
    """struct<left, center, right> of a template whose zones are parted by |; zones left out are empty."""
    parts = F.split(template, r"\|")
    return F.struct(*[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(("left", "center", "right"))])


def css_to_pdf(x: Column, y: Column, page_height: Column, scale: Column) -> Column:
    """A point on the screen as a point of the page, whose origin is at the bottom."""
    return F.struct((x / scale).alias("x"), (page_height - y / scale).alias("y"))


def pdf_to_css(r: Column, page_height: Column, scale: Column) -> Column:
    """A rectangle of the page as one on the screen."""
    return rect(r["x"] * scale, (page_height - r["y"] - r["height"]) * scale, r["width"] * scale, r["height"] * scale)


def place(position: Column, page_width: Column, page_height: Column, width: Column, height: Column, margin: Column) -> Column:
    """struct<x, y> of an item at one of nine positions: top, middle or bottom, and left, center or right."""
    x = F.when(position.endswith("left"), margin).when(position.endswith("right"), page_width - width - margin).otherwise((page_width - width) / 2)
    y = F.when(position.startswith("top"), page_height - height - margin).when(position.startswith("middle"), (page_height - height) / 2).otherwise(margin)
    return F.struct(x.alias("x"), y.alias("y"))


def css_overlay(point: Column, page_height: Column, height: Column, scale: Column) -> Column:
    """struct<left, top> on the screen of an item placed on the page."""
    return F.struct((point["x"] * scale).alias("left"), ((page_height - point["y"] - height) * scale).alias("top"))


def custom_size(width: Column, height: Column, unit: str) -> Column:
    """struct<width, height> in points."""
    return F.struct((width * POINTS[unit]).alias("width"), (height * POINTS[unit]).alias("height"))


def target_size(preset: str, landscape: bool, custom: Column | None = None) -> Column:
    """struct<width, height> of a page: a preset (A4 if unknown) or a custom size, turned as asked."""
    if preset == "custom" and custom is not None:
        short, long = F.least(custom["width"], custom["height"]), F.greatest(custom["width"], custom["height"])
    else:
        short, long = (F.lit(v) for v in PAGE_SIZES.get(preset, PAGE_SIZES["a4"]))
    return F.struct((long if landscape else short).alias("width"), (short if landscape else long).alias("height"))


def image_page(width: Column, height: Column) -> Column:
    """struct<width, height> of a page for an image of that size: at most MOST_SIDE a side, at least LEAST_SIDE."""
    factor = F.least(F.lit(1.0), F.lit(float(MOST_SIDE)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(float(LEAST_SIDE)), v * factor)
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def match_rect(e: Column, f: Column, width: Column, size: Column, text: Column, start: Column, end: Column) -> Column:
    """The rectangle of the characters from start to end of a text item at (e, f)."""
    each = F.when((width > 0) & (F.length(text) > 0), width / F.length(text)).otherwise(size * 0.5)
    zero = F.lit(0.0)
    return rect(F.greatest(zero, e + start * each - 1), F.greatest(zero, f - size * 0.28), F.greatest(F.lit(6.0), (end - start) * each + 2), size * 1.18)


def render_memory(width: Column, height: Column, source_bytes: Column | int = 0, extra_bytes: Column | int = 0) -> Column:
    """Bytes needed to render: four a pixel, 2.5 times the source and further buffers, and 1.6 times that at the peak."""
    whole = lambda v: F.greatest(F.floor(v), F.lit(0))
    source, extra = (x if isinstance(x, Column) else F.lit(x) for x in (source_bytes, extra_bytes))
    return F.ceil((whole(width) * whole(height) * 4 + source * 2.5 + extra) * 1.6).cast("long")


def most_scale(width: Column, height: Column, scale: Column, most_side: Column, most_pixels: Column) -> Column:
    """The scale, lowered so that a canvas keeps within its longest side and its pixels."""
    side = most_side / F.greatest(width, height, F.lit(1.0))
    area = F.sqrt(most_pixels) / F.greatest(F.sqrt(width * height), F.lit(1.0))
    return F.least(scale, side, area)


def fitted_size(size: Column, width_a_point: Column, most_width: Column) -> Column:
    """The font size, lowered by 8 % until its text fits (two points spared) or it is 4, in 40 steps at most; never under 3.

    ``width_a_point`` is the text's width at a size of 1."""
    fits = lambda s: (s * width_a_point <= most_width - 2) | (s <= 4)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(40)), size.cast("double"), lambda s, _: F.when(fits(s), s).otherwise(s * 0.92))
    return F.greatest(F.lit(3.0), last)


def jitter(seed: Column, amplitude: Column) -> Column:
    """A number between -amplitude and amplitude that follows from the seed."""
    v = F.sin(seed * 12.9898) * 43758.5453
    return (v - F.floor(v) - 0.5) * 2 * amplitude


def word_rect(x0: Column, y0: Column, x1: Column, y1: Column, page_height: Column, scale: Column) -> Column:
    """A box on a rendered, upright page as a rectangle of the page."""
    left, right = F.least(x0, x1) / scale, F.greatest(x0, x1) / scale
    return rect(left, page_height - F.greatest(y0, y1) / scale, right - left, F.abs(y1 - y0) / scale)
