"""Pixel mathematics on raw RGBA images, a batch of images at a time.

An image is (width, height, rgba): rows from the top, four bytes a pixel. Images are independent, so the
DataFrame form is one Arrow-batched pass; the functions work on arrays of shape (height, width, 4).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The parts of red, green and blue in brightness; the sepia matrix.
LUMA = np.array([0.2126, 0.7152, 0.0722])
SEPIA = np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]])
#: The step of an edge, how many edge points and what part of a side a page must have, and its margin.
EDGE, EDGES, SIDE_PART, MARGIN = 70, 30, 0.3, 0.02
SMALLEST, LARGEST = 32, 3000


def _bytes(values: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers from 0 to 255, halves to the even one."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


def _grey(image: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., :3] = _bytes(value)[..., None]
    return out


def brightness(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(float) @ LUMA


def otsu(values: np.ndarray) -> int:
    """The level that parts bytes into the two classes that differ most; 127 where there is one class."""
    count = np.bincount(values.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(count), count.sum()
    mass = np.cumsum(count * np.arange(256))
    fine = (below > 0) & (below < total)
    rest = np.where(fine, total - below, 1)
    apart = mass / np.where(fine, below, 1) - (mass[-1] - mass) / rest
    score = np.where(fine, below * rest * apart**2, -1.0)
    return int(score.argmax()) if fine.any() else 127


def median_filtered(image: np.ndarray) -> np.ndarray:
    """Every inner pixel as the median of the nine around it (of the first channel)."""
    out = image.copy()
    if min(image.shape[:2]) >= 3:
        around = np.lib.stride_tricks.sliding_window_view(image[..., 0], (3, 3))
        out[1:-1, 1:-1, :3] = np.sort(around.reshape(*around.shape[:2], 9), axis=2)[..., 4, None]
    return out


def prepared(image: np.ndarray, grayscale: bool = False, contrast: bool = False, threshold: bool = False, denoise: bool = False) -> np.ndarray:
    """An image made ready for recognition: grey, stretched to all levels, black and white, without specks."""
    luma = np.floor(brightness(image) + 0.5)
    out = _grey(image, luma) if grayscale or contrast or threshold else image.copy()
    low, high = luma.min(initial=255), luma.max(initial=0)
    if contrast and high > low:
        out = _grey(out, (out[..., 0] - low) * (255 / (high - low)))
    if threshold:
        out = _grey(out, np.where(out[..., 0] >= otsu(out[..., 0]), 255, 0))
    return median_filtered(out) if denoise else out


def enhanced(image: np.ndarray, mode: str) -> np.ndarray:
    """A scan as it is (``original``), stretched (``auto``), ``grayscale`` or ``black-white``."""
    black = mode == "black-white"
    return image.copy() if mode == "original" else prepared(image, mode != "auto", True, black, black)


def recoloured(image: np.ndarray, mode: str) -> np.ndarray:
    """``invert``, ``dark-reading``, ``grayscale``, ``sepia`` or ``high-contrast``."""
    rgb, out = image[..., :3].astype(float), image.copy()
    change: dict[str, Callable[[], np.ndarray]] = {
        "invert": lambda: 255 - rgb, "dark-reading": lambda: (255 - rgb) * [0.9, 0.95, 1.0] + [10, 6, 18], "sepia": lambda: rgb @ SEPIA.T,
        "grayscale": lambda: np.repeat(brightness(image)[..., None], 3, axis=2), "high-contrast": lambda: np.repeat(((brightness(image) - 128) * 1.5 + 135)[..., None], 3, axis=2),
    }
    out[..., :3] = _bytes(change[mode]())
    return out


def full_corners(width: int, height: int) -> np.ndarray:
    """The corners of an image, clockwise from the top left."""
    return np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)


def corrected_size(corners: np.ndarray, largest: int = LARGEST) -> tuple[int, int]:
    """Width and height of the page that a quadrilateral shows."""
    length = lambda a, b: float(np.hypot(*(corners[a] - corners[b])))
    width, height = max(length(0, 1), length(3, 2)), max(length(0, 3), length(1, 2))
    scale = min(1.0, largest / max(1.0, width, height))
    return tuple(max(SMALLEST, int(np.floor(v * scale + 0.5))) for v in (width, height))


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four others."""
    x, y = source.T
    u, v = target.T
    one, zero = np.ones(4), np.zeros(4)
    rows = np.concatenate([np.column_stack([x, y, one, zero, zero, zero, -u * x, -u * y]), np.column_stack([zero, zero, zero, x, y, one, -v * x, -v * y])])
    if abs(np.linalg.det(rows)) < 1e-10:
        raise ValueError("the corners are no quadrilateral")
    return np.append(np.linalg.solve(rows, np.concatenate([u, v])), 1.0).reshape(3, 3)


def warped(image: np.ndarray, corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quadrilateral of an image as an upright one, by bilinear samples."""
    m = homography(full_corners(width, height), corners)
    y, x = np.mgrid[0:height, 0:width].astype(float)
    at = np.stack([x, y, np.ones_like(x)], axis=-1) @ m.T
    sx, sy = at[..., 0] / at[..., 2], at[..., 1] / at[..., 2]
    tall, wide = image.shape[:2]
    x0, y0 = (np.clip(np.floor(v), 0, n - 1).astype(int) for v, n in ((sx, wide), (sy, tall)))
    x1, y1 = np.minimum(x0 + 1, wide - 1), np.minimum(y0 + 1, tall - 1)
    dx, dy = np.clip(sx - x0, 0, 1)[..., None], np.clip(sy - y0, 0, 1)[..., None]
    pixel = image.astype(float)
    top, bottom = pixel[y0, x0] * (1 - dx) + pixel[y0, x1] * dx, pixel[y1, x0] * (1 - dx) + pixel[y1, x1] * dx
    return _bytes(top * (1 - dy) + bottom * dy)


def page_corners(image: np.ndarray) -> np.ndarray:
    """The corners of the box around the edges of every second pixel, a little widened; those of the image
    where there are few edges or the box is small."""
    tall, wide = image.shape[:2]
    luma = brightness(image)
    step = np.abs(np.diff(luma, axis=1, prepend=luma[:, :1])) + np.abs(np.diff(luma, axis=0, prepend=luma[:1]))
    y, x = np.nonzero(step[1 : tall - 1 : 2, 1 : wide - 1 : 2] > EDGE)
    if len(x) < EDGES:
        return full_corners(wide, tall)
    left, right, top, bottom = x.min() * 2 + 1, x.max() * 2 + 1, y.min() * 2 + 1, y.max() * 2 + 1
    if right - left < wide * SIDE_PART or bottom - top < tall * SIDE_PART:
        return full_corners(wide, tall)
    mx, my = (int(np.floor(v * MARGIN + 0.5)) for v in (right - left, bottom - top))
    left, right, top, bottom = max(0, left - mx), min(wide - 1, right + mx), max(0, top - my), min(tall - 1, bottom + my)
    return np.array([[left, top], [right, top], [right, bottom], [left, bottom]], float)


def flattened(image: np.ndarray, mode: str = "auto") -> np.ndarray:
    """A photographed page: found, straightened and enhanced."""
    corners = page_corners(image)
    return enhanced(warped(image, corners, *corrected_size(corners)), mode)


def mapped_images(images: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, width, height, rgba of every image (same columns) after ``change``; an image whose bytes do not fit its size gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, width, height, rgba in zip(b["image_id"], b["width"], b["height"], b["rgba"], strict=True):
                if rgba is None or len(rgba) != width * height * 4 or not len(rgba):
                    out.append((key, width, height, None))
                    continue
                made = change(np.frombuffer(bytes(rgba), np.uint8).reshape(height, width, 4))
                out.append((key, made.shape[1], made.shape[0], made.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "rgba"])

    return images.select("image_id", "width", "height", "rgba").mapInPandas(run, "image_id long, width int, height int, rgba binary")
