from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import pixels


def picture(grey):
    g = np.asarray(grey, np.uint8)
    return np.dstack([g, g, g, np.full_like(g, 255)])


def test_preparing():
    image = np.zeros((4, 4, 4), np.uint8)
    image[..., :3], image[..., 3] = (200, 100, 50), 9
    image[0, 0, :3] = 10
    grey = pixels.prepared(image, grayscale=True)
    assert grey[1, 1].tolist() == [118, 118, 118, 9] and pixels.prepared(image)[1, 1].tolist() == [200, 100, 50, 9]
    assert sorted(set(pixels.prepared(image, contrast=True)[..., 0].ravel().tolist())) == [0, 255]
    two = picture([[10] * 5] * 3 + [[200] * 5] * 2)
    assert set(pixels.prepared(two, threshold=True)[..., 0].ravel().tolist()) == {0, 255} or pixels.otsu(two[..., 0]) == 10
    speck = picture(np.zeros((5, 5)))
    speck[2, 2, :3] = 255
    assert pixels.median_filtered(speck)[2, 2, 0] == 0 and pixels.median_filtered(speck[:2]).shape == (2, 5, 4)
    assert pixels.otsu(np.full((3, 3), 7, np.uint8)) == 127
    assert np.array_equal(pixels.enhanced(two, "original"), two)


def test_colours():
    one = np.array([[[100, 150, 200, 7]]], np.uint8)
    got = {m: pixels.recoloured(one, m)[0, 0].tolist() for m in ("invert", "dark-reading", "grayscale", "sepia", "high-contrast")}
    assert got == {"invert": [155, 105, 55, 7], "dark-reading": [150, 106, 73, 7], "grayscale": [143, 143, 143, 7], "sepia": [192, 171, 134, 7], "high-contrast": [157, 157, 157, 7]}


def test_scans():
    c = np.array([[10, 20], [110, 30], [100, 140], [5, 130]], float)
    m = pixels.homography(c, pixels.full_corners(50, 60))
    for p, q in zip(c, pixels.full_corners(50, 60), strict=True):
        v = m @ [*p, 1]
        assert np.allclose(v[:2] / v[2], q)
    with pytest.raises(ValueError):
        pixels.homography(np.zeros((4, 2)), c)
    ramp = picture(np.tile(np.arange(100), (80, 1)))
    assert np.array_equal(pixels.warped(ramp, pixels.full_corners(100, 80), 100, 80), ramp)
    half = pixels.warped(ramp, np.array([[10, 0], [60, 0], [60, 79], [10, 79]], float), 51, 80)
    assert half[0, 0, 0] == 10 and half[0, -1, 0] == 60
    page = picture(np.zeros((100, 120)))
    page[21:81, 31:101, :3] = 255
    corners = pixels.page_corners(page)
    assert abs(corners[0, 0] - 29) <= 3 and abs(corners[2, 1] - 80) <= 3
    assert np.array_equal(pixels.page_corners(picture(np.zeros((50, 50)))), pixels.full_corners(50, 50))
    assert pixels.corrected_size(np.array([[0, 0], [6000, 0], [6000, 10], [0, 10]], float)) == (3000, 32)


def test_images_frame(spark):
    d = spark.createDataFrame([(1, 2, 1, bytearray([1, 2, 3, 4] * 2)), (2, 2, 1, bytearray(b"xx")), (3, 1, 1, None)], "image_id long, width int, height int, rgba binary")
    got = {r["image_id"]: r["rgba"] and bytes(r["rgba"]) for r in pixels.mapped_images(d, lambda i: pixels.recoloured(i, "invert")).collect()}
    assert got == {1: bytes([254, 253, 252, 4] * 2), 2: None, 3: None}


def test_sizes(spark):
    row = spark.range(1).select(
        G.fitted_size(F.lit(10.0), F.lit(5.0), F.lit(52.0)).alias("a"), G.fitted_size(F.lit(10.0), F.lit(5.0), F.lit(45.0)).alias("b"), G.fitted_size(F.lit(100.0), F.lit(1e9), F.lit(1.0)).alias("c"),
        G.jitter(F.lit(3.0), F.lit(2.0)).alias("j"), G.word_rect(*[F.lit(float(x)) for x in (20, 10, 60, 30, 100, 2)]).alias("r"),
    ).first()
    assert row["a"] == 10 and abs(row["b"] - 10 * 0.92**2) < 1e-9 and 3 <= row["c"] <= 4
    v = np.sin(3 * 12.9898) * 43758.5453
    assert abs(row["j"] - (v - np.floor(v) - 0.5) * 4) < 1e-6 and tuple(row["r"]) == (10, 85, 20, 10)
