"""Files as rows: bytes, text, orientation of photographs, and text items with their geometry."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_rotation, safe_href, sniff_format, strip_space
from .parsers import decode_text

#: The part of the font size that a text's top stands above its baseline; what font names say of weight and slant.
ASCENT, BOLD, ITALIC = 0.82, "(?i)bold|black|heavy|semibold|demi", "(?i)italic|oblique"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, size, content, format of the files below a folder (those whose names fit the pattern)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), "content", sniff_format(F.col("content")).alias("format"))


def decoded_files(files: DataFrame) -> DataFrame:
    """path, text, encoding: UTF-8, or Windows-1252 where a file is no valid UTF-8."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [decode_text(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in said], "encoding": ["utf-8" if strict else "windows-1252" for _, strict in said]})

    return files.where("content is not null").select("path", "content").mapInPandas(decode, "path string, text string, encoding string")


def exif_orientation(content: bytes) -> int:
    """The orientation (1 to 8) in a photograph's first Exif segment; 1 if there is none."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        mark = content[at + 1]
        if mark == 0xD8 or 0xD0 <= mark <= 0xD9:
            at += 2
            continue
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if mark == 0xE1 and content[at + 4 : at + 8] == b"Exif":
            return _orientation(content[at + 10 : at + 2 + size])
        if size < 2:
            break
        at += 2 + size
    return 1


def _orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    try:
        mark, first = struct.unpack_from(f"{order}HI", tiff, 2)
        if mark != 42:
            return 1
        (count,) = struct.unpack_from(f"{order}H", tiff, first)
        tags = (struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * k) for k in range(count))
        return next((value for tag, _, _, value in tags if tag == 0x0112), 1)
    except struct.error:
        return 1


def orientations(files: DataFrame) -> DataFrame:
    """path, orientation, swapped: whether width and height change places."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [exif_orientation(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "orientation": found, "swapped": [5 <= k <= 8 for k in found]})

    return files.where("content is not null").select("path", "content").mapInPandas(read, "path string, orientation int, swapped boolean")


def glyphs_of(items: DataFrame, pages: DataFrame) -> DataFrame:
    """The layout core's glyphs from raw text items.

    items: doc_id, page_number, item_id, text, transform (array<double> of six), width, height, font_name,
    font_family, dir; pages: doc_id, page_number, width, height, rotation. Items on pages that are not
    among ``pages`` and blank ones play no part; the origin moves to the top left."""
    t = lambda k: F.coalesce(F.get("transform", F.lit(k)), F.lit(1.0 if k == 0 else 0.0))
    p = pages.select("doc_id", "page_number", F.col("width").alias("_w"), F.col("height").alias("_h"), F.coalesce("rotation", F.lit(0.0)).alias("_turn"))
    i = items.where(strip_space(F.col("text")) != "").where("transform is not null").join(p, ["doc_id", "page_number"])
    tall = F.coalesce(F.abs("height"), F.lit(0.0))
    size = F.sqrt(t(2) * t(2) + t(3) * t(3))
    i = i.withColumn("font_size", F.greatest(F.lit(1.0), F.when(size > 0, size).when(tall > 0, tall).otherwise(10.0)))
    between = lambda v, most: F.least(most, F.greatest(F.lit(0.0), v))
    label = F.concat_ws(" ", F.coalesce("font_name", F.lit("unknown")), F.coalesce("font_family", F.lit("")))
    return i.select(
        "doc_id", "page_number", "item_id", "text", between(t(4), F.col("_w")).alias("x"), between(F.col("_h") - t(5) - F.col("font_size") * ASCENT, F.col("_h")).alias("y"),
        F.coalesce(F.abs("width"), F.lit(0.0)).alias("width"), F.greatest("font_size", tall).alias("height"), "font_size",
        normalize_rotation(F.degrees(F.atan2(t(1), t(0))) + F.col("_turn")).alias("rotation"), label.rlike(BOLD).alias("bold"), label.rlike(ITALIC).alias("italic"),
        F.when(F.col("dir") == "rtl", "rtl").otherwise("ltr").alias("direction"),
    )


def safe_links(links: DataFrame, url: Column | None = None) -> DataFrame:
    """The links whose address is safe to keep."""
    return links.where(safe_href(F.col("url") if url is None else url).isNotNull())
