from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def many(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_luhn(spark):
    values = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112", "1234567890123", "18", None]
    assert many(spark, S.luhn_valid, values) == [True, True, False, False, False, False]


def test_verhoeff(spark):
    values = ["827271662904", "234567891238", "2345 6789 1234", "827271662909", "82727166290", None]
    assert many(spark, S.verhoeff_valid, values) == [True, True, False, False, False, False]


def test_buckets(spark):
    mib = 1 << 20
    assert many(spark, S.size_bucket, [0, mib - 1, mib, 10 * mib, 50 * mib, 100 * mib], "long") == ["<1MB", "<1MB", "1-10MB", "10-50MB", "50-100MB", ">100MB"]
    assert many(spark, S.page_count_bucket, [1, 2, 10, 11, 50, 51, 200, 201], "int") == ["1", "2-10", "2-10", "11-50", "11-50", "51-200", "51-200", ">200"]
    assert many(spark, S.duration_bucket, [999, 1000, 4999, 5000, 15000, 60000], "int") == ["<1s", "1-5s", "1-5s", "5-15s", "15-60s", ">60s"]


def test_format_bytes(spark):
    assert many(spark, S.format_bytes, [0, -5, 500, 1536, 5 << 20, 3 << 30], "long") == ["0 B", "0 B", "500 B", "1.5 KB", "5.0 MB", "3.0 GB"]


def test_names(spark):
    assert many(spark, S.sanitize_filename, ["a/b:c", "  ", "x\ty", "n" * 200]) == ["abc", "document", "xy", "n" * 180]
    names = lambda *n: one(spark, S.suggest_output_name(F.array(*[F.lit(x) for x in n]), ".pdf", "merged"))
    assert names("a.pdf", "b.doc") == "a+b-merged.pdf"
    assert names("a.pdf", "b", "c", "d") == "a+3-more-merged.pdf"
    assert one(spark, S.suggest_output_name(F.array().cast("array<string>"), "txt")) == "document.txt"


def test_audio_and_dates(spark):
    assert many(spark, S.audio_timestamp, [0, 65, 3600, -4], "int") == ["00:00", "01:05", "01:00:00", "00:00"]
    assert str(one(spark, S.excel_date(F.lit(45000.5)))) == "2023-03-15 12:00:00"
    assert many(spark, S.column_index, ["A1", "Z9", "AA3", "AB12"]) == [0, 25, 26, 27]


def test_rotation(spark):
    assert many(spark, S.normalize_rotation, [0.0, -90.0, 359.7, 450.04], "double") == [0.0, 270.0, 0.0, 90.0]


def test_text_rules(spark):
    assert many(spark, S.safe_href, ["https://a", " mailto:x ", "javascript:x", None]) == ["https://a", "mailto:x", None, None]
    assert many(spark, S.needs_ocr, ["short", "x" * 40, None]) == [True, False, True]
    assert many(spark, S.normalize_margin, ["Page  12 of 30 "]) == ["page # of #"]
    assert one(spark, S.compact_pages(F.sequence(F.lit(1), F.lit(10)))) == "1, 2, 3, 4, 5, 6, 7, 8 and 2 more"
    t = S.expand_template(F.lit("{n}/{total} {date} {filename}"), F.lit(2), F.lit(9), F.lit("2024-02-03").cast("date"), F.lit("a\nb"))
    assert one(spark, t) == "2/9 2024-02-03 a b"


def test_sniff(spark):
    values = [bytearray(b"xx%PDF-1.7"), bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"\x89PNG\r\n\x1a\n"), bytearray(b"RIFF0000WEBP"), bytearray(b"no")]
    assert many(spark, S.sniff_format, values, "binary") == ["pdf", "jpeg", "png", "webp", None]


def test_geometry(spark):
    r = lambda *v: G.rect(*[F.lit(float(x)) for x in v])
    assert tuple(one(spark, G.intersect(r(0, 0, 10, 10), r(5, 5, 10, 10)))) == (5.0, 5.0, 5.0, 5.0)
    assert tuple(one(spark, G.intersect(r(0, 0, 1, 1), r(5, 5, 1, 1)))) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(one(spark, G.clamp_inside(r(95, -5, 20, 20), F.lit(100.0), F.lit(100.0)))) == (80.0, 0.0, 20.0, 20.0)
    assert one(spark, G.fit_scale("center", F.lit(10.0), F.lit(10.0), F.lit(50.0), F.lit(40.0))) == 1.0
    assert one(spark, G.fit_scale("fill", F.lit(10.0), F.lit(10.0), F.lit(50.0), F.lit(40.0))) == 5.0
