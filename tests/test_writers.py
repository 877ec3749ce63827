"""Packages read back, line grouping, placement, and the outputs of an analysis."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from test_operators import glyph_tables

from leafmill.functions import geometry as G
from leafmill.functions import scalars as S
from leafmill.operators import events, layout, lookups, pages, pii, text_lines
from leafmill.sources import files, parsers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_baseline_lines(spark):
    rows = [("d", 1, 0, "world", 60.0, 700.0, 30.0, 10.0), ("d", 1, 1, "Hello", 10.0, 702.0, 40.0, 10.0), ("d", 1, 2, "", 0.0, 702.0, 1.0, 10.0), ("d", 1, 3, "be", 10.0, 650.0, 10.0, 10.0), ("d", 1, 4, "low ", 20.5, 648.0, 20.0, 10.0), ("d", 2, 5, "next  page", 5.0, 500.0, 9.0, 0.0)]
    items = spark.createDataFrame(rows, "doc_id string, page_number int, item_id int, text string, x double, y double, width double, height double")
    lines = text_lines.baseline_lines(items)
    got = [(r["page_number"], r["line"], r["text"], r["n_items"]) for r in lines.orderBy("page_number", "line").collect()]
    assert got == [(1, 0, "Hello world", 2), (1, 1, "below", 2), (2, 0, "next page", 1)]
    assert [r["y"] for r in lines.orderBy("page_number", "line").collect()] == [701.0, 649.0, 500.0]
    assert text_lines.lines_markdown(lines).first()["markdown"] == "# Extracted Text\n\n## Page 1\n\nHello world\n\nbelow\n\n## Page 2\n\nnext page\n"
    assert text_lines.lines_plain(lines).first()["text"] == "--- Page 1 ---\n\nHello world\n\nbelow\n\n\n--- Page 2 ---\n\nnext page\n"
    assert text_lines.baseline_lines(items.where("false")).count() == 0


def test_packages_are_read_back(spark):
    a = layout.analyze(*glyph_tables(spark))
    content = lambda d: bytes(d.first()["content"])
    book = parsers.docx_blocks(content(writers.docx_packages(a["blocks"], a["tables"])))
    assert [b["kind"] for b in book] == ["heading", "paragraph", "paragraph", "page-break", "table"] and book[4]["rows"][2] == ["Cash", "1200.50", "Verified"]
    sheet = parsers.xlsx_blocks(content(writers.xlsx_packages(a["tables"])))
    assert sheet[0]["text"] == "Page 2 Table" and sheet[1]["rows"][1] == ["Debt", "900.10", "Open"]
    chapters = parsers.epub_blocks(content(writers.epub_packages(a["blocks"], a["tables"], 1)))
    assert [b["kind"] for b in chapters] == ["heading", "paragraph", "paragraph", "table"]
    none = writers.xlsx_packages(a["tables"], ["no such table"])
    assert none.count() == 0
    files = spark.createDataFrame([(1, "a.txt", bytearray(b"x")), (1, "a.txt", bytearray(b"y")), (2, "b", bytearray(b""))], "doc_id long, name string, content binary")
    zips = {r["doc_id"]: bytes(r["content"]) for r in writers.zip_packages(files).collect()}
    assert {k: writers.count_entries(v) for k, v in zips.items()} == {"1": 2, "2": 1}
    assert sorted(zipfile.ZipFile(io.BytesIO(zips["1"])).read(n) for n in zipfile.ZipFile(io.BytesIO(zips["1"])).namelist()) == [b"x", b"y"]


def test_writer_rules():
    assert [writers.column_name(k) for k in (0, 25, 26, 701, 702, 18_277)] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert writers.unique_names(["Page 1 Table"] * 3) == ["Page 1 Table", "Page 1 Table 2", "Page 1 Table 3"]
    assert writers.column_widths([["a", "x" * 30], ["b" * 99]]) == [60, 32]
    for tables, said in (([], "INVALID_INPUT"), ([{"page_number": 1, "rows": [["x"]]}] * 101, "MEMORY_LIMIT")):
        with pytest.raises(ValueError, match=said):
            writers.xlsx(tables)
    with pytest.raises(ValueError, match="OUTPUT_INVALID"):
        writers.zipped({"a": "x"}, ["b"])
    odd = [{"page_number": 1, "kind": "paragraph", "text": "a\x00<&>\"'", "level": 0, "ordered": False, "items": None, "rows": None}]
    assert parsers.docx_blocks(writers.docx(odd))[0]["text"] == "a<&>\"'"
    assert zipfile.ZipFile(io.BytesIO(writers.epub(odd))).infolist()[0].filename == "mimetype"


def test_layout_json(spark):
    a = layout.analyze(*glyph_tables(spark))
    got = json.loads(layout.layout_json(a, glyph_tables(spark)[1]).first()["json"])
    assert [p["page_number"] for p in got["pages"]] == [1, 2, 7] and got["removed"] == ["page #", "quarterly report"]
    assert [p["scanned"] for p in got["pages"]] == [False, False, True]
    assert [b["kind"] for b in got["pages"][0]["blocks"]] == ["heading", "paragraph", "paragraph"] and got["pages"][0]["column_count"] == 2
    assert got["pages"][1]["tables"][0]["rows"][0] == ["Item", "Value", "Status"] and got["pages"][2]["lines"] == []
    assert "# Annual Summary" in layout.markdown(a["blocks"], a["tables"]).first()["markdown"]
    assert "<h1>Annual Summary</h1>" in layout.html(a["blocks"], a["tables"]).first()["html"]


def test_placement(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    assert tuple(one(spark, G.place(F.lit("top-left"), *n(100, 200, 10, 20, 5)))) == (5, 175)
    assert tuple(one(spark, G.place(F.lit("middle-center"), *n(100, 200, 10, 20, 5)))) == (45, 90)
    assert tuple(one(spark, G.place(F.lit("bottom-right"), *n(100, 200, 10, 20, 5)))) == (85, 5)
    assert tuple(one(spark, G.css_overlay(F.struct(F.lit(5.0).alias("x"), F.lit(175.0).alias("y")), *n(200, 20, 2)))) == (10, 10)
    assert tuple(one(spark, G.header_zones(F.lit("a|b")))) == ("a", "b", "")
    assert tuple(one(spark, G.css_to_pdf(*n(20, 40, 100, 2)))) == (10, 80)
    assert tuple(one(spark, G.pdf_to_css(G.rect(*n(1, 2, 3, 4)), *n(100, 2)))) == (2, 188, 6, 8)
    assert one(spark, G.zone_y(F.lit("header"), *n(800, 30))) == 770
    assert tuple(one(spark, G.target_size("letter", True))) == (792, 612)
    assert tuple(one(spark, G.target_size("custom", False, G.custom_size(*n(2, 1), "in")))) == (72, 144)
    assert tuple(one(spark, G.image_page(*n(28_800, 100)))) == (14_400, 50) and tuple(one(spark, G.image_page(*n(10, 50)))) == (36, 50)
    assert one(spark, G.render_memory(*n(10.9, 10), 100)) == 1040 and one(spark, G.most_scale(*n(100, 400, 3, 800, 10**9))) == 2


def test_scalar_rules(spark):
    assert [one(spark, S.column_name(F.lit(k))) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert one(spark, S.segment_name(F.lit("my.file.pdf"), F.lit(2), F.lit(2))) == "my.file-page-2.pdf" and one(spark, S.segment_name(F.lit(""), F.lit(2), F.lit(5))) == "document-pages-2-5.pdf"
    assert [one(spark, S.error_code(F.lit(m))) for m in ("is Encrypted", "bad password", "Quota", "x")] == ["ENCRYPTED_PDF", "WRONG_PASSWORD", "QUOTA_EXCEEDED", "UNKNOWN"]
    assert one(spark, S.escape_xml(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;" and one(spark, S.base_name(F.lit(".pdf"))) == "document"
    said = [one(spark, S.output_error(F.lit(bytearray(b)))) for b in (b"", b"x%PDF-", b"%PDF-1", b"%PDF-" + b"x" * 100)]
    assert said == ["empty output", "no document mark at the start", "output too small", None]
    assert one(spark, S.strip_space(F.lit(" \t a b﻿\n"))) == "a b"


def test_pages_and_rectangles(spark):
    p = spark.createDataFrame([("d", k) for k in range(1, 8)], "doc_id string, page int")
    assert [(r["chunk"], r["first"], r["last"]) for r in pages.chunks(p, 3).orderBy("chunk").collect()] == [(0, 1, 3), (1, 4, 6), (2, 7, 7)]
    assert sorted(r["src_idx"] for r in pages.rotated(p, 90, [2, 9]).collect()) == [2]
    at = lambda *k: spark.createDataFrame([("d", x) for x in k], "doc_id string, out_idx int")
    e = pages.edited(pages.rotated(p, 0, [1, 2, 3]), at(1), at(3)).orderBy("out_idx").collect()
    assert [(r["out_idx"], r["src_idx"]) for r in e] == [(0, 2), (1, 3), (2, 3)]
    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "file string, page int")
    order = spark.createDataFrame([("a", 20_001), ("b", 3)], "file string, file_ord long")
    assert sorted((r["file"], r["page"], r["out_page"]) for r in pages.merged(files, order).collect()) == [("a", 1, 2), ("a", 2, 3), ("b", 1, 1)]
    items = spark.createDataFrame([("d", 1, 0, "to a@b.io", 10.0, 100.0, 90.0, 10.0)], "doc_id string, page_number int, item_id int, text string, e double, f double, width double, size double")
    r = pii.match_rectangles(items).first()
    assert r["value"] == "a@b.io" and [round(v, 6) for v in r["rect"]] == [39.0, 97.2, 62.0, 11.8]
    by = pii.rectangles_by_page(pii.match_rectangles(items)).first()
    assert by["n"] == 1 and round(by["area"], 3) == 731.6


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_word_packages():
    w = 'xmlns:w="urn:w" xmlns:r="urn:r"'
    item = lambda n, t: f'<w:p><w:pPr><w:numPr><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H"/><w:jc w:val="center"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t> not</w:t></w:r><w:hyperlink r:id="L"><w:r><w:t> go</w:t></w:r></w:hyperlink></w:p>'
        + item(1, "a") + item(1, "b") + item(2, "c") + '<w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    parts = {
        "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="L" Target="https://x.y"/></Relationships>',
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>', "word/footer1.xml": f"<w:ftr {w}><w:p><w:r><w:t>foot</w:t></w:r></w:p></w:ftr>",
        "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="7"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    }
    b = parsers.docx_blocks(package(parts))
    assert [x["kind"] for x in b] == ["heading", "paragraph", "list", "list", "page-break", "paragraph", "table", "margin"]
    assert (b[0]["level"], b[0]["align"], b[2]["ordered"], b[2]["items"], b[3]["ordered"], b[6]["rows"], b[7]["text"]) == (2, "center", True, ["a", "b"], False, [["x\ny"]], "foot")
    assert [(r["text"], r["bold"], r["href"]) for r in b[1]["runs"]] == [("bold", True, None), (" not", False, None), (" go", False, "https://x.y")]
    assert b[1]["runs"][0]["color"] == (1, 0, 0)


def test_workbooks():
    cell = lambda r, s, v, more="": f'<c r="{r}" s="{s}">{more}<v>{v}</v></c>'
    sheet = f'<worksheet><sheetData><row>{cell("A1", 1, 0.256)}{cell("B1", 2, 45000.5)}{cell("C1", 3, 45000)}{cell("D1", 4, 1234567.891)}{cell("E1", 0, 1.5, "<f>3/2</f>")}</row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    styles = '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd hh:mm"/></numFmts><cellXfs><xf/><xf numFmtId="10"/><xf numFmtId="170"/><xf numFmtId="15"/><xf numFmtId="4"/></cellXfs></styleSheet>'
    book = package({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/><sheet name="T"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": sheet, "xl/styles.xml": styles})
    b = parsers.xlsx_blocks(book, sheets=["T"])
    assert [x["kind"] for x in b] == ["heading", "table", "warning", "warning"] and b[0]["text"] == "T"
    assert b[1]["rows"] == [["25.60%", "2023-03-15 12:00:00", "2023-03-15", "1,234,567.89", "1.5"]]
    assert len([x for x in parsers.xlsx_blocks(book) if x["kind"] == "table"]) == 2


def test_files(spark, tmp_path):
    exif = b"Exif\0\0" + b"II*\0\x08\0\0\0" + b"\x01\0" + b"\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    photo = b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif + b"\xff\xd9"
    (tmp_path / "a.jpg").write_bytes(photo)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "c.txt").write_bytes(b"caf\xe9")
    read = files.read_files(spark, str(tmp_path))
    assert sorted((r["name"], r["size"], r["format"]) for r in read.select("name", "size", "format").collect()) == [("a.jpg", len(photo), "jpeg"), ("b.jpg", 3, "jpeg"), ("c.txt", 4, None)]
    assert sorted(tuple(r)[1:] for r in files.orientations(files.read_files(spark, str(tmp_path), "*.jpg")).collect()) == [(1, False), (6, True)]
    assert [tuple(r)[1:] for r in files.decoded_files(files.read_files(spark, str(tmp_path), "*.txt")).collect()] == [("café", "windows-1252")]


def test_glyphs_of_items(spark):
    rows = [
        ("d", 1, 0, "A", [0.0, 12.0, -12.0, 0.0, 100.0, 700.0], -50.0, 0.0, "Arial-BoldItalic", None, "rtl"), ("d", 1, 1, "\u00a0", [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 1.0, 1.0, None, None, None),
        ("d", 1, 2, "b", [0.0] * 4 + [900.0, -5.0], None, 14.0, None, "Demi", None), ("d", 9, 3, "x", [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 1.0, 1.0, None, None, None),
    ]
    items = spark.createDataFrame(rows, "doc_id string, page_number int, item_id int, text string, transform array<double>, width double, height double, font_name string, font_family string, dir string")
    p = spark.createDataFrame([("d", 1, 600.0, 800.0, 0.0)], "doc_id string, page_number int, width double, height double, rotation double")
    got = {r["item_id"]: r for r in files.glyphs_of(items, p).collect()}
    assert set(got) == {0, 2}
    a, b = got[0], got[2]
    assert (a["x"], round(a["y"], 2), a["width"], a["height"], a["font_size"], a["rotation"], a["bold"], a["italic"], a["direction"]) == (100, 90.16, 50, 12, 12, 90, True, True, "rtl")
    assert (b["x"], b["y"], b["width"], b["height"], b["font_size"], b["bold"], b["direction"]) == (600, 793.52, 0, 14, 14, True, "ltr")


def test_lookups(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    items = make([("d", 1, "a"), ("d", 1, "b"), ("d", 2, "c")], "doc_id string, page_number int, text string")
    seen = make([("d", 1, "A")], "doc_id string, page_number int, text string")
    assert sorted(r["text"] for r in lookups.recognised_items(items, seen).collect()) == ["A", "c"]
    rasters = make([("d", 1, "r")], "doc_id string, page_number int, raster string")
    assert sorted((r["text"], r["raster"]) for r in lookups.pages_with_rasters(items, rasters).collect()) == [("a", "r"), ("b", "r"), ("c", None)]
    assert [r["text"] for r in lookups.regions_without_raster(items, rasters).collect()] == ["c"]
    assert tuple(lookups.region_totals(items).first()) == ("d", 3, 2)
    images = make([("i", "x")], "image_ref string, image string")
    assert [r["n"] for r in lookups.objects_with_images(make([("i", 1), ("j", 2), (None, 3)], "image_ref string, n int"), images).collect()] == [1]
    blocks = make([("d", 1, 0, None), ("d", 1, 1, "t"), ("d", 1, 2, "gone")], "doc_id string, page_number int, block int, table_id string")
    tables = make([("d", 1, "t", [["x"]])], "doc_id string, page_number int, table_id string, rows array<array<string>>")
    assert {r["block"]: r["rows"] for r in lookups.blocks_with_rows(blocks, tables).collect()} == {0: [], 1: [["x"]], 2: []}
    assert sorted(r["block"] for r in lookups.blocks_with_rows(blocks, tables, False).collect()) == [0, 1]
    assert lookups.chosen(items, "text", []).count() == 3 and lookups.chosen(items, "text", ["a"]).count() == 1
    assert [one(spark, lookups.known_language(F.lit(x))) for x in ("eng", "deu", None)] == [True, False, False]
    tools = make([(1, True, "x"), (2, False, "x"), (3, True, "y")], "id int, available boolean, category string")
    assert [r["id"] for r in lookups.available_tools(tools, "x").collect()] == [1] and lookups.tool(tools, 3).count() == 1
    fonts = make([("d", "B", 1), ("d", "A", 2), ("d", "B", 3), ("d", None, 0)], "doc_id string, font string, n int")
    assert lookups.distinct_in_order(fonts, "doc_id", "font", "n").first()["values"] == ["B", "A"]
    slides = make([("d", "<p:grpSp><a:gradFill x/></p:grpSp>"), ("d", "<p:transition/><a:gradFill/>")], "doc_id string, xml string")
    assert tuple(lookups.slide_counts(slides).first()) == ("d", 2, 1, 0, 1)
    found = pii.find_pii(make([(1, "1.2.3.4 a@b.io")], "doc_id long, text string"))
    assert [(r["place"], r["type"]) for r in lookups.in_order(found).orderBy("place").collect()] == [(0, "ip-address"), (1, "email")]
    m = make([("a", "1"), ("b", "2")], "name string, digest string")
    assert lookups.same_manifest(m, m).count() == 0 and sorted(map(tuple, lookups.same_manifest(m, make([("a", "1"), ("b", "3")], "name string, digest string")).collect())) == [("b", "2", "left"), ("b", "3", "right")]
    h = make([(k, k) for k in range(60)], "event_id int, ts int")
    new = events.recorded(h, make([(59, 100), (60, 101)], "event_id int, ts int"))
    assert new.count() == 50 and new.where("event_id = 59").first()["ts"] == 100 and events.deleted(new, [60]).count() == 49 and events.deleted(new).count() == 0


def test_a_package_without_a_key_keeps_none(spark):
    files = spark.createDataFrame([(None, "a.txt", bytearray(b"x")), ("None", "b.txt", bytearray(b"y"))], "doc_id string, name string, content binary")
    assert sorted(((r["doc_id"], r["name"]) for r in writers.zip_packages(files).collect()), key=str) == [("None", "None.zip"), (None, "document.zip")]
