from __future__ import annotations

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.operators import events, layout, lines, pages, pii, scoring, text_lines
from leafmill.sources import parsers


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_pii_types_and_offsets(spark):
    text = "Mail jane@corp.io or +91 98765 43210, card 4111-1111-1111-1111, PAN ABCDE1234F, host 10.0.0.1."
    found = pii.find_pii(docs(spark, text, "nothing here", None)).orderBy("start").collect()
    assert {r["type"] for r in found} >= {"email", "phone", "credit-card", "pan", "ip-address"}
    assert [r["value"] for r in found if r["type"] == "email"] == ["jane@corp.io"]
    assert all(text[r["start"] : r["end"]].strip() == r["value"] for r in found)


def test_pii_edges(spark):
    kinds = lambda t: [r["type"] for r in pii.find_pii(docs(spark, t)).collect()]
    assert "credit-card" not in kinds("Invoice 1234 5678 9012 3456 due")
    assert "credit-card" in kinds("credit 1234 5678 9012 3456 due")
    assert kinds("éABCDE1234F ABCDE1234F") == ["pan", "pan"]
    assert kinds("id 827271662904.") == ["aadhaar"]
    assert "phone" not in kinds("call 2024-555-123")


def test_pii_custom(spark):
    found = pii.find_pii(docs(spark, "ref GX-99312"), set(), [r"GX-[0-9]{5}", " "]).collect()
    assert [(r["type"], r["value"]) for r in found] == [("custom", "GX-99312")]
    assert pii.find_pii(docs(spark, "abc"), set(), ["^|$"]).count() == 0
    spots = [(r["start"], r["value"]) for r in pii.find_pii(docs(spark, "xxabxxxa"), set(), ["a?b?"]).collect()]
    assert spots == [(2, "ab"), (7, "a")]
    many = pii.find_pii(docs(spark, "-" * 12_000 + "42"), set(), ["[0-9]*"]).collect()
    assert [(r["start"], r["value"]) for r in many] == [(12_000, "42")]
    for bad in ("([bad", "x" * 201, "(?P<n>x)"):
        with pytest.raises(ValueError, match="INVALID_INPUT"):
            pii.custom_detectors([bad])


def test_redaction_and_leftovers(spark):
    d = docs(spark, "a b@c.io d 1.2.3.4", "plain")
    out = {r["doc_id"]: (r["text"], r["n_masked"]) for r in pii.redacted(d).collect()}
    assert out == {0: ("a ██████ d ███████", 13), 1: ("plain", 0)}
    terms = spark.createDataFrame([("B@C.io ",), ("gone-term",), ("ab",), ("plain",)], "term string")
    assert {r["term"] for r in pii.redaction_leftovers(d, terms).collect()} == {"B@C.io", "plain"}
    tabbed = spark.createDataFrame([("\tpl\u00a0ain\n",)], "term string")
    assert [r["term"] for r in pii.redaction_leftovers(d, tabbed).collect()] == ["pl\u00a0ain"]
    assert pii.redaction_leftovers(d, terms.where("false")).count() == 0


def test_redaction_of_odd_rows(spark):
    """Rows without id or with a repeated one, overlapping matches, null and empty texts."""
    rows = [(None, "mail a@b.io now"), (None, None), (3, "x@y.org"), (3, "nothing in this one"), (4, ""), (5, "4111 1111 1111 1111 and 4111 1111 1111 1111"), (6, "\ufdd0 a@b.io \ufdd1")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, found string")
    got = sorted(((r["doc_id"], r["text"], r["n_masked"]) for r in pii.redacted(d).collect()), key=str)
    card = "█" * 19
    assert got == sorted([(None, "mail ██████ now", 6), (None, None, 0), (3, "█" * 7, 7), (3, "nothing in this one", 0), (4, "", 0), (5, f"{card}█and {card}", 39), (6, "\ufdd0 ██████ \ufdd1", 6)], key=str)
    kept = pii.redacted(d).select(F.size(pii.leftovers(F.col("text"), F.col("found"))).alias("n")).where("n > 0").count()
    assert kept == 0
    plan = pii.redacted(d)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_search_marks(spark):
    found = pii.search_marks(docs(spark, "AaaA. aa"), "aa").orderBy("start").collect()
    assert [(r["start"], r["end"], r["value"]) for r in found] == [(0, 2, "Aa"), (2, 4, "aA"), (6, 8, "aa")]


def test_page_ranges(spark):
    parse = lambda e: spark.range(1).select(pages.parse_ranges(F.lit(e), F.lit(10)).alias("r")).first()["r"]
    assert parse("1-3,5, 2")["pages"] == [1, 2, 3, 5]
    assert parse("4-2")["pages"] == [2, 3, 4] and len(parse("4-2")["warnings"]) == 1
    assert [parse(e)["error"] for e in ("", "1,,2", "x", "0", "9-11")] == ["empty expression", "empty page range", "invalid page range", "page range out of bounds", "page range out of bounds"]


def test_segments_runs_labels(spark):
    got = spark.range(1).select(pages.every_n(F.lit(7), F.lit(3)).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [(1, 3), (4, 6), (7, 7)]
    r = spark.createDataFrame([(0, p) for p in (1, 2, 3, 7, 9, 10, 10)], "doc_id long, page int")
    assert sorted((x["start"], x["end"]) for x in pages.runs(r, "doc_id", "page").collect()) == [(1, 3), (7, 7), (9, 10)]
    t = spark.range(1).select(pages.target_pages(F.array(F.lit(5), F.lit(2), F.lit(99), F.lit(2)), F.lit(6)).alias("t"), pages.target_pages(F.array(F.lit(99)), F.lit(3)).alias("a")).first()
    assert (t["t"], t["a"]) == ([2, 5], [1, 2, 3])


def test_arrange(spark):
    p = spark.createDataFrame([(0, 0, 0), (0, 1, 90)], "doc_id long, page int, rotation int")
    d = spark.createDataFrame([(0, 0, 1, 300), (0, 1, 0, 0), (0, 2, 0, 90)], "doc_id long, out_idx int, src_idx int, rotate_delta int")
    assert [(r["page"], r["rotation"]) for r in pages.arrange(p, d).orderBy("out_idx").collect()] == [(1, 30), (0, 0), (0, 90)]


def test_events(spark):
    m = F.create_map(*[F.lit(x) for x in ("toolId", "a", "fileName", "f", "errorCode", "x" * 65)])
    r = spark.range(1).select(events.sanitized(m).alias("s")).first()["s"]
    assert r["sanitized"] == {"toolId": "a"} and r["dropped_keys"] == ["errorCode", "fileName"]


def test_wrap(spark):
    w = lambda t, n: spark.range(1).select(lines.wrapped(F.lit(t), n).alias("w")).first()["w"]
    assert w("aa bb cc", 5) == ["aa bb", "cc"]
    assert w("long-word x", 4) == ["long-word", "x"]
    assert w("a\n\nb", 10) == ["a", "", "b"]


def test_text_blocks_and_transcript(spark):
    b = lines.text_blocks(docs(spark, "Intro\nline\n\n1. one\n2. two\n- dot\nend")).orderBy("block").collect()
    assert [(r["kind"], r["ordered"], r["n_lines"], r["text"]) for r in b] == [("paragraph", False, 2, "Intro line"), ("list", True, 2, "one\ntwo"), ("list", False, 1, "dot"), ("paragraph", False, 1, "end")]
    t = lines.transcript(docs(spark, "[1:02:03] hello\nthere\r\n\r\n[00:05] bye")).orderBy("paragraph", "line").collect()
    assert [(r["stamp"], r["text"]) for r in t] == [("1:02:03", "hello"), (None, "there"), ("00:05", "bye")]


def test_scoring(spark):
    names = list(scoring.WEIGHTS)
    f = spark.createDataFrame([(0, *[n in ("author", "gps", "exif") for n in names], 9, 3)], "doc_id long, " + ", ".join(f"{n} boolean" for n in names) + ", n_annotations int, n_links int")
    assert scoring.privacy_scores(f).first()["score"] == 100 - 8 - 20 - 12 - 3
    a = spark.createDataFrame([(0, 1, 100, 60, 50), (0, 2, 100, 40, 50), (0, 3, 100, 40, 50)], "doc_id long, attempt int, in_bytes long, out_bytes long, target long")
    b = scoring.best_attempt(a).first()
    assert (b["attempt"], b["percent"], b["target_reached"]) == (2, 60.0, True)
    h = spark.createDataFrame([(0, 10, 50), (0, 200, 50), (1, 5, 9)], "image_id long, level int, n long")
    assert {r["image_id"]: r["threshold"] for r in scoring.otsu(h).collect()} == {0: 10, 1: 127}


def glyph_tables(spark):
    rows = []

    def put(page, text, x, y, size=10.0, bold=False, direction="ltr", width=None):
        rows.append(("d", page, len(rows), text, float(x), float(y), float(len(text) * size * 0.5 if width is None else width), size, size, 0.0, bold, direction))

    for page in (1, 2):
        put(page, "Quarterly report", 50, 18)
        put(page, f"Page {page}", 280, 770)
    put(1, "Annual Summary", 50, 60, 22.0, True)
    for i, y in enumerate((110, 126)):
        put(1, f"left column line {i} text here", 45, y)
        put(1, f"right column line {i} text here", 330, y)
    for r, cells in enumerate((("Item", "Value", "Status"), ("Debt", "900.10", "Open"), ("Cash", "1200.50", "Verified"), ("Fees", "33.00", "Open"))):
        for x, text in zip((50, 220, 390), cells, strict=True):
            put(2, text, x, 110 + 24 * r, 10.0, r == 0)
    schema = "doc_id string, page_number int, item_id int, text string, x double, y double, width double, height double, font_size double, rotation double, bold boolean, direction string"
    p = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 600.0, 800.0), ("d", 7, 300.0, 400.0)], "doc_id string, page_number int, width double, height double")
    return spark.createDataFrame(rows, schema), p


def test_layout_report(spark):
    a = layout.analyze(*glyph_tables(spark))
    assert {r["norm"] for r in a["repeated"].collect()} == {"quarterly report", "page #"}
    t = a["tables"].where("page_number = 2").collect()
    assert len(t) == 1 and t[0]["confidence"] >= 0.68 and t[0]["rows"][2] == ["Cash", "1200.50", "Verified"]
    b = a["blocks"].orderBy("page_number", "block").collect()
    assert [(r["kind"], r["text"]) for r in b if r["page_number"] == 1] == [
        ("heading", "Annual Summary"), ("paragraph", "left column line 0 text here left column line 1 text here"), ("paragraph", "right column line 0 text here right column line 1 text here"),
    ]
    assert [r["table_id"] for r in b if r["page_number"] == 2] == ["table-p2-1"]
    assert [r["page_number"] for r in a["scanned"].collect()] == [7]


def test_layout_joins(spark):
    schema = glyph_tables(spark)[0].schema
    row = lambda i, text, x, w, d="ltr", page=1: ("d", page, i, text, float(x), 40.0, float(w), 10.0, 10.0, 0.0, False, d)
    g = spark.createDataFrame([row(0, "日", 20, 10), row(1, "本", 35, 10), row(2, "語", 50, 10), row(3, "אב", 80, 10, "rtl", 2), row(4, "גד", 60, 10, "rtl", 2)], schema)
    p = spark.createDataFrame([("d", 1, 300.0, 400.0), ("d", 2, 300.0, 400.0)], "doc_id string, page_number int, width double, height double")
    got = {r["page_number"]: (r["text"], r["direction"]) for r in layout.lines_of(layout.banded(g, p)).collect()}
    assert got == {1: ("日本語", "ltr"), 2: ("אב גד", "rtl")}


def test_csv():
    assert parsers.detect_delimiter('a;b\n"x;y";"1\n2"\nc;d') == ";"
    assert parsers.csv_rows('a;b\n"x;y";"1\n2"\nc;d', ";") == [["a", "b"], ["x;y", "1\n2"], ["c", "d"]]
    assert parsers.csv_rows('a,"b""c"\r\n,\r\nlast,"open', ",") == [["a", 'b"c']]
    assert [len(b["rows"][0]) for b in parsers.csv_blocks(",".join(map(str, range(22))))] == [10, 10, 2]


def test_markdown_and_html():
    md = "# Title\n\nsome **bold** text\n\n- a\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n```py\ncode\n```\n<!-- pagebreak -->\n"
    assert [b["kind"] for b in parsers.markdown_blocks(md)] == ["heading", "paragraph", "list", "table", "code", "page-break"]
    title, blocks, omitted = parsers.html_document("<title>Safe  report</title><style>x</style><h1>Hi</h1><script>bad()</script><p>a <b>b</b></p><iframe src=x></iframe><img src='http://e/x.png'>")
    assert title == "Safe report" and [(b["kind"], b["text"]) for b in blocks] == [("heading", "Hi"), ("paragraph", "a b")]
    assert omitted == ["active content", "external images"]


def test_html_model():
    page = """<body>loose <i>text</i><div style="page-break-before: always"><h2 style="text-align:center">A &amp; B</h2><p>one <b>two <a href=" HTTP://x.y ">link</a></b> <a href="javascript:x">no</a><br>
      three<p>next</div><blockquote><p>quoted</p></blockquote><ol start="4"><li>x<li>y <b>z</b></ol><pre> a
  b</pre><table><tr><th>h<th>i<tr><td>1<td><table><tr><td>in</td></tr></table></td></table>
      <img src="data:image/png;base64,AAAA" alt="pic"><hr><form>f</form>tail</body>"""
    blocks = parsers.html_document(page)[1]
    assert [b["kind"] for b in blocks] == ["paragraph", "page-break", "heading", "paragraph", "paragraph", "quote", "list", "code", "table", "image", "rule", "paragraph"]
    assert (blocks[2]["text"], blocks[2]["align"], blocks[5]["text"], blocks[6]["items"], blocks[6]["start"]) == ("A & B", "center", "quoted", ["x", "y z"], 4)
    assert blocks[8]["rows"] == [["h", "i"], ["1", "in"]] and blocks[8]["header_rows"] == 1 and blocks[7]["text"] == " a\n  b"
    runs = [(r["text"], r["bold"], r["href"]) for r in blocks[3]["runs"]]
    assert runs[:4] == [("one ", False, None), ("two ", True, None), ("link", True, "HTTP://x.y"), (" ", False, None)] and runs[4][2] is None
    links = "<a href='b'>x</a><a href=http://c>y</a><script><a href=d></script><A HREF=\"mailto:m\">z</A><a name=n>w</a>"
    assert parsers.html_links_of(links) == [("b", False), ("http://c", True), ("mailto:m", True)]
    assert parsers.css_color("#0f8") == (0, 1, 136 / 255) and parsers.css_color("rgb(300, 0,51)") == (1, 0, 0.2) and parsers.css_color("red") is None
    md = parsers.markdown_blocks("a **b _c_** `d*` ~~e~~ ![f](g) [h](http://i \"t\") \\*j\\* snake_case_name\n\n3. x\n4. y")
    assert md[0]["text"] == "a b c d* e [Image: f] h *j* snake_case_name" and md[1]["start"] == 3
    assert [r["text"] for r in md[0]["runs"] if r["bold"]] == ["b ", "c"] and [r["text"] for r in md[0]["runs"] if r["href"]] == ["h"]


def test_titles_and_links_of_pages(spark):
    d = spark.createDataFrame([(1, "<TITLE>A &amp;\n B</TITLE><a href='x'>"), (2, "no"), (3, None)], "page_id long, html string")
    assert sorted(map(tuple, parsers.html_titles(d).collect())) == [(1, "A & B"), (2, "")]
    assert list(map(tuple, parsers.html_links(d).collect())) == [(1, 0, "x", False)]


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_packages():
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    book = _zip(xl__workbook_dot_xml='<workbook><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings_dot_xml="<sst><si><t>hello</t></si></sst>", xl__worksheets__sheet1_dot_xml=sheet)
    assert parsers.xlsx_blocks(book)[1]["rows"] == [["hello", "", "2"]]
    w = 'xmlns:w="urn:w"'
    doc = _zip(word__document_dot_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>')
    assert [(b["kind"], b["text"]) for b in parsers.docx_blocks(doc)] == [("heading", "T"), ("paragraph", "x")]
    assert parsers.resolve_path("a/./b/../c") == "a/c"
    assert parsers.decode_text(b"caf\xe9") == ("café", False)


def test_blocks_frame(spark):
    d = spark.createDataFrame([(1, "a,b\n1,2"), (2, None), (3, "")], "doc_id long, source string")
    got = parsers.blocks(d, "csv").collect()
    assert [(r["doc_id"], r["kind"], r["rows"]) for r in got] == [(1, "table", [["a", "b"], ["1", "2"]])]


def test_broken_sources_give_an_error(spark):
    good = bytearray(_zip(word__document_dot_xml="<d><body><p><r><t>x</t></r></p></body></d>"))
    bad = bytearray(good)
    bad[40:60] = b"\xff" * 20
    d = spark.createDataFrame([(1, good), (2, bad), (3, bytearray(b"PK")), (4, bytearray(_zip(x="y")))], "doc_id long, source binary")
    assert [r["kind"] for r in parsers.blocks(d, "docx").orderBy("doc_id").collect()] == ["paragraph", "error", "error", "error"]


def test_no_rows_are_lost_unsaid(spark):
    text = "\n".join(f"{i},x" for i in range(12_000))
    assert len(parsers.csv_blocks(text)[0]["rows"]) == 12_000
    table, said = parsers.csv_blocks(text, max_rows=200)
    assert len(table["rows"]) == 200 and said["kind"] == "warning"
    assert len(parsers.csv_blocks("a,b\n1,2", max_rows=2)) == 1
    assert [b["kind"] for b in parsers.csv_blocks(",".join(map(str, range(41))))] == ["table"] * 4 + ["warning"]
    cells = "".join(f'<row><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 10_102))
    book = _zip(xl__workbook_dot_xml='<workbook><sheets><sheet name="S"/></sheets></workbook>', xl__worksheets__sheet1_dot_xml=f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    assert len(parsers.xlsx_blocks(book)[1]["rows"]) == 10_101
    assert [b["kind"] for b in parsers.xlsx_blocks(book, max_rows=10)] == ["heading", "table", "warning"]
    slides = _zip(**{f"ppt__slides__slide{i}_dot_xml": "<s><p><t>x</t></p></s>" for i in range(1, 252)})
    refs, items = "".join(f'<itemref idref="i{i}"/>' for i in range(301)), "".join(f'<item id="i{i}" href="c.html"/>' for i in range(301))
    book = {"META-INF/container.xml": '<c><rootfile full-path="p.opf"/></c>', "p.opf": f"<p><manifest>{items}</manifest><spine>{refs}</spine></p>", "c.html": "<p>x</p>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, t in book.items():
            z.writestr(name, t)
    for fmt, content in (("pptx", slides), ("epub", out.getvalue())):
        d = spark.createDataFrame([(1, bytearray(content))], "doc_id long, source binary")
        assert [r["kind"] for r in parsers.blocks(d, fmt).collect()] == ["error"]


def test_large_pages_and_texts_take_linear_time(spark):
    n = 100_000
    i = F.col("id")
    g = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), i.cast("int").alias("item_id"), F.lit("w").alias("text"), ((i % 250) * 2.2).alias("x"), (F.floor(i / 250) * 12.0).alias("y"), F.lit(2.0).alias("width"),
        F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"), F.lit(0.0).alias("rotation"), F.lit(False).alias("bold"), F.lit("ltr").alias("direction"),
    )
    p = spark.createDataFrame([(1, 1, 600.0, 5000.0)], "doc_id int, page_number int, width double, height double")
    began = time.time()
    lines_found = layout.lines_of(layout.banded(g, p)).select("text").collect()
    assert len(lines_found) == n // 250 and {r["text"] for r in lines_found} == {"w" * 250}
    rows = text_lines.baseline_lines(g.withColumn("y", -F.col("y"))).select("text", "n_items").collect()
    assert len(rows) == n // 250 and {(r["text"], r["n_items"]) for r in rows} == {("w" * 250, 250)}
    long = spark.createDataFrame([(1, ("word " * n).strip())], "doc_id int, text string")
    assert lines.paginated(long, 9, 10).count() == n // 2 and lines.paginated(long, 4, 10).count() == n
    mails = spark.createDataFrame([(1, "a@b.io " * (n // 4))], "doc_id int, text string")
    assert pii.find_pii(mails, {"email"}).count() == n // 4
    assert time.time() - began < 120


def test_a_page_that_cannot_be_parsed_concerns_itself_only(spark):
    p = spark.createDataFrame([(1, "<![foo[x"), (2, '<title>T</title><a href="http://a.example">x</a>'), (3, None)], "page_id long, html string")
    assert {r["page_id"]: r["title"] for r in parsers.html_titles(p).collect()} == {1: "", 2: "T"}
    assert [(r["page_id"], r["href"]) for r in parsers.html_links(p).collect()] == [(2, "http://a.example")]
    assert parsers.decode_text(b"a\x81\x9d\x80\xff") == ("a\x81\x9d€ÿ", False)


def test_transcripts_have_bold_stamps_and_a_guard(spark):
    d = docs(spark, " [01:02.5] a\rb\n\n \n\n[123:00] c")
    got = lines.transcript(d).orderBy("paragraph", "line").collect()
    assert [(r["paragraph"], r["stamp"], r["text"], [(x["text"], x["bold"]) for x in r["runs"]]) for r in got] == [
        (0, "01:02.5", "a", [("[01:02.5] ", True), ("a", False)]), (0, None, "b", [("b", False)]), (1, None, "[123:00] c", [("[123:00] c", False)]),
    ]
    assert lines.transcript(d, 40).count() == 3
    with pytest.raises(Exception, match="MEMORY_LIMIT"):
        lines.transcript(d, 5).collect()


def test_lines_by_measured_width(spark):
    narrow = lines.width_in({"i": 1, "m": 3}, 2)
    got = docs(spark, "mm iiii mm\n\nmmmmmm i").select(lines.wrapped(F.col("text"), 11, narrow, 1).alias("l")).first()["l"]
    assert got == ["mm iiii", "mm", "", "mmmmmm", "i"]


def test_table_reasons_and_positioned_html(spark):
    glyph = lambda i, t, x, y, b=False: (1, 1, i, t, float(x), float(y), 5.0 * len(t), 10.0, 10.0, 0.0, b, "ltr")
    rows = [glyph(10 * r + c, f"{r}{c}" if c else "a<b", 45 + 155 * c, 95 + 24 * r, r == 0) for r in range(4) for c in range(3)]
    g = spark.createDataFrame(rows, "doc_id int, page_number int, item_id int, text string, x double, y double, width double, height double, font_size double, rotation double, bold boolean, direction string")
    p = spark.createDataFrame([(1, 1, 600.0, 800.5), (1, 2, 10.0, 20.0)], "doc_id int, page_number int, width double, height double")
    l = layout.lines_of(layout.banded(g, p))
    (t,) = layout.tables_of(l).collect()
    assert t["reasons"][:4] == ["100% of the cells' beginnings aligned", "100% of the rows with the usual number of cells", "4 rows", "bold first row"] and t["reasons"][4].startswith("67%")
    page = layout.positioned_html(layout.reading_order(l), p).first()["html"]
    assert page.count("<span") == 12 and 'style="left:45pt;top:95pt;font-size:10pt;font-weight:700">a&lt;b</span>' in page and 'aria-label="Page 2" style="width:10pt;height:20pt"></section>' in page and "height:800.5pt" in page


def test_findings_are_counted_from_objects(spark):
    o = [(1, "annotation", None), (1, "annotation", "URI"), (1, "link", None), (1, "xmp", None), (2, "annotation", "JavaScript"), (3, "unknown", None)]
    f = scoring.features_of(spark.createDataFrame(o, "doc_id int, kind string, action string"))
    got = {r["doc_id"]: (r["n_annotations"], r["n_links"], r["xmp"], r["javascript"]) for r in f.collect()}
    assert got == {1: (2, 2, True, False), 2: (1, 0, False, True), 3: (0, 0, False, False)}
    assert {r["doc_id"]: (r["n_findings"], r["score"]) for r in scoring.privacy_scores(f).collect()} == {1: (3, 100 - 10 - 8 - 2), 2: (2, 100 - 15 - 7), 3: (0, 100)}


def test_titles_keep_references_without_a_semicolon(spark):
    cut = "<title>a&amp;&amp</title>", "<title>&amplt; &lt;b&gt;&#39;&eacute; & c\f d</title>", "<title>x&copy=1&#39 &nothing;</title>"
    d = spark.createDataFrame(list(enumerate(cut)), "page_id long, html string")
    assert [r["title"] for r in parsers.html_titles(d).orderBy("page_id").collect()] == ["a&&amp", "&amplt; <b>'é & c d", "x&copy=1&#39 &nothing;"]


def test_blocks_are_handed_on_in_small_frames():
    pd = pytest.importorskip("pandas")
    page = "<p>a</p>" * 100
    frames = list(parsers.block_frames(iter([pd.DataFrame({"k": range(500), "s": [page] * 499 + [page * 50]})]), parsers.PARSERS["html"]))
    assert [len(f) <= parsers.BLOCKS_AT_ONCE for f in frames].count(False) == 1 and sum(map(len, frames)) == 499 * 100 + 5000
    assert len(list(parsers.block_frames(iter([pd.DataFrame({"k": [], "s": []})]), parsers.PARSERS["html"]))[0]) == 0


def test_lines_set_from_texts_are_those_of_their_glyphs(spark):
    """The same lines as through glyph rows, without a shuffle before the lines."""
    texts = ["a b c d e f g h i\n\n j" * 90, "\u6f22\u5b57 x \u6f22 y", "\u00a0 \u2003 z\u00a0", "\u00a0", "", " ", None, "w" * 200 + " x" * 20, "ab\u0085 \u6f22\u0085 c"]
    d = docs(spark, *texts)
    got = layout.set_lines(d)
    want = layout.lines_of(layout.banded(*layout.synthetic_glyphs(d))).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_line_arrays_against_rows(spark):
    """Lines of pages of odd geometry: mixed sizes, directions, overlaps and ties."""
    import numpy as np
    import pyarrow as pa

    from leafmill.operators.line_arrays import line_arrays

    r = np.random.default_rng(5)
    n = 1500
    g = {"page": np.sort(r.integers(0, 12, n)), "y": r.integers(0, 60, n) * 3.25, "x": r.integers(0, 150, n) * 4.0, "item_id": np.arange(n), "width": r.integers(0, 9, n) * 5.0, "height": r.choice([8.0, 10.0, 14.5], n)}
    g |= {"font_size": r.choice([8.0, 10.0, 24.0], n), "rotation": r.choice([0.0, 90.0], n), "bold": r.random(n) < 0.4, "rtl": r.random(n) < 0.5}
    words = [["a", "b\u6f22", "\u6f22c", " d", "e\t", "f  g"][k] for k in r.integers(0, 6, n)]
    l = line_arrays(g, pa.array(words), np.full(12, 600.0))
    got = sorted(zip(*[l[c].tolist() for c in ("page", "band", "seg", "x", "y", "width", "height", "font_size", "bold", "rotation", "rtl", "band_top", "band_bottom", "font")], [t.as_py().strip() for t in l["text"]], strict=True))
    rows = [(int(p), *[g[c][i].item() for c in ("item_id",)], words[i], *[g[c][i].item() for c in ("x", "y", "width", "height", "font_size", "rotation", "bold")], "rtl" if g["rtl"][i] else "ltr") for i, p in enumerate(g["page"])]
    d = spark.createDataFrame(rows, "doc_id long, item_id int, text string, x double, y double, width double, height double, font_size double, rotation double, bold boolean, direction string").withColumn("page_number", F.lit(1))
    p = d.select("doc_id", "page_number").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))
    want = layout.lines_of(layout.banded(d, p)).withColumn("rtl", F.col("direction") == "rtl")
    want = want.select("doc_id", "band", "seg", "x", "y", "width", "height", "font_size", "bold", "rotation", "rtl", "band_top", "band_bottom", "font", "text")
    assert got == sorted(map(tuple, want.collect()))


def test_baselines_set_from_texts_are_those_of_their_glyphs(spark):
    d = docs(spark, "a b c d e f g h i\n\n j" * 90, "\u6f22\u5b57 x", "\u00a0 \u2003 z\u00a0", "\u00a0", "", None, "w" * 200 + " x" * 20)
    got = text_lines.set_baseline_lines(d)
    g, _ = layout.synthetic_glyphs(d)
    want = text_lines.baseline_lines(g.withColumn("y", 800.0 - F.col("y"))).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def odd_lines(seed: int = 7, pages: int = 40) -> list[tuple]:
    """Lines of pages with bands of 0 to 13 cells, gaps of all sizes and cells off their column."""
    import random

    r = random.Random(seed)
    rows = []
    for page in range(1, pages + 1):
        top = 20.0
        for band in range(r.randrange(1, 25)):
            top += 10 + r.choice([0, 4, 20, 24, 25, 60])
            for seg in range(r.choice([1, 2, 3, 3, 3, 4, 4, 12, 13])):
                text = r.choice(["a", "1,5 %", "12", "x $3.5 y", "", "7% ", " 9"])
                rows.append(("d", page, band, seg, text, 40.0 * seg + r.choice([0, 0, 1.5]), top, 30.0, 10.0, r.choice([9.0, 10.0]), r.random() < 0.3, top, top + 10.0))
    return rows


LINES = "doc_id string, page_number int, band int, seg int, text string, x double, y double, width double, height double, font_size double, bold boolean, band_top double, band_bottom double"


def test_tables_of_lines_are_the_islands_of_their_bands(spark):
    """Each table, its cells and column beginnings, told again by plain loops; one shuffle by page and no sort of lines."""
    from itertools import groupby
    from statistics import median

    lines_in = odd_lines()
    found = layout.tables_of(spark.createDataFrame(lines_in, LINES).orderBy("text"), 0.45)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r["page_number"], r["number"]): (r["rows"], r["column_boundaries"], r["y"], round(r["y"] + r["height"], 6), r["reasons"][1]) for r in found.collect()}
    want = {}
    for page, of_page in groupby(lines_in, lambda l: l[1]):
        islands, last = [], None
        for band, cells in groupby(of_page, lambda l: l[2]):
            cells = list(cells)
            fits = 2 <= len(cells) <= 12
            if fits and last and last[0][2] == band - 1 and cells[0][11] - last[0][12] <= 24:
                islands[-1].append(cells)
            elif fits:
                islands.append([cells])
            last = cells if fits else None
        for number, island in enumerate((i for i in islands if len(i) >= 3), 1):
            sizes = [len(b) for b in island]
            columns = max(sizes, key=lambda n: (sizes.count(n), n))
            even = [b for b in island if len(b) == columns]
            edges = [median(b[c][5] for b in even) for c in range(columns)]
            share = int(len(even) / len(island) * 100 + 0.5)
            want[page, number] = ([[c[4] for c in b] for b in island], edges, island[0][0][11], island[-1][0][12], f"{share}% of the rows with the usual number of cells")
    assert len(got) > 20 and all(want[k] == v for k, v in got.items())


def test_tables_of_glyph_pages_are_those_of_their_lines(spark):
    g, p = glyph_tables(spark)
    got = layout.page_tables(layout.glyph_pages(g, p))
    want = layout.tables_of(layout.lines_of(layout.banded(g, p)))
    assert got.columns == want.columns and got.count() >= 1
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
