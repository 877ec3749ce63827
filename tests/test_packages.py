from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.sources import packages, parsers

MAIN, REL = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    return {
        "xl/workbook.xml": f'<workbook {MAIN} {REL}><sheets><sheet name="Two" sheetId="2" r:id="rId9"/><sheet name="" sheetId="1" r:id="rId1"/><sheet name="Gone" sheetId="3" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="t" Target="worksheets/a.xml"/><Relationship Id="rId9" Type="t" Target="/xl/worksheets/../worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {MAIN}><si><t xml:space="preserve"> one </t></si><si><r><rPr><b/></rPr><t>t</t></r><r><t>wo &amp; more</t></r></si><si/></sst>',
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts count="1"><numFmt numFmtId="164" formatCode="0.00%"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="22"/><xf numFmtId="4"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="s"><v>99</v></c></row>'
        '<row r="2"><c r="A2" s="1"><v>0.125</v></c><c r="B2" s="2"><v>45292</v></c><c r="C2" s="3"><v>45292.75</v></c><c r="D2" s="4"><v>1234567.891</v></c><c r="E2" s="77"><v>007</v></c></row>'
        '<row r="3"><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="b"><v>1</v></c><c t="e"/><c><f>SUM(A1:A2)</f></c><c t="str"><f>X()</f><v>cached</v></c></row><row r="4"/></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="B1"><v>5</v></c></row></sheetData></worksheet>',
    }


def read(spark, contents):
    files = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in contents], "doc_id string, content binary")
    return packages.package_parts(files)


def test_workbooks_by_joins(spark):
    content = packed(workbook())
    parts = read(spark, [("a", content), ("a", content), (None, content), ("broken", b"PK no zip"), ("null", None)])
    assert {r["doc_id"]: r["error"] for r in parts.where("error is not null").collect()}.keys() == {"broken"}
    rows = packages.workbook_rows(packages.workbook_cells(parts)).collect()
    assert len({r["package"] for r in rows}) == 3
    expected = {("Two", 0): ["", "5"], ("Sheet 2", 0): [" one ", "", "two & more", ""], ("Sheet 2", 1): ["12.50%", "2024-01-01", "2024-01-01 18:00:00", "1,234,567.89", "007"], ("Sheet 2", 2): ["inline", "TRUE", "#ERROR", "=SUM(A1:A2)", "cached"]}
    for p in {r["package"] for r in rows}:
        assert {(r["sheet"], r["row"]): r["cells"] for r in rows if r["package"] == p} == expected
    tables = [b["rows"] for b in parsers.xlsx_blocks(content) if b["kind"] == "table"]
    assert [expected["Two", 0]] == tables[0] and [expected["Sheet 2", k] for k in range(3)] == tables[1][:3]


def test_the_plan_joins(spark):
    plan = packages.workbook_cells(read(spark, [("a", packed(workbook()))]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") >= 4 and plan.count("Join Inner") >= 1 and "Python" not in plan


@pytest.mark.parametrize(("raw", "code"), [("0.5", "0%"), ("1e3", "#,##0"), ("12.345", "0.00"), ("abc", "0%"), ("45292.5", "yyyy\\-mm\\-dd"), ("2.5", "[h]:mm"), ("9e9", "d-mmm-yy"), ("1", ""), ("1", None), ("-1234.5", "#,##0.00"), ("", "0%"), ("NaN", "0%")])
def test_numbers_as_shown(spark, raw, code):
    got = spark.createDataFrame([(raw, code)], "raw string, code string").select(packages.number_shown(F.col("raw"), F.col("code"))).first()[0]
    assert got == parsers.number_text(raw, code)


def test_word_packages_by_joins(spark):
    p = lambda inner, props="": f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inner}</w:p>"
    run = lambda t: f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>'
    number = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    body = [
        p(run("Top"), '<w:pStyle w:val="H1x"/>'), p(run("a &amp; b") + "<w:r><w:tab/></w:r>" + run("c")), p(run("first"), number(5)), p(run("dot"), number(5, 1)), p(run("other"), number(6)), p(run("lost"), number(9)),
        p(f'{run("see ")}<w:hyperlink r:id="rL">{run("here")}</w:hyperlink><w:hyperlink r:id="rJ">{run("!")}</w:hyperlink>'), "<w:p/>",
    ]
    level = lambda k, f, s=1: f'<w:lvl w:ilvl="{k}"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/></w:lvl>'
    content = packed({
        "word/document.xml": f'<w:document {W} {REL}><w:body>{"".join(body)}</w:body></w:document>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{level(0, "decimal", 3)}{level(1, "bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{level(0, "bullet")}</w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1x"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rL" Target="https://x.example/"/><Relationship Id="rJ" Target="javascript:alert(1)"/></Relationships>',
    })
    got = packages.word_paragraphs(read(spark, [("d", content), ("empty", packed({"a.xml": "<a/>"}))])).orderBy("place").collect()
    assert [(r["text"], r["heading"], r["in_list"], r["ordered"], r["level"], r["start"], r["links"]) for r in got] == [
        ("Top", 2, False, False, None, None, []), ("a & b\tc", None, False, False, None, None, []), ("first", None, True, True, 0, 3, []), ("dot", None, True, False, 1, 1, []),
        ("other", None, True, False, 0, 1, []), ("lost", None, True, False, 0, 1, []), ("see here!", None, False, False, None, None, ["https://x.example/"]), ("", None, False, False, None, None, []),
    ]


def test_books_by_joins(spark):
    content = packed({
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="text/b%20c.xhtml#x" media-type="application/xhtml+xml"/><item id="a" href="../a.xhtml"/><item id="gone" href="gone.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="nope"/><itemref idref="gone"/><itemref idref="a"/></spine></package>',
        "OPS/text/b c.xhtml": "<p>B</p>", "a.xhtml": "<p>A</p>",
    })
    got = packages.book_chapters(read(spark, [("b", content)])).orderBy("place").collect()
    assert [(r["place"], r["part"], r["xml"]) for r in got] == [(0, "OPS/text/b c.xhtml", "<p>B</p>"), (1, "a.xhtml", "<p>A</p>")]
