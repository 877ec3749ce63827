"""Writers of packages: DOCX, XLSX, EPUB and ZIP, one document at a time, as a binary column.

A package is a ZIP of a few XML parts, so one document's blocks or tables are enough to write it; documents
are grouped by their key and written in parallel. Every package is reopened and its parts are checked.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import CONFIDENCE

PACKAGES = "doc_id string, name string, content binary, error string"
#: The most tables of a workbook, the bounds of a column's width, the pages of a chapter at the most.
MOST_TABLES, WIDTHS, MOST_PAGES = 100, (10, 60), 25
#: The name spaces and media types of the formats.
OFFICE, PACKAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
WORD, SHEET = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD_TYPE, SHEET_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml", "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def xml_text(value: str | None) -> str:
    """Escaped text, without characters that XML cannot hold."""
    kept = "".join(c for c in value or "" if c >= " " or c in "\t\n\r")
    return escape(kept, {'"': "&quot;", "'": "&apos;"})


def column_name(index: int) -> str:
    """The letters of a 0-based column: A, ..., Z, AA, ..."""
    name = ""
    while index >= 0:
        index, letter = index // 26 - 1, index % 26
        name = chr(65 + letter) + name
    return name


def unique_names(names: Iterable[str], most: int = 31) -> list[str]:
    """Names of at most ``most`` characters; a repeated one gets 2, 3, ..."""
    out: list[str] = []
    for name in names:
        base, k = name[:most], 2
        pick = base
        while pick in out:
            pick, k = f"{base[: most - 4]} {k}", k + 1
        out.append(pick)
    return out


def zipped(parts: dict[str, str | bytes], required: Iterable[str] = (), stored: Iterable[str] = ()) -> bytes:
    """A ZIP of the parts, reopened to see that the required ones are in it."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    missing = set(required) - set(zipfile.ZipFile(io.BytesIO(buffer.getvalue())).namelist())
    if missing:
        raise ValueError(f"OUTPUT_INVALID: the package lacks {min(missing)}")
    return buffer.getvalue()


def _types(parts: dict[str, str]) -> str:
    over = "".join(f'<Override PartName="/{name}" ContentType="{kind}+xml"/>' for name, kind in parts.items())
    return f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{over}</Types>'


def _relations(targets: dict[str, tuple[str, str]]) -> str:
    each = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in targets.items())
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{each}</Relationships>'


def docx(blocks: list[dict], page_breaks: bool = True) -> bytes:
    """A word-processing package of blocks (page_number, kind, level, ordered, text, items, rows) in order."""
    run = lambda t: f'<w:r><w:t xml:space="preserve">{xml_text(t)}</w:t></w:r>'
    paragraph = lambda t, style="": f"<w:p>{f'<w:pPr>{style}</w:pPr>' if style else ''}{run(t)}</w:p>"
    listed = lambda t, ordered: paragraph(t, f'<w:pStyle w:val="ListParagraph"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{2 if ordered else 1}"/></w:numPr>')
    body, page = [], None
    for b in blocks:
        if page_breaks and page is not None and b["page_number"] != page:
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        page = b["page_number"]
        if b["kind"] == "heading":
            body.append(paragraph(b["text"], f'<w:pStyle w:val="Heading{min(6, b["level"] or 1)}"/>'))
        elif b["kind"] == "list":
            body += [listed(t, b["ordered"]) for t in b["items"]]
        elif b["kind"] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in b["rows"])
            body.append(f"<w:tbl><w:tblPr/><w:tblGrid/>{rows}</w:tbl>")
        elif b["text"]:
            body.append(paragraph(b["text"]))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/><w:rPr><w:b/><w:sz w:val="{40 - 4 * n}"/></w:rPr></w:style>' for n in range(1, 7))
    levels = "".join(f'<w:abstractNum w:abstractNumId="{n}"><w:lvl w:ilvl="0"><w:numFmt w:val="{kind}"/><w:lvlText w:val="{mark}"/></w:lvl></w:abstractNum>' for n, kind, mark in ((1, "bullet", "•"), (2, "decimal", "%1.")))
    numbers = "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n in (1, 2))
    main = {"word/document.xml": f"{WORD_TYPE}.document.main", "word/styles.xml": f"{WORD_TYPE}.styles", "word/numbering.xml": f"{WORD_TYPE}.numbering"}
    parts = {
        "[Content_Types].xml": _types(main), "_rels/.rels": _relations({"r1": ("officeDocument", "word/document.xml")}),
        "word/_rels/document.xml.rels": _relations({"r1": ("styles", "styles.xml"), "r2": ("numbering", "numbering.xml")}),
        "word/document.xml": f'{HEAD}<w:document xmlns:w="{WORD}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
        "word/styles.xml": f'{HEAD}<w:styles xmlns:w="{WORD}">{styles}<w:style w:type="paragraph" w:styleId="ListParagraph"><w:name w:val="List Paragraph"/></w:style></w:styles>',
        "word/numbering.xml": f'{HEAD}<w:numbering xmlns:w="{WORD}">{levels}{numbers}</w:numbering>',
    }
    return zipped(parts, ["[Content_Types].xml", *main])


def column_widths(rows: list[list[str]]) -> list[int]:
    """The width of each column: its longest cell and two, within WIDTHS."""
    return [min(WIDTHS[1], max(WIDTHS[0], *[len(r[k]) + 2 for r in rows if k < len(r)])) for k in range(max(map(len, rows), default=0))]


def xlsx(tables: list[dict]) -> bytes:
    """A workbook of tables (page_number, rows), a sheet each, the first row bold."""
    if not tables:
        raise ValueError("INVALID_INPUT: no table is sure enough to be exported")
    if len(tables) > MOST_TABLES:
        raise ValueError(f"MEMORY_LIMIT: more than {MOST_TABLES} tables")
    names = unique_names(f"Page {t['page_number']} Table" for t in tables)
    cell = lambda r, c, t: f'<c r="{column_name(c)}{r}" t="inlineStr"{" s=\"1\"" if r == 1 else ""}><is><t xml:space="preserve">{xml_text(t)}</t></is></c>'

    def sheet(rows: list[list[str]]) -> str:
        columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(column_widths(rows), 1))
        lines = "".join(f'<row r="{n}">{"".join(cell(n, k, t) for k, t in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
        return f'{HEAD}<worksheet xmlns="{SHEET}"><cols>{columns}</cols><sheetData>{lines}</sheetData></worksheet>'

    sheets = {f"xl/worksheets/sheet{k}.xml": sheet(t["rows"]) for k, t in enumerate(tables, 1)}
    listed = "".join(f'<sheet name="{xml_text(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
    kinds = {"xl/workbook.xml": f"{SHEET_TYPE}.sheet.main", "xl/styles.xml": f"{SHEET_TYPE}.styles"} | {n: f"{SHEET_TYPE}.worksheet" for n in sheets}
    targets = {f"r{k}": ("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(tables) + 1)} | {"styles": ("styles", "styles.xml")}
    fonts = '<fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    parts = {
        "[Content_Types].xml": _types(kinds), "_rels/.rels": _relations({"r1": ("officeDocument", "xl/workbook.xml")}), "xl/_rels/workbook.xml.rels": _relations(targets),
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/styles.xml": f'{HEAD}<styleSheet xmlns="{SHEET}">{fonts}<cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    return zipped(parts | sheets, ["[Content_Types].xml", *kinds])


def epub(blocks: list[dict], title: str = "document", pages_a_chapter: int = 5) -> bytes:
    """A book of blocks; a chapter holds ``pages_a_chapter`` pages (1 to MOST_PAGES)."""
    span = min(MOST_PAGES, max(1, pages_a_chapter or 5))
    pages = sorted({b["page_number"] for b in blocks})
    chapters = [pages[k : k + span] for k in range(0, len(pages), span)] or [[]]
    tag = lambda name, inner: f"<{name}>{inner}</{name}>"

    def element(b: dict) -> str:
        if b["kind"] == "heading":
            return tag(f"h{min(6, (b['level'] or 1) + 1)}", xml_text(b["text"]))
        if b["kind"] == "list":
            return tag("ol" if b["ordered"] else "ul", "".join(tag("li", xml_text(t)) for t in b["items"]))
        if b["kind"] == "table":
            return tag("table", "".join(tag("tr", "".join(tag("td" if n else "th", xml_text(c)) for c in r)) for n, r in enumerate(b["rows"])))
        return tag("p", xml_text(b["text"]))

    def page(name: str, inner: str) -> str:
        return f'{HEAD}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{xml_text(name)}</title></head><body>{inner}</body></html>'

    names = [f"EPUB/chapter-{k}.xhtml" for k in range(1, len(chapters) + 1)]
    texts = {n: page(f"{title} {k}", "".join(element(b) for b in blocks if b["page_number"] in c)) for k, (n, c) in enumerate(zip(names, chapters, strict=True), 1)}
    links = "".join(f'<li><a href="chapter-{k}.xhtml">Pages {c[0]}-{c[-1]}</a></li>' for k, c in enumerate(chapters, 1) if c)
    items = "".join(f'<item id="c{k}" href="chapter-{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(1, len(chapters) + 1))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(chapters) + 1))
    about = f'<dc:identifier id="id">urn:{xml_text(title)}</dc:identifier><dc:title>{xml_text(title)}</dc:title><dc:language>en</dc:language>'
    parts = {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": f'{HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>',
        "EPUB/content.opf": f'{HEAD}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{about}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>',
        "EPUB/nav.xhtml": page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>'),
    }
    return zipped(parts | texts, [*parts, *names], ["mimetype"])


def _plain(value: object) -> object:
    """Lists all the way down for the arrays that a group brings."""
    return [_plain(x) for x in value] if hasattr(value, "__len__") and not isinstance(value, str | bytes | dict) else value


def _packages(rows: DataFrame, order: list[str], write: Callable[[list[dict]], bytes], extension: str) -> DataFrame:
    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        entries = [{k: _plain(v) for k, v in r.items()} for r in group.sort_values(order).to_dict("records")]
        try:
            content, error = write(entries), None
        except Exception as e:  # what one document does to its writer concerns that document only
            content, error = None, f"{type(e).__name__}: {e}"
        named = None if pd.isna(key[0]) else str(key[0])
        return pd.DataFrame({"doc_id": pd.Series([named], dtype=object), "name": [f"{named or 'document'}.{extension}"], "content": [content], "error": pd.Series([error], dtype=object)})

    return rows.groupBy("doc_id").applyInPandas(one, PACKAGES)


def _with_rows(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks with the rows of their tables."""
    rows = tables.select("doc_id", "page_number", "table_id", "rows")
    b = blocks.drop("rows").join(rows, ["doc_id", "page_number", "table_id"], "left")
    level, ordered = F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered")
    return b.select("doc_id", "page_number", "block", "kind", level, ordered, F.coalesce("text", F.lit("")).alias("text"), "items", "rows")


def docx_packages(blocks: DataFrame, tables: DataFrame, page_breaks: bool = True) -> DataFrame:
    """doc_id, name, content, error: a DOCX of every analysed document."""
    return _packages(_with_rows(blocks, tables), ["page_number", "block"], lambda b: docx(b, page_breaks), "docx")


def epub_packages(blocks: DataFrame, tables: DataFrame, pages_a_chapter: int = 5) -> DataFrame:
    """doc_id, name, content, error: an EPUB of every analysed document."""
    return _packages(_with_rows(blocks, tables), ["page_number", "block"], lambda b: epub(b, "document", pages_a_chapter), "epub")


def xlsx_packages(tables: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """doc_id, name, content, error: a workbook of the sure tables of each document, or of those with the selected ids.

    The confidence is the standard one whatever the analysis was told."""
    sure = tables.where(F.col("confidence") >= CONFIDENCE)
    sure = sure if selected is None else sure.where(F.col("table_id").isin(selected))
    return _packages(sure.select("doc_id", "page_number", "number", "rows"), ["page_number", "number"], xlsx, "xlsx")


def zip_packages(files: DataFrame) -> DataFrame:
    """doc_id, name, content, error: the files (doc_id, name, content) of each key as one ZIP; repeated names get a number."""

    def write(entries: list[dict]) -> bytes:
        names = unique_names((e["name"] for e in entries), 180)
        return zipped({n: bytes(e["content"]) for n, e in zip(names, entries, strict=True)}, names)

    return _packages(files.select("doc_id", "name", "content"), ["name"], write, "zip")


def count_entries(content: bytes) -> int:
    """How many entries a ZIP has."""
    return len(zipfile.ZipFile(io.BytesIO(content)).namelist())
