"""Office packages as tables of their parts, put together by joins.

Only unzipping runs in Python. What a part holds becomes rows by expressions, and what names something in
another part (a sheet its relationship, a cell its shared string and its style, a paragraph its list, style and links, a spine
its items) is a join on the package and the name, so that large packages and many of them spread over tasks. Both sides
of those joins grow with the packages: Spark broadcasts one only if its size is known to be small.

Columns: ``doc_id`` is the caller's; ``package`` numbers the files, so that files with one name or without stay apart.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import written
from ..functions.scalars import column_index, excel_date, safe_href
from .parsers import MAX_COLUMNS, NUMBER_FORMATS

READ = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
#: What parts are joined by, and what the rows of a result begin with.
KEY, OF = ["package"], ["doc_id", "package"]
RICH = "struct<t:string,r:array<struct<t:string>>>"
WORKBOOK = "struct<sheets:struct<sheet:array<struct<_name:string,_id:string>>>>"
RELATIONS = "struct<Relationship:array<struct<_Id:string,_Target:string,_Type:string>>>"
STRINGS = f"struct<si:array<{RICH}>>"
STYLES = "struct<numFmts:struct<numFmt:array<struct<_numFmtId:string,_formatCode:string>>>,cellXfs:struct<xf:array<struct<_numFmtId:string>>>>"
SHEET = f"struct<sheetData:struct<row:array<struct<_r:string,c:array<struct<_r:string,_t:string,_s:string,v:string,f:string,`is`:{RICH}>>>>>>"
VALUE = "struct<_val:string>"
NUMBERING = f"struct<abstractNum:array<struct<_abstractNumId:string,lvl:array<struct<_ilvl:string,numFmt:{VALUE},start:{VALUE}>>>>,num:array<struct<_numId:string,abstractNumId:{VALUE}>>>"
WORD_STYLES = f"struct<style:array<struct<_styleId:string,name:{VALUE}>>>"
CONTAINER = "struct<rootfiles:struct<rootfile:array<struct<`_full-path`:string>>>>"
BOOK = "struct<manifest:struct<item:array<struct<_id:string,_href:string,`_media-type`:string>>>,spine:struct<itemref:array<struct<_idref:string>>>>"


def package_parts(files: DataFrame, suffixes: tuple[str, ...] = (".xml", ".rels", ".xhtml", ".html", ".opf")) -> DataFrame:
    """doc_id, package, part, xml, error of the packages (doc_id, content), as a written table.

    A content that is no ZIP gives one row with an ``error``, a null one none."""
    numbered = files.where("content is not null").select("doc_id", F.monotonically_increasing_id().alias("package"), "content")
    kind = files.schema["doc_id"].dataType.simpleString()

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "package", "part", "xml", "error"]
        for b in batches:
            for k in range(b.num_rows):
                found, error = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(b.column(2)[k].as_py())) as z:
                        found = [(n, z.read(n).decode("utf-8-sig", "replace")) for n in z.namelist() if n.lower().endswith(suffixes)]
                except Exception as e:  # what one file does to its reader concerns that file only
                    error = f"{type(e).__name__}: {e}"
                rows = found or [(None, None)]
                key = [pa.concat_arrays([b.column(c).slice(k, 1)] * len(rows)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*key, *(pa.array([r[c] for r in rows], pa.string()) for c in (0, 1)), pa.array([error] * len(rows), pa.string())], names)

    return written(numbered.mapInArrow(unzip, f"doc_id {kind}, package long, part string, xml string, error string"), "parts")


def _part(parts: DataFrame, name: str, schema: str) -> DataFrame:
    return parts.where(F.col("part") == name).select(*OF, F.from_xml("xml", schema, READ).alias("x"))


def _rich(t: Column) -> Column:
    """The text of a string that may be in runs."""
    runs = F.array_join(F.transform(t["r"], lambda r: F.coalesce(r["t"], F.lit(""))), "")
    return F.coalesce(F.concat(F.coalesce(t["t"], F.lit("")), F.coalesce(runs, F.lit(""))), F.lit(""))


def resolved(base: Column, target: Column) -> Column:
    """A part's name from a target that stands in a part of the folder ``base`` ("" or ending in /)."""
    path = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat(base, target))
    step = lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def relations(parts: DataFrame, name: str) -> DataFrame:
    """package, id, target of a relationship part."""
    r = _part(parts, name, RELATIONS).select(*KEY, F.explode("x.Relationship").alias("r"))
    return r.select(*KEY, F.col("r._Id").alias("id"), F.col("r._Target").alias("target"))


def sheets(parts: DataFrame) -> DataFrame:
    """doc_id, package, sheet_no (from 1), sheet, part: the sheets of the workbooks in order, by their relationships."""
    s = _part(parts, "xl/workbook.xml", WORKBOOK).select(*OF, F.posexplode("x.sheets.sheet").alias("at", "s"))
    s = s.select(*OF, (F.col("at") + 1).alias("sheet_no"), F.col("s._name").alias("_name"), F.col("s._id").alias("id"))
    s = s.join(relations(parts, "xl/_rels/workbook.xml.rels"), [*KEY, "id"], "left")
    number = F.col("sheet_no").cast("string")
    target = F.coalesce(F.nullif("target", F.lit("")), F.concat(F.lit("worksheets/sheet"), number, F.lit(".xml")))
    base = F.when(target.startswith("xl/"), "").otherwise("xl/")
    name = F.coalesce(F.nullif("_name", F.lit("")), F.concat(F.lit("Sheet "), number))
    return s.select(*OF, "sheet_no", name.alias("sheet"), resolved(base, target).alias("part"))


def shared_strings(parts: DataFrame) -> DataFrame:
    """package, at (from 0), shared."""
    return _part(parts, "xl/sharedStrings.xml", STRINGS).select(*KEY, F.posexplode("x.si").alias("at", "s")).select(*KEY, "at", _rich(F.col("s")).alias("shared"))


def cell_formats(parts: DataFrame) -> DataFrame:
    """package, style (from 0), code: the number format of each cell style, own ones by a join, the others fixed."""
    x = _part(parts, "xl/styles.xml", STYLES)
    xfs = x.select(*KEY, F.posexplode("x.cellXfs.xf").alias("style", "f")).select(*KEY, "style", F.coalesce(F.col("f._numFmtId").try_cast("int"), F.lit(0)).alias("format"))
    own = x.select(*KEY, F.explode("x.numFmts.numFmt").alias("f")).select(*KEY, F.col("f._numFmtId").try_cast("int").alias("format"), F.nullif(F.col("f._formatCode"), F.lit("")).alias("own"))
    own = own.where("format is not null").groupBy(*KEY, "format").agg(F.max("own").alias("own"))
    known = F.create_map(*[F.lit(x) for kv in NUMBER_FORMATS.items() for x in kv])
    return xfs.join(own, [*KEY, "format"], "left").select(*KEY, "style", F.coalesce("own", F.try_element_at(known, F.col("format"))).alias("code"))


def number_shown(raw: Column, code: Column) -> Column:
    """A number as its format shows it: percent, day (and time), thousands; else as it stands."""
    value = raw.try_cast("double")
    two = code.contains(".00")
    plain = F.regexp_replace(code, r"\[[^\]]*\]", "")
    at = excel_date(F.round(value * 86_400_000) / 86_400_000)
    day = F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(at, "UTC"), "UTC"), "yyyy-MM-dd")
    percent = F.when(two, F.format_string("%.2f%%", value * 100)).otherwise(F.format_string("%.0f%%", value * 100))
    thousands = F.when(two, F.format_number(value, 2)).otherwise(F.format_number(value, 0))
    shown = (
        F.when(code.contains("%"), percent)
        .when(plain.rlike("(?i)[his]") & (F.abs(value) < 2_900_000), F.concat(day, F.date_format(at, " HH:mm:ss"))).when(plain.rlike("(?i)[ymd]") & (F.abs(value) < 2_900_000), day)
        .when(plain.rlike("(?i)[ymdhis]"), raw).when(code.contains("#,##0"), thousands).otherwise(raw)
    )
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | code.isNull() | (code == ""), raw).otherwise(shown)


def workbook_cells(parts: DataFrame) -> DataFrame:
    """doc_id, package, sheet_no, sheet, row, column (both from 0), text of every cell.

    Sheets meet their parts, cells their shared strings and the formats of their styles; a cell without a reference
    stands in its place within the row."""
    s = sheets(parts).join(parts.select(*KEY, "part", "xml"), [*KEY, "part"])
    rows = s.select(*OF, "sheet_no", "sheet", F.posexplode(F.from_xml("xml", SHEET, READ)["sheetData"]["row"]).alias("row", "r"))
    c = rows.select(*OF, "sheet_no", "sheet", "row", F.posexplode("r.c").alias("place", "c"))
    raw = F.coalesce(F.col("c.v"), F.lit(""))
    c = c.select(
        *OF, "sheet_no", "sheet", "row", F.coalesce(F.nullif(column_index(F.col("c._r")), F.lit(-1)), F.col("place")).alias("column"), F.coalesce("c._t", F.lit("n")).alias("kind"), raw.alias("raw"),
        F.col("c.f").alias("formula"), _rich(F.col("c.is")).alias("inline"), F.when(F.col("c._t") == "s", F.col("c.v").try_cast("int")).alias("at"), F.coalesce(F.col("c._s").try_cast("int"), F.lit(0)).alias("style"),
    )
    c = c.join(shared_strings(parts), [*KEY, "at"], "left").join(cell_formats(parts), [*KEY, "style"], "left")
    kind = F.col("kind")
    text = (
        F.when(kind == "s", F.coalesce("shared", F.lit(""))).when(kind == "inlineStr", F.col("inline")).when(kind == "b", F.when(F.col("raw") == "1", "TRUE").otherwise("FALSE"))
        .when(kind == "e", F.coalesce(F.nullif("raw", F.lit("")), F.lit("#ERROR"))).when((F.col("raw") == "") & F.col("formula").isNotNull(), F.concat(F.lit("="), "formula"))
        .when(kind == "str", F.col("raw")).otherwise(number_shown(F.col("raw"), F.col("code")))
    )
    return c.select(*OF, "sheet_no", "sheet", "row", "column", text.alias("text"))


def workbook_rows(cells: DataFrame, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """doc_id, package, sheet_no, sheet, row, cells: missing cells between others are empty; later ones of one place count."""
    kept = cells.where((F.col("column") >= 0) & (F.col("column") < max_columns)).groupBy(*OF, "sheet_no", "sheet", "row", "column").agg(F.max("text").alias("text"))
    g = kept.groupBy(*OF, "sheet_no", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("m"), F.max("column").alias("last"))
    cell = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))
    return g.select(*OF, "sheet_no", "sheet", "row", F.transform(F.sequence(F.lit(0), F.col("last")), cell).alias("cells"))


def list_formats(parts: DataFrame) -> DataFrame:
    """package, num_id, level, format, start: a list's number names a definition, and that the format of each level."""
    x = _part(parts, "word/numbering.xml", NUMBERING)
    num = x.select(*KEY, F.explode("x.num").alias("n")).select(*KEY, F.col("n._numId").alias("num_id"), F.col("n.abstractNumId._val").alias("definition"))
    levels = x.select(*KEY, F.explode("x.abstractNum").alias("a")).select(*KEY, F.col("a._abstractNumId").alias("definition"), F.explode("a.lvl").alias("l"))
    levels = levels.select(*KEY, "definition", F.coalesce(F.col("l._ilvl").try_cast("int"), F.lit(0)).alias("level"), F.col("l.numFmt._val").alias("format"), F.coalesce(F.col("l.start._val").try_cast("int"), F.lit(1)).alias("start"))
    return num.join(levels, [*KEY, "definition"]).select(*KEY, "num_id", "level", "format", "start")


def style_names(parts: DataFrame) -> DataFrame:
    """package, style_id, style."""
    s = _part(parts, "word/styles.xml", WORD_STYLES).select(*KEY, F.explode("x.style").alias("s"))
    return s.select(*KEY, F.col("s._styleId").alias("style_id"), F.col("s.name._val").alias("style"))


def _unescaped(text: Column) -> Column:
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def word_paragraphs(parts: DataFrame) -> DataFrame:
    """doc_id, package, place (from 0), text, style, heading (level or null), in_list, ordered, level, start, links of every paragraph
    of the word-processing packages, those of table cells among them.

    Paragraphs meet their list's format, their style's name and the targets of their links by joins."""
    body = parts.where("part = 'word/document.xml'").select(*OF, F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<w:p(?:\s[^>]*)?(?:/>|>.*?</w:p>)"), F.lit(0))).alias("place", "p"))
    value = lambda name: F.nullif(F.regexp_extract("p", rf'<w:{name}\s[^>]*?w:val="([^"]*)"', 1), F.lit(""))
    said = F.regexp_extract_all("p", F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>|(<w:tab/>)|(<w:br/>)"), F.lit(0))
    piece = lambda m: F.when(m == "<w:tab/>", "\t").when(m == "<w:br/>", "\n").otherwise(F.regexp_replace(m, r"(?s)^<[^>]*>|</w:t>$", ""))
    p = body.select(
        *OF, "place", _unescaped(F.array_join(F.transform(said, piece), "")).alias("text"), value("pStyle").alias("style_id"), F.col("p").rlike("<w:numPr[ />]").alias("in_list"), value("numId").alias("num_id"),
        F.coalesce(value("ilvl").try_cast("int"), F.lit(0)).alias("level"), F.regexp_extract_all("p", F.lit(r'<w:hyperlink\s[^>]*?r:id="([^"]*)"'), F.lit(1)).alias("ids"),
    )
    p = p.join(list_formats(parts), [*KEY, "num_id", "level"], "left").join(style_names(parts), [*KEY, "style_id"], "left")
    links = p.where(F.size("ids") > 0).select(*KEY, "place", F.posexplode("ids").alias("n", "id")).join(relations(parts, "word/_rels/document.xml.rels"), [*KEY, "id"])
    links = links.groupBy(*KEY, "place").agg(F.sort_array(F.collect_list(F.struct("n", safe_href(F.col("target")).alias("href")))).alias("links"))
    p = p.join(links, [*KEY, "place"], "left")
    heading = r"(?i)^(?:heading\s*([1-6])|title)$"
    level = lambda s: F.when(s.rlike(heading), F.coalesce(F.regexp_extract(s, heading, 1).try_cast("int"), F.lit(1)))
    return p.select(
        *OF, "place", "text", F.coalesce("style", "style_id").alias("style"), F.coalesce(level(F.col("style_id")), level(F.col("style"))).alias("heading"), "in_list",
        F.coalesce(~F.col("format").isin("bullet", "none"), F.lit(False)).alias("ordered"), F.when(F.col("in_list"), F.col("level")).alias("level"), F.when(F.col("in_list"), F.coalesce("start", F.lit(1))).alias("start"),
        F.coalesce(F.array_compact(F.transform("links", lambda x: x["href"])), F.array().cast("array<string>")).alias("links"),
    )


def book_chapters(parts: DataFrame) -> DataFrame:
    """doc_id, package, place (from 0), part, media_type, xml: the chapters of the books in the order of their spines.

    The container names the book's part, the spine items of its manifest, those entries of the package; what is missing
    anywhere is passed over."""
    roots = _part(parts, "META-INF/container.xml", CONTAINER).select(*OF, F.col("x.rootfiles.rootfile")[0]["_full-path"].alias("part"))
    books = roots.join(parts.select(*KEY, "part", "xml"), [*KEY, "part"]).select(*OF, F.regexp_extract("part", "^(.*/)?[^/]*$", 1).alias("base"), F.from_xml("xml", BOOK, READ).alias("x"))
    spine = books.select(*OF, "base", F.posexplode("x.spine.itemref").alias("place", "i")).select(*OF, "base", "place", F.col("i._idref").alias("id"))
    items = books.select(*KEY, F.explode("x.manifest.item").alias("i")).select(*KEY, F.col("i._id").alias("id"), F.url_decode(F.split_part("i._href", F.lit("#"), F.lit(1))).alias("href"), F.col("i._media-type").alias("media_type"))
    chapters = spine.join(items, [*KEY, "id"]).withColumn("part", resolved(F.col("base"), F.col("href"))).join(parts.select(*KEY, "part", "xml"), [*KEY, "part"])
    order = Window.partitionBy(*KEY).orderBy("place")
    return chapters.select(*OF, (F.row_number().over(order) - 1).alias("place"), "part", "media_type", "xml")
