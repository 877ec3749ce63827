"""Queries over delimited texts, Markdown and office packages that Spark makes of the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import delimited, markdown, packages, writers
from ..sources.tables import read_table as table


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text read as comma-separated rows, quotes put after its commas and sentences."""
    source = F.replace(F.replace("text", F.lit(", "), F.lit(',"')), F.lit(". "), F.lit('",'))
    rows = delimited.csv_rows(table(spark, sf_dir, "documents").select("doc_id", source.alias("source")), ",")
    return rows.select("doc_id", "row", F.size("cells").alias("n_cells"), F.sha2(F.array_join("cells", "\x1f"), 256).alias("sha256"))


def _zipped(parts: DataFrame) -> DataFrame:
    """Parts (doc_id, name, xml) packed and taken apart again."""
    return packages.package_parts(writers.zip_packages(parts.select("doc_id", "name", F.col("xml").cast("binary").alias("content"))))


def package_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, a hundred to a workbook, whose cells name shared strings and styles, read back by joins."""
    by = F.expr("c_custkey div 100").alias("doc_id")
    c = table(spark, sf_dir, "customer").select(by, "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    names = c.groupBy("doc_id").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("names"))
    cell = lambda column, attributes, inner: F.concat(F.lit(f'<c r="{column}1"{attributes}>'), inner, F.lit("</c>"))
    value = lambda v: F.concat(F.lit("<v>"), v.cast("string"), F.lit("</v>"))
    cells = F.concat(
        cell("A", ' t="s"', value(F.array_position("names", F.col("c_mktsegment")) - 1)), cell("B", ' t="inlineStr"', F.concat(F.lit("<is><t>"), S.escape_xml(F.col("c_name")), F.lit("</t></is>"))),
        cell("C", ' s="1"', value(F.col("c_acctbal"))), cell("E", ' s="2"', value(F.col("c_custkey"))), cell("F", ' s="3"', value(F.col("c_custkey") / 100)), cell("G", ' t="b"', value(F.col("c_nationkey") % 2)),
    )
    rows = c.join(names, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.concat(F.lit("<row>"), cells, F.lit("</row>")).alias("x")))).alias("l"))
    main, each = f'xmlns="{writers.SHEET}"', F.array_join(F.transform("l", lambda x: x["x"]), "")
    strings = F.array_join(F.transform("names", lambda n: F.concat(F.lit("<si><t>"), S.escape_xml(n), F.lit("</t></si>"))), "")
    fixed = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{writers.OFFICE}"><sheets><sheet name="Customers" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="sheet" Target="worksheets/customers.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="#,##0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>',
    }
    kinds = [F.struct(F.lit(n).alias("name"), F.lit(x).alias("xml")) for n, x in fixed.items()]
    kinds.append(F.struct(F.lit("xl/sharedStrings.xml").alias("name"), F.concat(F.lit(f"<sst {main}>"), strings, F.lit("</sst>")).alias("xml")))
    kinds.append(F.struct(F.lit("xl/worksheets/customers.xml").alias("name"), F.concat(F.lit(f"<worksheet {main}><sheetData>"), each, F.lit("</sheetData></worksheet>")).alias("xml")))
    parts = rows.join(names, "doc_id").select("doc_id", F.explode(F.array(*kinds)).alias("p")).select("doc_id", "p.*")
    back = packages.workbook_rows(packages.workbook_cells(_zipped(parts)))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "sheet", "row", F.array_join("cells", "|").alias("cells"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as word-processing packages, a paragraph a turn, each role a list of its own format, read back by joins."""
    main = f'xmlns:w="{writers.WORD}"'
    role = F.col("role")
    number = F.when(role == "user", 7).when(role == "assistant", 8).otherwise(9).cast("string")
    props = F.concat(F.lit('<w:pPr><w:pStyle w:val="S'), number, F.lit('"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="'), number, F.lit('"/></w:numPr></w:pPr>'))
    said = F.concat(F.lit('<w:p>'), props, F.lit('<w:r><w:t xml:space="preserve">'), S.escape_xml(F.coalesce("text", F.lit(""))), F.lit("</w:t></w:r></w:p>"))
    body = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("x")))).alias("l"))
    level = lambda k, f, s: f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:start w:val="{s}"/><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>'
    fixed = {
        "word/numbering.xml": f'<w:numbering {main}>{level(1, "decimal", 3)}{level(2, "bullet", 1)}<w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="8"><w:abstractNumId w:val="2"/></w:num></w:numbering>',
        "word/styles.xml": f'<w:styles {main}><w:style w:styleId="S7"><w:name w:val="asked"/></w:style><w:style w:styleId="S8"><w:name w:val="heading 3"/></w:style></w:styles>',
    }
    kinds = [F.struct(F.lit(n).alias("name"), F.lit(x).alias("xml")) for n, x in fixed.items()]
    document = F.concat(F.lit(f"<w:document {main}><w:body>"), F.array_join(F.transform("l", lambda x: x["x"]), ""), F.lit("</w:body></w:document>"))
    parts = body.select("doc_id", F.explode(F.array(*kinds, F.struct(F.lit("word/document.xml").alias("name"), document.alias("xml")))).alias("p")).select("doc_id", "p.*")
    p = packages.word_paragraphs(_zipped(parts))
    return p.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place"), "style", "heading", "ordered", "start", F.sha2("text", 256).alias("sha256"))


#: What is put before the lines of a text to make Markdown of it, by length and place.
PREFIXES = ("", "- ", "  - ", "> ", "    ", "1. ", "```\n", "---\n", "## ", "", "===\n", "a|b\n-|-\n", "\n")


def markdown_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document as Markdown: its lines, one a sentence, behind prefixes by their lengths and places."""
    whole = F.replace(F.regexp_replace("text", "\r\n?", "\n"), F.lit(". "), F.lit(".\n"))
    each = F.transform(F.split(whole, "\n"), lambda x, i: F.concat(F.get(F.array(*[F.lit(p) for p in PREFIXES]), (F.length(x) * 7 + i * 3) % len(PREFIXES)), x))
    b = markdown.markdown_blocks(table(spark, sf_dir, "documents").select("doc_id", F.array_join(each, "\n").alias("source")))
    items = F.array_join(F.transform("items", lambda x: F.concat(x["depth"].cast("string"), F.when(x["ordered"], "o").otherwise("u"), x["text"])), "\n")
    n = F.coalesce(F.when(F.col("kind") == "list", F.size("items")).when(F.col("kind") == "table", F.size("rows")), F.lit(0))
    return b.select("doc_id", "block", "kind", "level", n.alias("n"), F.sha2(F.coalesce("text", items, F.lit("")), 256).alias("sha256"))


ORACLES = {
    "markdown_structure": r"""
WITH RECURSIVE src AS (
  SELECT doc_id, string_split(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '. ', '.' || chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
made AS (
  SELECT doc_id, string_split(array_to_string(list_transform(range(1, len(l) + 1), lambda i:
    ['', '- ', '  - ', '> ', '    ', '1. ', '```' || chr(10), '---' || chr(10), '## ', '', '===' || chr(10), 'a|b' || chr(10) || '-|-' || chr(10), chr(10)][(length(l[i]) * 7 + (i - 1) * 3) % 13 + 1] || l[i]), chr(10)), chr(10)) AS a FROM src),
lines AS (SELECT doc_id, i, replace(a[i], chr(9), '    ') AS t, coalesce(regexp_matches(a[i + 1], '^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$'), false) AS ruled FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM made)),
flags AS (
  SELECT doc_id, i, t, trim(t) = '' AS blank, regexp_extract(t, '^ {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$', 1) AS fence, regexp_extract(t, '^ {0,3}(`{3,}|~{3,})[ \t]*$', 1) AS closing,
         regexp_matches(t, '^ {0,3}(#{1,6})([ \t]+(.*?))?([ \t]+#+)?[ \t]*$') AS heading, regexp_matches(t, '^ {0,3}(=+|-+)[ \t]*$') AS underline,
         regexp_matches(t, '^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$') AS rule, regexp_matches(t, '^( *)([-*+]|([0-9]{1,9})[.)])([ \t]+(.*))?$') AS item,
         regexp_extract(t, '^( *)([-*+]|([0-9]{1,9})[.)])([ \t]+(.*))?$', 3) <> '' AS ordered, length(regexp_extract(t, '^( *)', 1))::INT AS indent, regexp_matches(t, '^ {0,3}>[ \t]?(.*)$') AS quote,
         contains(t, '|') AND ruled AS head, regexp_matches(t, '(?i)^\s*<!--\s*pagebreak\s*-->\s*$') AS pb, regexp_matches(t, '^ {0,3}<[A-Za-z/!?]') AS html FROM lines),
run AS (
  SELECT doc_id, 0::BIGINT AS i, '' AS open, '' AS f, []::INT[] AS indents, false AS ord, '' AS mark, 0 AS depth FROM made
  UNION ALL
  SELECT doc_id, i,
         CASE WHEN m IN ('P', 'p') THEN 'P' WHEN m IN ('O', 'q', 'Q') THEN 'q' WHEN m IN ('N', 'L', 'l') THEN 'L' WHEN m = 'T' THEN 'T' WHEN m IN ('d', 't') THEN 't' WHEN m IN ('C', 'c') THEN 'C' WHEN m IN ('X', 'x') THEN 'X'
              WHEN m = 'b' AND listed THEN 'M' WHEN m = 'b' AND o = 'C' THEN 'C' ELSE '' END,
         CASE WHEN m = 'F' THEN fence WHEN m = 'f' THEN f ELSE '' END,
         CASE WHEN m IN ('N', 'L') THEN list_append(parents, indent) WHEN m IN ('l', 'b') THEN indents ELSE [] END,
         CASE WHEN m IN ('N', 'L') AND len(parents) = 0 THEN ordered ELSE ord END, m, CASE WHEN m IN ('N', 'L') THEN least(len(parents), 9)::INT ELSE 0 END
  FROM (
    SELECT *, CASE
        WHEN f <> '' THEN CASE WHEN closing[1] = f[1] AND length(closing) >= length(f) THEN 'E' ELSE 'f' END WHEN o = 'T' THEN 'd' WHEN fence <> '' THEN 'F' WHEN blank THEN 'b' WHEN pb THEN 'g'
        WHEN o = 'P' AND underline THEN 'S' WHEN rule THEN 'r' WHEN heading THEN 'h' WHEN quote THEN CASE WHEN o = 'q' THEN 'q' ELSE 'O' END
        WHEN item AND (indent < 4 OR listed) AND NOT (o = 'P' AND indent >= 4) THEN CASE WHEN NOT listed OR (len(parents) = 0 AND ordered <> ord) THEN 'N' ELSE 'L' END
        WHEN o = 't' THEN 't' WHEN head AND indent < 4 THEN 'T' WHEN o = 'P' THEN 'p' WHEN o = 'q' THEN 'Q' WHEN o = 'L' OR (o = 'M' AND indent >= 2) THEN 'l'
        WHEN indent >= 4 THEN CASE WHEN o = 'C' THEN 'c' ELSE 'C' END WHEN o = 'X' OR html THEN CASE WHEN o = 'X' THEN 'x' ELSE 'X' END ELSE 'P' END AS m
    FROM (SELECT r.open AS o, r.f, r.indents, r.ord, r.open IN ('L', 'M') AS listed, CASE WHEN r.open IN ('L', 'M') THEN list_filter(r.indents, lambda k: k <= x.indent - 2) ELSE [] END AS parents, x.*
          FROM run r JOIN flags x ON x.doc_id = r.doc_id AND x.i = r.i + 1))),
marked AS (SELECT doc_id, i, t, mark, depth, sum((contains('FhrgPCONTX', mark))::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM run JOIN lines USING (doc_id, i) WHERE i > 0),
grouped AS (
  SELECT doc_id, block, arg_min(mark, i) AS m, arg_min(t, i) AS t, max(CASE WHEN mark = 'S' THEN CASE WHEN contains(t, '=') THEN 1 ELSE 2 END END) AS under,
         count(*) FILTER (mark IN ('N', 'L')) AS items, count(*) FILTER (mark IN ('T', 't')) AS rows,
         string_agg(trim(t), ' ' ORDER BY i) FILTER (mark IN ('P', 'p')) AS para, string_agg(t, chr(10) ORDER BY i) FILTER (mark = 'f') AS fenced,
         string_agg(regexp_replace(t, '^ {1,4}', ''), chr(10) ORDER BY i) FILTER (mark IN ('C', 'c', 'b')) AS code,
         string_agg(CASE WHEN mark = 'Q' THEN trim(t) ELSE trim(regexp_extract(t, '^ {0,3}>[ \t]?(.*)$', 1)) END, ' ' ORDER BY i) FILTER (mark IN ('O', 'q', 'Q')) AS quoted,
         string_agg(CASE WHEN mark = 'l' THEN ' ' || trim(t) ELSE chr(30) || depth || CASE WHEN regexp_extract(t, '^( *)([-*+]|([0-9]{1,9})[.)])([ \t]+(.*))?$', 3) <> '' THEN 'o' ELSE 'u' END
           || trim(regexp_extract(t, '^( *)([-*+]|([0-9]{1,9})[.)])([ \t]+(.*))?$', 5)) END, '' ORDER BY i) FILTER (mark IN ('N', 'L', 'l')) AS list
  FROM marked WHERE block >= 0 GROUP BY doc_id, block)
SELECT doc_id, block::INT AS block,
       CASE m WHEN 'P' THEN CASE WHEN under IS NULL THEN 'paragraph' ELSE 'heading' END WHEN 'F' THEN 'code' WHEN 'h' THEN 'heading' WHEN 'r' THEN 'rule' WHEN 'g' THEN 'page-break' WHEN 'C' THEN 'code' WHEN 'O' THEN 'quote' WHEN 'N' THEN 'list' WHEN 'T' THEN 'table' ELSE 'omitted' END AS kind,
       CASE WHEN under IS NOT NULL THEN under WHEN m = 'h' THEN length(regexp_extract(t, '^ {0,3}(#{1,6})', 1)) END::INT AS level,
       CASE m WHEN 'N' THEN items WHEN 'T' THEN rows ELSE 0 END::INT AS n,
       sha256(CASE m WHEN 'P' THEN para WHEN 'F' THEN coalesce(fenced, '') WHEN 'h' THEN regexp_extract(t, '^ {0,3}(#{1,6})([ \t]+(.*?))?([ \t]+#+)?[ \t]*$', 3) WHEN 'C' THEN regexp_replace(code, '\n+$', '') WHEN 'O' THEN quoted
              WHEN 'N' THEN array_to_string(list_transform(string_split(list, chr(30))[2:], lambda p: p[1:2] || trim(p[3:])), chr(10)) ELSE '' END) AS sha256
FROM grouped""",
    "csv_rows": r"""
WITH source AS (SELECT doc_id, replace(replace(text, ', ', ',"'), '. ', '",') || chr(10) AS s FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, regexp_extract_all(s, '(?:"(?:[^"]|"")*"(?:[^",\r\n][^,\r\n]*)?|[^",\r\n][^,\r\n]*|)[,\r\n]|"(?:[^"]|"")*$') AS t FROM source),
each AS (SELECT doc_id, i, t[i] AS t FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM tokens)),
cells AS (
  SELECT doc_id, i, regexp_full_match(t, '"(?:[^"]|"")*') AS open, t[-1] <> ',' AS ends, t[:-2] AS raw FROM each),
rows AS (
  SELECT doc_id, i, open, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r,
         CASE WHEN raw[1] = '"' THEN replace(regexp_extract(raw, '^"((?:[^"]|"")*)"', 1), '""', '"') || regexp_extract(raw, '(?s)^"(?:[^"]|"")*"(.*)$', 1) ELSE raw END AS cell FROM cells),
whole AS (
  SELECT doc_id, r, count(*)::INT AS n_cells, sha256(string_agg(cell, chr(31) ORDER BY i)) AS sha256 FROM rows GROUP BY doc_id, r HAVING NOT bool_or(open) AND bool_or(cell <> ''))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS row, n_cells, sha256 FROM whole""",
    "package_cells": r"""
SELECT c_custkey // 100 AS doc_id, 'Customers' AS sheet, (row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1)::INT AS row,
       concat_ws('|', c_mktsegment, c_name, format('{:,.2f}', c_acctbal), '', strftime(DATE '1899-12-30' + c_custkey::INT, '%Y-%m-%d'), c_custkey || '%', CASE WHEN c_nationkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END) AS cells
FROM customer""",
    "word_lists": r"""
SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE role WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'heading 3' ELSE 'S9' END AS style,
       CASE WHEN role = 'assistant' THEN 3 END AS heading, role = 'user' AS ordered, CASE WHEN role = 'user' THEN 3 ELSE 1 END AS start, sha256(coalesce(text, '')) AS sha256
FROM conversations""",
}

QUERIES = {f.__name__: f for f in (csv_rows, package_cells, word_lists, markdown_structure)}
