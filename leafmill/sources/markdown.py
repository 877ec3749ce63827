r"""The block structure of Markdown by expressions: every line gets a mark, marks make blocks.

What a line is depends on the lines before it (an open fence, a paragraph that goes on, the list it is in), so a fold runs over
a text's lines. Its state is small, the kind of block that is open, the fence and the indents of the open list items, and
it writes one mark and one depth for each line. Blocks are then counted by a window and put together by groups.

Known: ATX and Setext headings, paragraphs with lazy lines, fenced and indented code, quotes, nested lists with lines that
continue an item, tables with a delimiter row, rules, page breaks (a comment) and HTML blocks, which are left out and told.
A quote's inner blocks are one text, and lists inside items are items of a greater depth. An item nests in those that are indented by
two characters less.

Marks: F opens a fence, E closes it, f stands inside; h heading, S underline of one; r rule; g page break; P paragraph,
p its next lines; C and c indented code; O and q quote, Q a lazy line of one; N item that begins a list, L item, l line
of one; T, d and t head, delimiter and rows of a table; X and x HTML; b blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import strip_space

OPENS = "FhrgPCONTX"
FENCE, CLOSE = r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`\s]*)[^`]*$", r"^ {0,3}(`{3,}|~{3,})[ \t]*$"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"
UNDERLINE, RULE = r"^ {0,3}(=+|-+)[ \t]*$", r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
ITEM, QUOTE = r"^( *)(?:[-*+]|([0-9]{1,9})[.)])(?:[ \t]+(.*))?$", r"^ {0,3}>[ \t]?(.*)$"
DELIMITERS = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
PAGE_BREAK, HTML = r"(?i)^\s*<!--\s*pagebreak\s*-->\s*$", r"^ {0,3}<[A-Za-z/!?]"
DEEPEST = 9


def _flags(line: Column, following: Column) -> Column:
    """What a line could be by itself."""
    is_ = lambda p: line.rlike(p)
    return F.struct(
        line.alias("text"), (strip_space(line) == "").alias("blank"), F.regexp_extract(line, FENCE, 1).alias("fence"), F.regexp_extract(line, CLOSE, 1).alias("close"), is_(HEADING).alias("heading"),
        is_(UNDERLINE).alias("underline"), is_(RULE).alias("rule"), is_(ITEM).alias("item"), (F.regexp_extract(line, ITEM, 2) != "").alias("ordered"), F.length(F.regexp_extract(line, r"^( *)", 1)).alias("indent"),
        is_(QUOTE).alias("quote"), (line.contains("|") & F.coalesce(following.rlike(DELIMITERS), F.lit(False))).alias("head"), is_(PAGE_BREAK).alias("break"), is_(HTML).alias("html"),
    )


def _step(a: Column, x: Column) -> Column:
    """The state after a line: open (block), fence, indents, ordered, marks, depths."""
    now = a["open"]
    listed = now.isin("L", "M")
    closes = (F.substr(x["close"], F.lit(1), F.lit(1)) == F.substr(a["fence"], F.lit(1), F.lit(1))) & (F.length(x["close"]) >= F.length(a["fence"]))
    far = x["indent"] >= 4
    parents = F.when(listed, F.filter(a["indents"], lambda i: i <= x["indent"] - 2)).otherwise(F.array().cast("array<int>"))
    item = x["item"] & (~far | listed)
    begins = ~listed | ((F.size(parents) == 0) & (x["ordered"] != a["ordered"]))
    mark = (
        F.when(a["fence"] != "", F.when(closes, "E").otherwise("f")).when(now == "T", "d").when(x["fence"] != "", "F").when(x["blank"], "b").when(x["break"], "g")
        .when((now == "P") & x["underline"], "S").when(x["rule"], "r").when(x["heading"], "h").when(x["quote"], F.when(now == "q", "q").otherwise("O")).when(item & ~((now == "P") & far), F.when(begins, "N").otherwise("L"))
        .when(now == "t", "t").when(x["head"] & ~far, "T").when(now == "P", "p").when(now == "q", "Q").when((now == "L") | ((now == "M") & (x["indent"] >= 2)), "l")
        .when(far, F.when(now == "C", "c").otherwise("C")).when((now == "X") | x["html"], F.when(now == "X", "x").otherwise("X")).otherwise("P")
    )

    def after(m: Column) -> Column:
        opened = (
            F.when(m.isin("P", "p"), "P").when(m.isin("O", "q", "Q"), "q").when(m.isin("N", "L", "l"), "L").when(m == "T", "T").when(m.isin("d", "t"), "t").when(m.isin("C", "c"), "C").when(m.isin("X", "x"), "X")
            .when((m == "b") & listed, "M").when((m == "b") & (now == "C"), "C").otherwise("")
        )
        new = m.isin("N", "L")
        indents = F.when(new, F.array_append(parents, x["indent"])).when(m.isin("l", "b"), a["indents"]).otherwise(F.array().cast("array<int>"))
        depth = F.when(new, F.least(F.size(parents), F.lit(DEEPEST))).otherwise(0)
        return F.struct(
            opened.alias("open"), F.when(m == "F", x["fence"]).when(m == "f", a["fence"]).otherwise("").alias("fence"), indents.alias("indents"),
            F.when(new & (F.size(parents) == 0), x["ordered"]).otherwise(a["ordered"]).alias("ordered"), F.concat(a["marks"], m).alias("marks"), F.concat(a["depths"], depth.cast("string")).alias("depths"),
        )

    return F.get(F.transform(F.array(mark), after), F.lit(0))


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, line, text, mark, depth of every line of the texts (doc_id, source)."""
    t = docs.where("source is not null").select("doc_id", F.monotonically_increasing_id().alias("text_id"), F.split(F.regexp_replace("source", "\r\n?", "\n"), "\n").alias("l"))
    t = t.select("doc_id", "text_id", F.transform("l", lambda x, i: _flags(F.replace(x, F.lit("\t"), F.lit("    ")), F.get("l", i + 1))).alias("l"))
    zero = F.struct(F.lit("").alias("open"), F.lit("").alias("fence"), F.array().cast("array<int>").alias("indents"), F.lit(False).alias("ordered"), F.lit("").alias("marks"), F.lit("").alias("depths"))
    t = t.withColumn("e", F.aggregate("l", zero, _step)).select("doc_id", "text_id", "l", F.split("e.marks", "").alias("m"), F.split("e.depths", "").alias("d"))
    z = t.select("doc_id", "text_id", F.posexplode(F.arrays_zip(F.transform("l", lambda x: x["text"]).alias("text"), "m", "d")).alias("line", "z"))
    return z.select("doc_id", "text_id", "line", "z.text", F.col("z.m").alias("mark"), F.col("z.d").cast("int").alias("depth"))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(strip_space(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(strip_space(c), F.lit("\\|"), F.lit("|")))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, block (from 0), kind, level, language, ordered, start, text, items (array of depth, ordered, text), rows.

    Texts keep their inline marks (see ``inline_plain``). A null source has no blocks; rows with one doc_id or without
    are separate texts."""
    lines = marked_lines(docs)
    opens = F.contains(F.lit(OPENS), F.col("mark")).cast("int")
    lines = lines.withColumn("block", F.sum(opens).over(Window.partitionBy("text_id").orderBy("line")) - 1).where("block >= 0")
    g = lines.groupBy("doc_id", "text_id", "block").agg(F.sort_array(F.collect_list(F.struct("line", "mark", "depth", "text"))).alias("l"))
    first = lambda c: F.col("l")[0][c]
    of = lambda *marks: F.filter("l", lambda x: x["mark"].isin(*marks))
    joined = lambda part, change, by: F.array_join(F.transform(part, lambda x: change(x["text"])), by)
    under = of("S")
    kind = F.when((first("mark") == "P") & (F.size(under) > 0), "heading")
    for mark, name in (("F", "code"), ("h", "heading"), ("r", "rule"), ("g", "page-break"), ("P", "paragraph"), ("C", "code"), ("O", "quote"), ("N", "list"), ("T", "table"), ("X", "omitted")):
        kind = kind.when(first("mark") == mark, name)
    unquoted = lambda x: F.when(x["mark"] == "Q", strip_space(x["text"])).otherwise(strip_space(F.regexp_extract(x["text"], QUOTE, 1)))
    inner = F.regexp_replace(joined(of("C", "c", "b"), lambda t: F.regexp_replace(t, "^ {1,4}", ""), "\n"), "\n+$", "")
    text = (
        F.when(first("mark") == "P", joined(of("P", "p"), strip_space, " ")).when(first("mark") == "h", F.regexp_extract(first("text"), HEADING, 2)).when(first("mark") == "F", joined(of("f"), lambda t: t, "\n"))
        .when(first("mark") == "C", inner).when(first("mark") == "O", F.array_join(F.transform(of("O", "q", "Q"), unquoted), " "))
    )
    # An item's lines follow its own: all are joined, parted where an item begins, and cut again.
    piece = lambda x: F.when(x["mark"] == "l", F.concat(F.lit(" "), strip_space(x["text"]))).otherwise(
        F.concat(F.lit("\x1e"), x["depth"].cast("string"), F.when(F.regexp_extract(x["text"], ITEM, 2) != "", "o").otherwise("u"), strip_space(F.regexp_extract(x["text"], ITEM, 3)))
    )
    pieces = F.split(F.array_join(F.transform(F.filter("l", lambda x: x["mark"].isin("N", "L", "l")), lambda x: piece(x)), ""), "\x1e")
    items = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), lambda p: F.struct(F.substring(p, 1, 1).cast("int").alias("depth"), (F.substring(p, 2, 1) == "o").alias("ordered"), strip_space(F.substr(p, F.lit(3), F.length(p))).alias("text")))
    number = F.regexp_extract(first("text"), ITEM, 2)
    is_list, is_table = first("mark") == "N", first("mark") == "T"
    return g.select(
        "doc_id", "text_id", F.col("block").cast("int").alias("block"), kind.alias("kind"),
        F.when(F.size(under) > 0, F.when(under[0]["text"].contains("="), 1).otherwise(2)).when(first("mark") == "h", F.length(F.regexp_extract(first("text"), HEADING, 1))).alias("level"),
        F.when(first("mark") == "F", F.nullif(F.regexp_extract(first("text"), FENCE, 2), F.lit(""))).alias("language"), F.when(is_list, number != "").alias("ordered"), F.when(is_list & (number != ""), number.cast("int")).alias("start"),
        text.alias("text"), F.when(is_list, items).alias("items"), F.when(is_table, F.transform(of("T", "t"), lambda x: _cells(x["text"]))).alias("rows"),
    )


#: What inline marks are replaced by, in order: code spans, images with and without a text, links, strong, emphasis, struck out, escapes.
INLINE = (
    (r"(`+)[ ]?(.+?)[ ]?(?<!`)\1(?!`)", "$2"), (r"!\[([^\]]+)\]\([^)]*\)", "[Image: $1]"), (r"!\[\]\([^)]*\)", "[Image]"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?<!\\)(\*\*|__)(?=\S)(.+?)(?<=[^\s\\])\1", "$2"),
    (r"(?<!\\)\*(?=\S)([^*]+?)(?<=[^\s\\])\*", "$1"), (r"(?<![A-Za-z0-9_\\])_(?=\S)([^_]+?)(?<=[^\s\\])_(?![A-Za-z0-9_])", "$1"), (r"(?<!\\)~~(?=\S)(.+?)(?<=[^\s\\])~~", "$1"), (r"\\([!-/:-@\[-`{-~])", "$1"),
)


def inline_plain(text: Column) -> Column:
    """A text without its inline marks."""
    for pattern, put in INLINE:
        text = F.regexp_replace(text, pattern, put)
    return text
