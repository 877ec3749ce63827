r"""Delimited texts of any size, read by expressions in many tasks.

A text is cut into chunks. Whether a delimiter or an end of line counts depends on the quotes before it,
so each chunk first gives the state it ends in for every state it may start in; these maps are composed in two levels, which
gives each chunk its true start. Then every chunk is cut into rows on its own, the two halves of a row that a cut
parts are put together again, and rows are numbered by running sums over chunks.

A quote opens only in an empty cell and a doubled one inside is a quote; whatever follows a closing
quote belongs to the cell. Rows without any text are dropped, and so is a last row whose quote never closes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.durable import dropped, written
from ..functions.spread import with_offsets

#: The delimiters that are tried, and the limits of a document made of a table.
DELIMITERS = (",", ";", "\t", "|")
SAMPLE_CHARS, SAMPLE_ROWS, MAX_COLUMNS, SECTION = 32_768, 12, 40, 10
CHUNK = 1 << 16
#: Chunks in a block of the composition, and rows in a bucket of the numbering.
BLOCK, BUCKET = 1024, 4096

#: An empty cell, a cell with text, inside quotes before and after any text, and after a quote inside either.
STATES = "SUEQXY"
AFTER_QUOTE, AFTER_END, AFTER_TEXT = "EUXYQQ", "SSQQSS", "UUQQUU"
#: What a chunk that starts in a state is read behind.
BEFORE = {"S": "", "U": "x", "E": '"', "Q": '"x', "X": '""', "Y": '"x"'}


def _translate(text: Column, old: Column | str, new: Column | str) -> Column:
    return F.call_function("translate", text, *[F.lit(x) if isinstance(x, str) else x for x in (old, new)])


def _class(delimiter: Column) -> Column:
    """The delimiter inside a class of characters."""
    return F.regexp_replace(delimiter, r"([\\^\[\]&-])", r"\\$1")


def _cell(d: Column, closed: bool = False) -> Column:
    quoted = '"(?:[^"]++|"")*+' + ('"' if closed else '"?')
    return F.concat(F.lit(f"(?:{quoted}[^\r\n"), d, F.lit(']*+|[^"\r\n'), d, F.lit("][^\r\n"), d, F.lit("]*+|)"))


def _row_pattern(delimiter: Column) -> Column:
    d = _class(delimiter)
    return F.concat(F.lit(r"\G(?:"), _cell(d), F.lit("["), d, F.lit("])*+"), _cell(d), F.lit("[\r\n]"))


def _unquoted(cell: Column) -> Column:
    """A cell's text from what stands between its delimiters."""
    parts = r'(?s)^"((?:[^"]++|"")*+)"?(.*)$'
    inner = F.replace(F.regexp_extract(cell, parts, 1), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), F.concat(inner, F.regexp_extract(cell, parts, 2))).otherwise(cell)


def cells_of(row: Column, delimiter: Column) -> Column:
    """array<string>: the cells of one row without its end of line."""
    d = _class(delimiter)
    pattern = F.concat(F.lit(r"\G("), _cell(d), F.lit(")["), d, F.lit("]"))
    return F.transform(F.regexp_extract_all(F.concat(row, delimiter), pattern, F.lit(1)), _unquoted)


def _some(cells: Column) -> Column:
    return F.exists(cells, lambda c: c != "")


def detected_delimiter(source: Column) -> Column:
    """The delimiter under which the most sampled rows have one width; the first of equals."""

    def scored(text: Column, k: int) -> Column:
        d = F.lit(DELIMITERS[k])
        whole = F.concat(F.lit("^(?:"), _cell(_class(d)), F.lit("["), _class(d), F.lit("])*+"), _cell(_class(d), True), F.lit(r"\z"))

        def of_rows(rows: Column) -> Column:
            size = F.aggregate(rows, F.lit(0), lambda a, r: a + F.length(r))
            ended = F.transform(rows, lambda r: F.substr(r, F.lit(1), F.length(r) - 1))
            last = F.substr(text, size + 1, F.length(text))
            found = F.concat(ended, F.when(F.rlike(last, whole), F.array(last)).otherwise(F.array().cast("array<string>")))
            widths = F.transform(F.slice(F.filter(F.transform(found, lambda r: cells_of(r, d)), _some), 1, SAMPLE_ROWS), F.size)

            def score(w: Column) -> Column:
                alike = F.transform(w, lambda x: F.size(F.filter(w, lambda y: y == x)))
                return F.when(F.size(w) > 0, 100 * F.array_max(alike) + F.array_max(w)).otherwise(0)

            return let(F.filter(widths, lambda x: x > 1), score)

        return let(F.regexp_extract_all(text, _row_pattern(d), F.lit(0)), of_rows)

    best = lambda t: F.array_min(F.array(*[F.struct((-scored(t, k)).alias("score"), F.lit(k).alias("at"), F.lit(DELIMITERS[k]).alias("d")) for k in range(len(DELIMITERS))]))["d"]
    return let(F.substring(source, 1, SAMPLE_CHARS), best)


def end_states(chunk: Column, delimiter: Column) -> Column:
    """Six letters: for each of STATES, the state in which a chunk that starts in it ends."""
    d = _class(delimiter)
    marks = F.regexp_replace(chunk, F.concat(F.lit('[^"\r\n'), d, F.lit("]+")), F.lit("x"))
    marks = F.regexp_replace(_translate(marks, F.concat(F.lit("\r\n"), delimiter), ",,,"), ",+", ",")
    step = lambda now, c: F.when(c == '"', _translate(now, STATES, AFTER_QUOTE)).when(c == ",", _translate(now, STATES, AFTER_END)).when(c == "x", _translate(now, STATES, AFTER_TEXT)).otherwise(now)
    return F.aggregate(F.split(marks, ""), F.lit(STATES), step)


def _cut(texts: DataFrame, size: int) -> DataFrame:
    """Chunks of about ``size`` bytes of texts (doc_id, text, delimiter, source), cut between characters, each with the states it ends in."""
    t = texts.withColumn("source", F.col("source").cast("binary"))
    inside = lambda at: F.substring("source", at + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    between = lambda at: F.when(~inside(at), at).when(~inside(at + 1), at + 1).when(~inside(at + 2), at + 2).otherwise(at + 3)
    last = F.expr(f"greatest(octet_length(source) - 1, 0) div {size}").cast("int")
    t = t.select("*", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    begin, end = between(F.col("chunk") * size), between((F.col("chunk") + 1) * size)
    t = t.select("doc_id", "text", "delimiter", "chunk", (F.col("chunk") == F.col("_last")).alias("last"), F.substring("source", begin + 1, end - begin).cast("string").alias("piece"))
    return t.repartition("text", "chunk").withColumn("ends", end_states(F.col("piece"), F.col("delimiter")))


def _starts(chunks: DataFrame) -> DataFrame:
    """text, chunk and the state in which the chunk starts: maps composed within blocks, blocks within texts."""
    letter = lambda states, state: _translate(state, STATES, states)
    maps = chunks.select("text", "chunk", "ends", F.expr(f"chunk div {BLOCK}").cast("int").alias("block"))
    blocks = maps.groupBy("text", "block").agg(F.sort_array(F.collect_list(F.struct("chunk", "ends"))).alias("maps"))
    whole = blocks.select("text", "block", F.aggregate("maps", F.lit(STATES), lambda a, m: letter(m["ends"], a)).alias("ends"))
    zero = F.struct(F.lit("S").alias("now"), F.lit("").alias("met"))
    step = lambda a, m: F.struct(letter(m["ends"], a["now"]).alias("now"), F.concat(a["met"], a["now"]).alias("met"))
    tops = whole.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("maps"))
    tops = tops.select("text", "maps", F.aggregate("maps", zero, step)["met"].alias("met"))
    tops = tops.select("text", F.explode(F.transform("maps", lambda m, i: F.struct(m["block"].alias("block"), F.substr("met", i + 1, F.lit(1)).alias("start")))).alias("b")).select("text", "b.*")
    met = lambda start: F.aggregate("maps", F.struct(start.alias("now"), F.lit("").alias("met")), step)["met"]
    inner = blocks.join(tops, ["text", "block"]).select("text", "maps", met(F.col("start")).alias("met"))
    return inner.select("text", F.explode(F.transform("maps", lambda m, i: F.struct(m["chunk"].alias("chunk"), F.substr("met", i + 1, F.lit(1)).alias("start")))).alias("c")).select("text", "c.*")


def _tokens(chunks: DataFrame) -> DataFrame:
    """Per chunk the rows that end in it, the rest behind them, and whether the text ends inside quotes."""
    t = chunks.join(_starts(chunks), ["text", "chunk"])
    before = F.create_map(*[F.lit(x) for kv in BEFORE.items() for x in kv])[F.col("start")]
    t = t.withColumn("_skip", F.length(before)).withColumn("_read", F.concat(before, "piece"))
    t = t.withColumn("rows", F.regexp_extract_all("_read", _row_pattern(F.col("delimiter")), F.lit(0)))
    size = F.aggregate("rows", F.lit(0), lambda a, r: a + F.length(r))
    own = lambda r, first: F.when(first, F.substr(r, F.col("_skip") + 1, F.length(r))).otherwise(r)
    return t.select(
        "doc_id", "text", "delimiter", "chunk", F.transform("rows", lambda r, i: own(r, i == 0)).alias("rows"), own(F.substr("_read", size + 1, F.length("_read")), F.size("rows") == 0).alias("rest"),
        F.size("rows").alias("n"), (F.col("last") & _translate(F.col("start"), STATES, F.col("ends")).isin("E", "Q")).alias("open"),
    )


def csv_rows(texts: DataFrame, delimiter: str | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, row (from 0), cells of every text (doc_id, source); the delimiter is found by a sample unless given.

    A text of one chunk is read inside its row, so only longer ones are cut, sent and written. A null text has
    no rows; rows with one doc_id or without are separate texts (column ``text``)."""
    d = F.lit(delimiter) if delimiter else detected_delimiter(F.col("source"))
    short = F.octet_length("source") <= chunk_bytes

    def numbered(some: DataFrame, odd: int) -> DataFrame:
        # Even numbers for short texts and odd ones for long, as the two are numbered apart.
        return some.select("doc_id", (F.monotonically_increasing_id() * 2 + odd).alias("text"), d.alias("delimiter"), "source")

    out = _whole_rows(numbered(texts.where(short), 0))
    long = numbered(texts.where(~short), 1)
    return out if long.isEmpty() else out.unionByName(_chunked_rows(long, chunk_bytes))


def _whole_rows(texts: DataFrame) -> DataFrame:
    """The rows of texts (doc_id, text, delimiter, source) of one chunk each."""
    size = F.aggregate("raw", F.lit(0), lambda a, r: a + F.length(r))
    t = texts.withColumn("raw", F.regexp_extract_all("source", _row_pattern(F.col("delimiter")), F.lit(0))).withColumn("rest", F.substr("source", size + 1, F.length("source")))
    # What stands behind the last row is one, unless its quote never closes.
    is_open = _translate(F.lit("S"), STATES, end_states(F.col("rest"), F.col("delimiter"))).isin("E", "Q")
    raw = F.concat("raw", F.when((F.col("rest") == "") | is_open, F.array().cast("array<string>")).otherwise(F.array("rest")))
    rows = F.filter(F.transform(raw, lambda r: cells_of(F.regexp_replace(r, r"[\r\n]\z", ""), F.col("delimiter"))), _some)
    return t.select("doc_id", "text", F.posexplode(rows).alias("row", "cells")).select("doc_id", "text", F.col("row").cast("long").alias("row"), "cells")


def _chunked_rows(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """The rows of texts (doc_id, text, delimiter, source) of any size."""
    chunks = written(_cut(texts, chunk_bytes), "csv-chunks")
    tokens = written(_tokens(chunks), "csv-rows")
    dropped(chunks)
    sums = with_offsets(tokens.select("text", "chunk", "n"), ["text"], "chunk", {"n": "_before"}).select("text", "chunk", "_before")
    t = tokens.join(sums, ["text", "chunk"])
    key = ["doc_id", "text", "delimiter"]
    number = (F.col("_before") + F.col("i")).alias("number")
    inner = t.select(*key, "_before", F.posexplode("rows").alias("i", "raw"))
    whole = inner.where("i > 0").select(*key, number, "raw")
    # The first row that ends in a chunk may begin in earlier ones.
    first = t.where("n > 0").select(*key, "chunk", F.col("_before").alias("number"), F.element_at("rows", 1).alias("raw"), F.lit(False).alias("open"))
    rest = t.select(*key, "chunk", (F.col("_before") + F.col("n")).alias("number"), F.col("rest").alias("raw"), "open")
    parts = first.unionByName(rest).groupBy(*key, "number").agg(F.sort_array(F.collect_list(F.struct("chunk", "raw"))).alias("p"), F.max("open").alias("open"))
    parts = parts.where("not open").select(*key, "number", F.array_join(F.transform("p", lambda p: p["raw"]), "").alias("raw"))
    rows = whole.unionByName(parts).select("doc_id", "text", "number", cells_of(F.regexp_replace("raw", r"[\r\n]\z", ""), F.col("delimiter")).alias("cells")).where(_some(F.col("cells")))
    rows = written(rows.withColumn("_bucket", F.expr(f"number div {BUCKET}")), "csv-cells")
    dropped(tokens)
    sums = with_offsets(rows.groupBy("text", "_bucket").agg(F.count("*").alias("_n")), ["text"], "_bucket", {"_n": "_before"}).select("text", "_bucket", "_before")
    place = F.row_number().over(Window.partitionBy("text", "_bucket").orderBy("number")) - 1
    return rows.join(sums, ["text", "_bucket"]).select("doc_id", "text", (F.col("_before") + place).alias("row"), "cells")


def csv_report(rows: DataFrame) -> DataFrame:
    """text, n_rows, widest, sections (of SECTION columns, MAX_COLUMNS in all) and the warnings of a table as a document."""
    r = rows.groupBy("text").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("widest"))
    sections = F.ceil(F.least("widest", F.lit(MAX_COLUMNS)) / SECTION).cast("int")
    wide = F.when(F.col("widest") > MAX_COLUMNS, f"Columns after column {MAX_COLUMNS} were omitted.")
    many = F.when(sections > 1, F.concat(F.lit("The wide table was laid out in "), sections.cast("string"), F.lit(" column sections.")))
    return r.select("text", "n_rows", "widest", sections.alias("sections"), F.array_compact(F.array(wide, many)).alias("warnings"))


def csv_sections(rows: DataFrame) -> DataFrame:
    """doc_id, text, section (from 0), first_column, row, cells: every row cut into sections, short rows padded."""
    r = rows.join(csv_report(rows).select("text", F.least("widest", F.lit(MAX_COLUMNS)).alias("_width")), "text")
    r = r.withColumn("_padded", F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("_width"))), F.lit(1), F.col("_width")))
    part = F.transform(F.sequence(F.lit(0), F.col("_width") - 1, F.lit(SECTION)), lambda c: F.slice(F.col("_padded"), c + 1, F.least(F.lit(SECTION), F.col("_width") - c)))
    return r.select("doc_id", "text", "row", F.posexplode(part).alias("section", "cells")).select("doc_id", "text", "section", (F.col("section") * SECTION + 1).alias("first_column"), "row", "cells")
