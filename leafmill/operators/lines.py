"""Lines of plain text: repeated lines, blocks, transcripts, wrapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.guards import required
from ..functions.scalars import BLANK, normalize_margin, strip_space

LIST_ITEM = r"^\s*(?:([0-9]+)[.)]|([•●▪◦*-]))\s+(.+)$"
STAMP = r"^\s*\[((?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:\.[0-9]{1,3})?)\]\s*"
#: Fixed value: the color of a time stamp.
STAMP_COLOR = (0.12, 0.32, 0.58)


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), text."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "text"))


def repeated_lines(docs: DataFrame, group: str = "source") -> DataFrame:
    """Lines that stand in so many documents of a group as margins would: in max(2, 60 %) of them.

    An adaptation of margin removal: a document is a page, its group the document, and every
    line counts as margin. Returns group, norm, n_docs."""
    totals = docs.groupBy(group).agg(F.count("*").alias("n"))
    lines = docs.select(group, "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    norm = lines.select(group, "doc_id", normalize_margin(F.col("line")).alias("norm")).where(F.length("norm") >= 2).distinct()
    counts = norm.groupBy(group, "norm").agg(F.count("*").alias("n_docs"))
    least = F.greatest(F.lit(2), F.ceil(F.col("n") * 0.6))
    return counts.join(totals, group).where((F.col("n") >= 2) & (F.col("n_docs") >= least)).select(group, "norm", "n_docs")


def without_lines(docs: DataFrame, repeated: DataFrame, group: str = "source") -> DataFrame:
    """doc_id, line_no, line of the lines that are not among the repeated ones of the group."""
    lines = docs.select(group, "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("norm", normalize_margin(F.col("line")))
    return lines.join(repeated.select(group, "norm"), [group, "norm"], "left_anti").select("doc_id", "line_no", "line")


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block, kind (list or paragraph), ordered, n_lines, text from lines of plain text.

    A blank line ends a block; consecutive items of one kind of list are one block, and so
    are consecutive other lines."""
    lines = split_lines(docs)
    item = F.col("text").rlike(LIST_ITEM)
    numbered = F.regexp_extract("text", LIST_ITEM, 1) != ""
    lines = lines.withColumn("kind", F.when(strip_space(F.col("text")) == "", "blank").when(item & numbered, "ordered").when(item, "bullets").otherwise("paragraph"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    new = (F.col("kind") != F.lag("kind", 1, "blank").over(w)).cast("int")
    lines = lines.withColumn("_new", new).withColumn("_block", F.sum("_new").over(w))
    body = F.when(F.col("kind") == "paragraph", strip_space(F.col("text"))).otherwise(F.regexp_extract("text", LIST_ITEM, 3))
    b = lines.where("kind <> 'blank'").groupBy("doc_id", "_block", "kind").agg(F.sort_array(F.collect_list(F.struct("line_no", body.alias("t")))).alias("l"))
    texts = F.transform("l", lambda x: x["t"])
    joined = F.when(F.col("kind") == "paragraph", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n"))
    return b.select(
        "doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_block")) - 1).alias("block"),
        F.when(F.col("kind") == "paragraph", "paragraph").otherwise("list").alias("kind"), (F.col("kind") == "ordered").alias("ordered"), F.size("l").alias("n_lines"), joined.alias("text"),
    )


def text_ebook(docs: DataFrame) -> DataFrame:
    """doc_id, block, text: paragraphs between blank lines, trimmed, empty ones dropped."""
    parts = F.filter(F.transform(F.split("text", "\n" + BLANK + "*\n"), lambda x: strip_space(x)), lambda p: p != "")
    return docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("block", "text"))


def transcript(docs: DataFrame, most_chars: int | None = None) -> DataFrame:
    """doc_id, paragraph, line, stamp, text, runs: a leading time stamp of a line becomes its stamp and a bold run.

    With ``most_chars``, a longer text ends the job with the code MEMORY_LIMIT."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    if most_chars is not None:
        text = required(text, F.length("text") <= most_chars, "MEMORY_LIMIT", f"a transcript has {most_chars} characters at most")
    parts = F.filter(F.split(text, "\n{2,}"), lambda p: strip_space(p) != "")
    p = docs.where("text is not null").select("doc_id", F.posexplode(parts).alias("paragraph", "_p"))
    p = p.select("doc_id", "paragraph", F.posexplode(F.split("_p", "\n")).alias("line", "_l"))
    p = p.select("doc_id", "paragraph", "line", F.nullif(F.regexp_extract("_l", STAMP, 1), F.lit("")).alias("stamp"), F.regexp_replace("_l", STAMP, "").alias("text"))
    run = lambda t, marked: F.struct(t.alias("text"), F.lit(marked).alias("bold"), F.lit(marked).alias("code"), (F.array(*[F.lit(c) for c in STAMP_COLOR]) if marked else F.lit(None).cast("array<double>")).alias("color"))
    said = run(F.col("text"), False)
    return p.withColumn("runs", F.when(F.col("stamp").isNull(), F.array(said)).otherwise(F.array(run(F.concat(F.lit("["), "stamp", F.lit("] ")), True), said)))


def width_in(widths: dict[str, float], usual: float) -> Callable[[Column], Column]:
    """The width of a word by those of its characters, ``usual`` for the ones that are not named."""
    known = F.create_map(*[F.lit(x) for c, w in widths.items() for x in (c, float(w))]) if widths else F.create_map().cast("map<string,double>")
    return lambda word: F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(known, c), F.lit(float(usual))))


def wrapped(text: Column, most: float, width: Callable[[Column], Column] = F.length, space: float = 1) -> Column:
    """array<string>: every line of the text filled greedily with words up to ``most`` characters, or up to a width
    with the ``width`` of a word and that of a ``space``.

    A blank line stays one blank line; a longer word has a line of its own."""

    def fill(line: Column) -> Column:
        # The fold keeps the length of the line so far and a mark for each word, as its state is copied at every step.
        zero = F.struct(F.lit(0.0).alias("now"), F.lit("").alias("marks"))

        def step(a: Column, w: Column) -> Column:
            empty, full = a["now"] == 0, a["now"] + space + w > most
            mark = F.when(empty, "e").when(full, "n").otherwise("s")
            now = F.when(empty | full, w).otherwise(a["now"] + space + w)
            return F.struct(now.alias("now"), F.concat(a["marks"], mark).alias("marks"))

        def filled(words: Column) -> Column:
            marks = F.split(F.aggregate(F.transform(words, lambda w: width(w).cast("double")), zero, step)["marks"], "")
            parted = F.transform(F.arrays_zip(words.alias("w"), marks.alias("m")), lambda z: F.concat(F.when(z["m"] == "n", "\n").when(z["m"] == "s", " ").otherwise(""), z["w"]))
            return F.split(F.array_join(parted, ""), "\n")

        return F.when(strip_space(line) == "", F.array(F.lit(""))).otherwise(let(F.split(line, r"\s+"), filled))

    return F.flatten(F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), fill))


def paginated(docs: DataFrame, most_chars: int = 80, most_lines: int = 50) -> DataFrame:
    """doc_id, page (from 1), line (from 1 on the page), text."""
    lines = docs.where("text is not null").select("doc_id", F.posexplode(wrapped(F.col("text"), most_chars)).alias("i", "text"))
    return lines.select("doc_id", (F.floor(F.col("i") / most_lines) + 1).cast("int").alias("page"), (F.col("i") % most_lines + 1).alias("line"), "text")
