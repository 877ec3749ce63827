r"""Personal data in text: detectors, redaction and its verification.

All detectors run in one scan and inside the row, without a join or shuffle; a match's offset is the
length of what stands before it. Offsets count code points. JavaScript's ASCII word boundary is
written with look-arounds, as Java's ``\b`` also knows other letters.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.geometry import match_rect
from ..functions.scalars import luhn_valid, squeezed, strip_space, verhoeff_valid
from .terms import terms_found

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_S = r"[\s ﻿]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Marks around a match while it is measured: two code points that are no characters; U+FFFD stands for one in a text.
OPEN, CLOSE = "\ufdd0", "\ufdd1"

#: The detectors in the order that breaks ties, their patterns and whether they run by default.
DETECTORS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", True),
    ("credit-card", _B + r"(?:[0-9][ -]?){13,19}(?:(?<=[0-9])(?![0-9A-Za-z_])|(?<=[ -])(?=[0-9A-Za-z_]))", True),
    ("aadhaar", _B + rf"[0-9]{{4}}(?:{_S}|-)?[0-9]{{4}}(?:{_S}|-)?[0-9]{{4}}" + _E, True),
    ("pan", _B + r"[A-Z]{5}[0-9]{4}[A-Z]" + _E, True),
    ("phone", rf"(?:\+?[0-9]{{1,3}}(?:{_S}|-)?)?(?:\([0-9]{{2,5}}\)(?:{_S}|-)?)?(?:[0-9]{{4}}(?:{_S}|-)[0-9]{{3}}(?:{_S}|-)[0-9]{{3}}|[0-9]{{3}}(?:{_S}|-)[0-9]{{3}}(?:{_S}|-)[0-9]{{4}}|[0-9]{{5}}(?:{_S}|-)[0-9]{{5}})", True),
    ("ip-address", _B + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + _E, True),
    ("url", r"https?://[^\s ﻿<>\"')\]]+", False),
)
CARD_WORDS = "card|visa|mastercard|amex|debit|credit|cc:"


def all_matches(text: Column, pattern: str, most: int | None = None) -> Column:
    """array<struct<value, start>>: the non-empty matches of a pattern and their offsets, the first ``most`` if given.

    One pass of the pattern: each match is put between OPEN and CLOSE."""
    spot = "array<struct<value:string,start:int>>"
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, "\ufffd\ufffd"), pattern, OPEN + "$0" + CLOSE)

    def spans(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.struct(F.substring_index(p, CLOSE, 1).alias("value"), F.length(p).alias("size")))
        # The fold writes the starts as a text, as its state is copied at every step.
        zero = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.lit("").alias("starts"))
        step = lambda a, p: F.struct((a["at"] + p["size"] - 1).alias("at"), F.concat(a["starts"], a["at"].cast("string"), F.lit(",")).alias("starts"))
        starts = let(F.split(F.aggregate(pairs, zero, step)["starts"], ","), lambda s: F.transform(pairs, lambda p, i: F.struct(p["value"].alias("value"), F.get(s, i).cast("int").alias("start"))))
        found = F.filter(starts, lambda m: m["value"] != "")
        return F.when(F.size(parts) > 1, found if most is None else F.slice(found, 1, most)).otherwise(F.array().cast(spot))

    return let(F.split(marked, OPEN), spans)


def _accepted(kind: str, text: Column, m: Column) -> Column:
    digits = F.regexp_replace(m["value"], "[^0-9]", "")
    if kind == "credit-card":
        before = F.lower(F.substr(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))))
        return luhn_valid(m["value"]) | (before.rlike(CARD_WORDS) & (F.length(digits) >= 13))
    if kind == "aadhaar":
        return verhoeff_valid(m["value"])
    if kind == "phone":
        return F.length(digits).between(10, 13) & ~digits.rlike("^(?:19|20)[0-9]{2}")
    return F.lit(True)


def custom_detectors(patterns: list[str]) -> list[tuple[str, str]]:
    """Checked patterns of the user; blank ones are skipped, long or broken ones refused.

    They run as Java patterns, so they are checked as such where a session is at hand; else by
    Python's rules, and what only Python knows is refused."""
    out = []
    spark = SparkSession.getActiveSession()
    for p in patterns:
        if not p.strip():
            continue
        if len(p) > 200:
            raise ValueError("INVALID_INPUT: custom patterns must be 200 characters or fewer")
        try:
            if spark is None:
                if "(?P" in p:
                    raise re.error("a group by Python's rules", p)
                re.compile(p)
            else:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(p)
        except (re.error, PySparkException) as e:
            raise ValueError(f"INVALID_INPUT: custom pattern {p!r} is not a valid regular expression") from e
        out.append(("custom", p))
    return out


def pii_spans(text: Column, enabled: set[str] | None = None, custom: list[str] = ()) -> Column:
    """array<struct<type, value, start, end, detector_ord, match_ord>> of a text, detector by detector;
    overlapping matches all stay, a null text has none."""
    chosen = [(k, p) for k, p, on in DETECTORS if (on if enabled is None else k in enabled)] + custom_detectors(list(custom))
    order = [k for k, _, _ in DETECTORS] + ["custom"]
    none = F.array().cast("array<struct<type:string,value:string,start:int,end:int,detector_ord:int,match_ord:int>>")

    def of_kind(kind: str, pattern: str) -> Column:
        kept = F.filter(all_matches(text, pattern), lambda m: _accepted(kind, text, m))
        trimmed = kind in ("credit-card", "aadhaar", "phone")

        def row(m: Column, i: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("type"), (strip_space(m["value"]) if trimmed else m["value"]).alias("value"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"),
                F.lit(order.index(kind)).alias("detector_ord"), i.alias("match_ord"),
            )

        # What a text must hold for the pattern to match at all spares most texts the pass.
        needed = {"email": F.contains(text, F.lit("@")), "url": F.contains(text, F.lit("://")), "ip-address": text.rlike("[0-9][.][0-9]")}
        needed = needed.get(kind, F.lit(True) if kind == "custom" else text.rlike("[0-9]{4}"))
        if kind in ("credit-card", "phone"):
            needed = text.rlike("[0-9]")
        return F.when(needed, F.transform(kept, row)).otherwise(none)

    return F.concat(none, *[F.coalesce(of_kind(k, p), none) for k, p in chosen])


def find_pii(docs: DataFrame, enabled: set[str] | None = None, custom: list[str] = ()) -> DataFrame:
    """doc_id, type, value, start, end, detector_ord, match_ord; overlapping matches all stay."""
    return docs.select("doc_id", F.explode(pii_spans(F.col("text"), enabled, custom)).alias("m")).select("doc_id", "m.*")


def pii_by_type(matches: DataFrame) -> DataFrame:
    """type, matches, documents, first_start."""
    return matches.groupBy("type").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("documents"), F.min("start").alias("first_start"))


def masked(text: Column, spans: Column, mask: str = "█") -> Column:
    """struct<text, n_masked>: the text with every span masked, and how many characters are.

    Spans are taken in order, each from where the ones before end, so a character is masked once."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], a["at"])
        size = F.greatest(s["end"] - begin, F.lit(0))
        out = F.concat(a["out"], F.substr(text, a["at"] + 1, begin - a["at"]), F.repeat(F.lit(mask), size))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(size > 0, out).otherwise(a["out"]).alias("out"), (a["n"] + size).alias("n"))

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    whole = lambda f: F.struct(F.concat(f["out"], F.substr(text, f["at"] + 1, F.length(text))).alias("text"), f["n"].alias("n_masked"))
    return let(F.aggregate(ordered, zero, step), whole)


def redacted(docs: DataFrame, enabled: set[str] | None = None, custom: list[str] = (), mask: str = "█") -> DataFrame:
    """doc_id, text with the personal data of each row masked, n_masked characters, found: the values.

    All happens inside the row, so rows without doc_id or with a repeated one are masked like any; a
    null text stays null."""
    rows = docs.select("doc_id", "text", pii_spans(F.col("text"), enabled, custom).alias("_spans"))
    rows = rows.select("doc_id", masked(F.col("text"), F.col("_spans"), mask).alias("_m"), F.array_distinct(F.transform("_spans", lambda s: s["value"])).alias("found"))
    return rows.select("doc_id", F.col("_m.text").alias("text"), F.coalesce("_m.n_masked", F.lit(0)).alias("n_masked"), "found")


def leftovers(text: Column, terms: Column) -> Column:
    """The terms (trimmed, three characters and more) that still occur in a text; white space and case are ignored."""
    trimmed = F.filter(F.transform(terms, strip_space), lambda t: F.length(t) >= 3)
    return let(squeezed(text), lambda hay: F.array_distinct(F.filter(trimmed, lambda t: F.contains(hay, squeezed(t)))))


def redaction_leftovers(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct terms of three characters and more that still occur in some page.

    What a row's own detectors found is verified in the row by ``leftovers``."""
    return terms_found(pages.select("text"), terms.select("term"))


def search_marks(docs: DataFrame, term: str) -> DataFrame:
    """doc_id, start, end, value of the non-overlapping occurrences of a term, case ignored."""
    quoted = "(?i)" + re.sub(r"([^0-9A-Za-z ])", r"\\\1", term)
    found = docs.where(F.contains(F.lower("text"), F.lit(term.lower()))).select("doc_id", F.explode(all_matches(F.col("text"), quoted)).alias("m"))
    return found.select("doc_id", "m.start", (F.col("m.start") + F.length("m.value")).alias("end"), "m.value")


def match_rectangles(items: DataFrame, enabled: set[str] | None = None, custom: list[str] = ()) -> DataFrame:
    """doc_id, page_number, item_id, type, value, rect: the rectangle of every match in text items
    (doc_id, page_number, item_id, text, e, f, width, size)."""
    found = items.select("*", F.explode(pii_spans(F.col("text"), enabled, custom)).alias("_m"))
    box = match_rect(*[F.col(c) for c in ("e", "f", "width", "size", "text")], F.col("_m.start"), F.col("_m.end"))
    return found.select("doc_id", "page_number", "item_id", "_m.type", "_m.value", box.alias("rect"))


def rectangles_by_page(rectangles: DataFrame) -> DataFrame:
    """doc_id, page_number, n, area, rects of the marked rectangles of each page (rects in order of place)."""
    area = F.sum(F.col("rect.width") * F.col("rect.height"))
    return rectangles.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), area.alias("area"), F.sort_array(F.collect_list("rect")).alias("rects"))
