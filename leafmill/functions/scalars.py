"""Scalar rules over bytes, pages, names, dates and checksums, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

MIB = 1024 * 1024
#: The characters that trimming takes away, and the same for patterns.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The upper ends of the buckets and their names.
SIZE_ENDS = ((MIB, "<1MB"), (10 * MIB, "1-10MB"), (50 * MIB, "10-50MB"), (100 * MIB, "50-100MB"))
PAGE_ENDS = ((1, "1"), (10, "2-10"), (50, "11-50"), (200, "51-200"))
DURATION_ENDS = ((1000, "<1s"), (5000, "1-5s"), (15000, "5-15s"), (60000, "15-60s"))

#: The multiplication and permutation tables of the dihedral check digit.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7),
    (4, 0, 1, 2, 3, 9, 5, 6, 7, 8), (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3),
    (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)


def strip_space(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def _bucket(value: Column, ends: tuple, last: str, closed: bool) -> Column:
    out = None
    for end, name in ends:
        test = value <= end if closed else value < end
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def size_bucket(n_bytes: Column) -> Column:
    return _bucket(n_bytes, SIZE_ENDS, ">100MB", False)


def page_count_bucket(pages: Column) -> Column:
    return _bucket(pages, PAGE_ENDS, ">200", True)


def duration_bucket(ms: Column) -> Column:
    return _bucket(ms, DURATION_ENDS, ">60s", False)


def format_bytes(n: Column, decimals: int = 1) -> Column:
    """Bytes with a unit up to GB; whole below 1 KB, "0 B" for what is not positive."""
    parts = F.when(n.isNull() | (n <= 0), F.lit("0 B")).when(n < 1024, F.format_string("%.0f B", n.cast("double")))
    for power, unit in ((1, "KB"), (2, "MB")):
        parts = parts.when(n < 1024 ** (power + 1), F.format_string(f"%.{decimals}f {unit}", n / float(1024**power)))
    return parts.otherwise(F.format_string(f"%.{decimals}f GB", n / float(1024**3)))


def sanitize_filename(name: Column, fallback: str = "document") -> Column:
    """A name without path and control characters, single-spaced, at most 180 long."""
    clean = strip_space(F.regexp_replace(F.regexp_replace(name, r'[/\\?%*:|"<>\x00-\x1f]', ""), BLANK + "+", " "))
    return F.when(F.length(clean) > 0, F.substring(clean, 1, 180)).otherwise(F.lit(fallback))


def output_stem(name: Column) -> Column:
    """A file's name without its last extension and outer white space."""
    return strip_space(F.regexp_replace(name, r"\.[^.]+$", ""))


def named_output(stems: Column, n: Column, extension: str, suffix: str | None = None) -> Column:
    """One name for ``n`` inputs of which ``stems`` are the first: up to three joined, else the first and a count."""
    many = F.concat(F.get(stems, F.lit(0)), F.lit("+"), (n - 1).cast("string"), F.lit("-more"))
    stem = F.when(n == 0, F.lit("document")).when(n <= 3, F.array_join(stems, "+")).otherwise(many)
    tail = F.lit("") if suffix is None else F.concat(F.lit("-"), F.regexp_replace(sanitize_filename(F.lit(suffix)), r"\s+", "-"))
    return F.concat(sanitize_filename(stem), tail, F.lit("." + extension.lstrip(".")))


def suggest_output_name(names: Column, extension: str, suffix: str | None = None) -> Column:
    """One name for a list of inputs."""
    stems = F.filter(F.transform(names, output_stem), lambda n: n != "")
    return let(stems, lambda s: named_output(s, F.size(s), extension, suffix))


def normalize_margin(text: Column) -> Column:
    """Lower case, digits as #, single spaces: what repeated margin lines have in common."""
    return strip_space(F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+", "#"), BLANK + "+", " "))


def squeezed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, BLANK + "+", ""))


def safe_href(href: Column) -> Column:
    """The link if it is http, https or mailto, else null."""
    return F.when(strip_space(href).rlike(r"(?i)^(?:https?:|mailto:)"), strip_space(href))


def needs_ocr(text: Column, force: bool = False) -> Column:
    """True for pages whose text, single-spaced, is shorter than 40 characters."""
    return F.lit(force) | (F.length(strip_space(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", " "))) < 40)


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[\s-]", "")
    return F.coalesce(digits.rlike(r"^[0-9]{13,19}$") & F.call_function("luhn_check", F.when(digits.rlike(r"^[0-9]{13,19}$"), digits)), F.lit(False))


def verhoeff_valid(value: Column) -> Column:
    """Twelve digits whose dihedral checksum is 0."""
    table = lambda rows: F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])
    digits = F.regexp_replace(value, r"[\s-]", "")

    def folded(s: Column) -> Column:
        order = F.sequence(F.lit(0), F.lit(11))
        digit = lambda i: F.substr(s, F.lit(12) - i, F.lit(1)).cast("int")
        step = lambda c, i: F.get(F.get(table(VERHOEFF_D), c), F.get(F.get(table(VERHOEFF_P), i % 8), digit(i)))
        return F.when(s.rlike(r"^[0-9]{12}$"), F.aggregate(order, F.lit(0), step) == 0).otherwise(False)

    return F.coalesce(let(digits, folded), F.lit(False))


def page_label(n: Column, total: Column, style: str) -> Column:
    """``plain``, ``page`` or ``of``: 3, Page 3, 3 / 9."""
    n, total = n.cast("string"), total.cast("string")
    return {"plain": n, "page": F.concat(F.lit("Page "), n), "of": F.concat(n, F.lit(" / "), total)}[style]


def expand_template(template: Column, n: Column, total: Column, date: Column, filename: Column) -> Column:
    """{n}, {total}, {date} and {filename} filled in; the name on one line of at most 120."""
    name = F.substring(F.regexp_replace(F.coalesce(filename, F.lit("document")), r"[\r\n]+", " "), 1, 120)
    out = template
    for token, value in (("{n}", n.cast("string")), ("{total}", total.cast("string")), ("{date}", F.date_format(date, "yyyy-MM-dd")), ("{filename}", name)):
        out = F.replace(out, F.lit(token), value)
    return out


def compact_pages(pages: Column, shown: int = 8) -> Column:
    """The first pages of a list and how many more there are."""
    text = F.array_join(F.slice(pages, 1, shown).cast("array<string>"), ", ")
    more = F.concat(text, F.lit(" and "), (F.size(pages) - shown).cast("string"), F.lit(" more"))
    return F.when(F.size(pages) <= shown, text).otherwise(more)


def audio_timestamp(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on; never negative."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0))), F.lit(0)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws(":", F.when(h < 10, two(h)).otherwise(h.cast("string")), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def excel_date(serial: Column) -> Column:
    """The UTC timestamp of a spreadsheet's day number."""
    return F.timestamp_micros(((serial - 25569) * 86_400_000_000).cast("long"))


def column_index(reference: Column) -> Column:
    """The 0-based column of a cell reference such as AB12."""
    letters = F.upper(F.regexp_extract(reference, r"^([A-Za-z]+)", 1))
    step = lambda a, c: a * 26 + F.ascii(c) - 64
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), step) - 1


def normalize_rotation(degrees: Column) -> Column:
    """0 to 360 with one decimal; within half a degree of 360 it is 0."""
    turned = F.pmod(degrees, F.lit(360.0))
    return F.when(F.lit(360.0) - turned < 0.5, F.lit(0.0)).otherwise(F.floor(turned * 10 + 0.5) / 10)


def sniff_format(content: Column) -> Column:
    """pdf, jpeg, png, webp or null by the first bytes; a PDF's mark may stand in the first 1024."""
    head = F.hex(F.substring(content, 1, 12))
    pdf = F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0
    return (
        F.when(pdf, "pdf").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def output_error(content: Column) -> Column:
    """Why written bytes are no portable document, or null: empty, without its mark at the start, under 100 bytes."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "empty output").when(F.hex(F.substring(content, 1, 5)) != "255044462D", "no document mark at the start").when(size < 100, "output too small")
    )


def column_name(index: Column) -> Column:
    """The letters of a 0-based column up to three letters: A, ..., Z, AA, ..."""
    letter = lambda n: F.char((F.lit(65) + n).cast("long"))
    two, three = F.lit(26), F.lit(26 + 26 * 26)
    last = letter(index % 26)
    return F.when(index < two, last).when(index < three, F.concat(letter(F.floor((index - 26) / 26)), last)).otherwise(
        F.concat(letter(F.floor((index - three) / (26 * 26))), letter(F.floor((index - 26) / 26) % 26), last)
    )


def segment_name(base: Column, start: Column, end: Column) -> Column:
    """The file name of a part of a document: its pages after its name."""
    pages = F.when(start == end, F.concat(F.lit("page-"), start.cast("string"))).otherwise(F.concat(F.lit("pages-"), start.cast("string"), F.lit("-"), end.cast("string")))
    stem = strip_space(F.regexp_replace(base, r"\.[^.]+$", ""))
    return F.concat(sanitize_filename(F.when(stem == "", "document").otherwise(stem)), F.lit("-"), pages, F.lit(".pdf"))


def base_name(name: Column) -> Column:
    """A file's name without its last extension."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("")), F.lit("document"))


def escape_xml(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


#: What a message is matched with, in order, and the code it gets.
ERROR_PATTERNS = (("(?i)encrypted", "ENCRYPTED_PDF"), ("(?i)password", "WRONG_PASSWORD"), ("(?i)quota", "QUOTA_EXCEEDED"))


def error_code(message: Column) -> Column:
    """The code of an error by its message."""
    out = F.when(message.isNull(), "UNKNOWN")
    for pattern, code in ERROR_PATTERNS:
        out = out.when(message.rlike(pattern), code)
    return out.otherwise("UNKNOWN")
