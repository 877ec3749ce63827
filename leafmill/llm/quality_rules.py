r"""Quality rules: a table of thresholds compiled into one Spark projection.

Words are ``[^\x20\x09-\x0D]+``. The measures of a text are computed once in one
projection; each rule names a measure and the range it must lie in. No user function and
no shuffle is involved.

Defined cases: a null text has no words and fails; an empty text likewise; ratios over no
words or lines are 0; each row stands for itself, so repeated rows and ties need no care;
an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "it", "for", "with", "as", "on", "be", "at", "by", "this",
    "der", "die", "das", "und", "zu", "den", "mit", "von", "ist", "des", "im", "dem", "nicht", "ein", "eine",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "dans", "pour", "par", "sur", "est", "pas",
    "el", "los", "las", "y", "en", "una", "por", "con", "para", "del", "se", "no", "al",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; an open end is None."""

    measure: str
    low: float | None
    high: float | None


#: The verdict beyond the base: every row must hold for a text that the base keeps.
RULES = (
    Rule("mean_word_length", 2.0, 20.0),
    Rule("symbol_word_ratio", None, 0.3),
    Rule("bang_word_ratio", None, 0.3),
    Rule("upper_letter_ratio", None, 0.6),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    The windows' digests are sorted with their places; equal neighbours are repeats. Their
    places, sorted, cover min(3, distance to the next) words each."""

    def cover(at: Column) -> Column:
        ahead = lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3))
        return F.aggregate(F.transform(at, ahead), F.lit(0), lambda a, n: a + n)

    def places(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return let(F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])), cover)

    def windows(w: Column) -> Column:
        digest = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), digest)

    def found(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), places))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), found)))


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""

    def from_words(w: Column, t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def from_lines(ls: Column) -> Column:
            n, n_lines = F.size(w), F.size(ls)
            chars = F.length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]"))
            repeated = n_lines - F.size(F.array_distinct(ls))
            ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
            letters = F.regexp_count(t, F.lit(r"\p{L}"))
            return F.struct(
                n.cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                repeated.cast("long").alias("n_dup_lines"),
                _repeat_words(w).cast("long").alias("n_repeat_words"),
                ratio(chars, n).alias("mean_word_length"),
                ratio(F.regexp_count(t, F.lit(r"[#*$%&|<>]+")), n).alias("symbol_word_ratio"),
                ratio(F.regexp_count(t, F.lit(r"!+")), n).alias("bang_word_ratio"),
                ratio(F.regexp_count(t, F.lit(r"\p{Lu}")), letters).alias("upper_letter_ratio"),
                ratio(F.size(F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(*STOP_WORDS))), n).alias("stop_word_ratio"),
                ratio(repeated, n_lines).alias("duplicate_line_ratio"),
                ratio(F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…) *$"))), n_lines).alias("ellipsis_line_ratio"),
                ratio(F.size(F.filter(ls, lambda x: x.rlike(r"^[ \t]*[-*•‣]"))), n_lines).alias("bullet_line_ratio"),
            )

        return let(lines, from_lines)

    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: from_words(w, t)))


def compiled(rules: tuple[Rule, ...], measured: Column) -> Column:
    """The table of thresholds as one boolean expression."""
    parts = []
    for r in rules:
        if r.low is not None:
            parts.append(measured[r.measure] >= F.lit(r.low))
        if r.high is not None:
            parts.append(measured[r.measure] <= F.lit(r.high))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` as the struct ``_doc`` with ``m`` (measures), ``base_failed`` and ``kept``."""
    m = docs.select(F.struct("*").alias("_doc"), measures(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    m = m.withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & compiled(rules, F.col("m")))


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, rules).select("_doc.doc_id", *[F.col(f"m.{c}").alias(c) for c in counts], "base_failed", "kept")


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judged(docs, rules).where("kept").select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
