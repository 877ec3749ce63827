"""Operations by name, alone or in a chain: checked, estimated, run as a Spark job group that can be watched, cancelled or
timed out.

An operation turns a DataFrame into another one and says which columns it reads and gives, so that a chain is
checked as a whole before a job starts. Running writes the result as Parquet, so
the figures of a run are those of the work done and a result does not depend on later plans.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ERROR_PATTERNS
from ..operators import edits, layout, lines, pages, pii, terms
from ..sources import delimited

#: The codes of errors.
ERROR_CODES = (
    "INVALID_INPUT", "UNSUPPORTED_FILE", "FILE_CORRUPT", "ENCRYPTED_PDF", "PASSWORD_REQUIRED", "WRONG_PASSWORD", "MEMORY_LIMIT", "WORKER_FAILED",
    "WASM_LOAD_FAILED", "OUTPUT_INVALID", "CANCELLED", "TIMEOUT", "STORAGE_UNAVAILABLE", "QUOTA_EXCEEDED", "BROWSER_UNSUPPORTED", "UNKNOWN",
)


class OperationError(Exception):
    """An error with one of ERROR_CODES."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def mapped_error(e: BaseException) -> OperationError:
    """An error as one with a code: its own, the one its message begins with (or that a guard in the plan raised), or one by its message."""
    if isinstance(e, OperationError):
        return e
    said = str(e)
    first = re.search(r"(?:^|\[USER_RAISED_EXCEPTION\] )([A-Z_]+):[ ]*(.*?)(?: SQLSTATE: \w+.*)?$", said, re.MULTILINE)
    if first and first[1] in ERROR_CODES:
        return OperationError(first[1], first[2] if first[0].startswith("[") else said[first.end(1) + 1 :].strip())
    code = next((c for p, c in ERROR_PATTERNS if re.search(p, said)), "UNKNOWN")
    return OperationError(code, said)


@dataclass(frozen=True)
class Operation:
    """``apply`` makes the result; ``validate`` says what is wrong with the options; ``needs`` and ``gives`` are the
    columns that it reads and that its result has (None: not said, so nothing can follow it in a chain)."""

    name: str
    apply: Callable[..., DataFrame]
    needs: tuple[str, ...] = ("doc_id", "text")
    gives: tuple[str, ...] | None = None
    validate: Callable[[dict], list[str]] = lambda options: []


@dataclass
class Outcome:
    """The result, read back, with the seconds that it took and the rows that it has."""

    data: DataFrame
    seconds: float
    rows: int
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Progress:
    """Tasks done of those that are known so far; both only grow."""

    operation: str
    done: int
    total: int


def _at_least(least: int, *names: str) -> Callable[[dict], list[str]]:
    return lambda options: [f"{k} must be at least {least}" for k in names if options.get(k, least) < least]


def _given(*names: str) -> Callable[[dict], list[str]]:
    return lambda options: [f"{k} must be given" for k in names if options.get(k) is None]


def merge_pages(files: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id (0), page, rotation, file, file_page: the pages (doc_id, page) of several documents as one, in the order of
    ``order`` (doc_id, place)."""
    p = pages.merged(files.select(F.col("doc_id").alias("file"), "page").distinct(), order.select(F.col("doc_id").alias("file"), F.col("place").alias("file_ord")))
    return p.select(F.lit(0).cast("long").alias("doc_id"), F.col("out_page").alias("page"), F.lit(0).alias("rotation"), "file", F.col("page").alias("file_page"))


def organize(documents: DataFrame, descriptors: DataFrame) -> DataFrame:
    """doc_id, page (from 1, in the order of the descriptors), rotation, source_page."""
    p = pages.arrange(documents.select("doc_id", "page", "rotation"), descriptors)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("out_idx", "page"))
    return p.select("doc_id", place.alias("page"), "rotation", F.col("page").alias("source_page"))


def split_pages(documents: DataFrame, span: int) -> DataFrame:
    """doc_id, page, part, part_page: the pages in parts of ``span``, each with pages from 1 on."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return documents.select("doc_id", "page", (F.floor(at / span) + 1).alias("part"), (at % span + 1).alias("part_page"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, sha256, bytes of every text."""
    return documents.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.octet_length("text").alias("bytes"))


PAGE = ("doc_id", "page", "rotation")
GLYPHS = ("doc_id", "page_number", "item_id", "text", "x", "y", "width", "height", "font_size", "rotation", "bold", "direction")
OPERATIONS: dict[str, Operation] = {
    o.name: o
    for o in (
        Operation("find-pii", pii.find_pii), Operation("redact", pii.redacted, gives=("doc_id", "text", "n_masked", "found")),
        Operation("paginate", lines.paginated, gives=("doc_id", "page", "line", "text"), validate=_at_least(1, "most_chars", "most_lines")),
        Operation("text-blocks", lines.text_blocks, gives=("doc_id", "block", "kind", "ordered", "n_lines", "text")), Operation("transcript", lines.transcript, gives=("doc_id", "paragraph", "line", "stamp", "text")),
        Operation("ebook", lines.text_ebook, gives=("doc_id", "block", "text")), Operation("sha256", fingerprints, gives=("doc_id", "sha256", "bytes")),
        Operation("search", lambda d, term: pii.search_marks(d, term), gives=("doc_id", "start", "end", "value"), validate=_given("term")),
        Operation("verify-redactions", lambda d, marked: terms.terms_found(d, marked), gives=("term",), validate=_given("marked")),
        Operation("csv-rows", delimited.csv_rows, ("doc_id", "source"), ("doc_id", "text", "row", "cells")),
        Operation("merge", merge_pages, ("doc_id", "page"), (*PAGE, "file", "file_page"), _given("order")), Operation("organize", organize, PAGE, (*PAGE, "source_page"), _given("descriptors")),
        Operation("split", split_pages, ("doc_id", "page"), ("doc_id", "page", "part", "part_page"), lambda o: _given("span")(o) or _at_least(1, "span")(o)),
        Operation("edit-log", lambda d, log: edits.edited_pages(log, d), ("doc_id", "page_count"), ("doc_id", "out_idx", "src_idx", "rotate_delta", "key"), _given("log")),
        Operation("page-numbers", pages.page_labels, ("doc_id", "page"), ("doc_id", "page", "n", "total", "label")),
        Operation("layout-lines", lambda d, page_sizes: layout.reading_order(layout.lines_of(layout.banded(d, page_sizes))), GLYPHS, validate=_given("page_sizes")),
        Operation("layout-tables", lambda d, page_sizes: layout.page_tables(layout.glyph_pages(d, page_sizes)), GLYPHS, validate=_given("page_sizes")),
    )
}


def estimate(documents: DataFrame) -> dict[str, int]:
    """documents, characters and the largest text: what an operation would have to do."""
    n = F.coalesce(F.length("text"), F.lit(0))
    row = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(n), F.lit(0)).alias("characters"), F.coalesce(F.max(n), F.lit(0)).alias("longest")).first()
    return row.asDict()


def _checked(steps: list[tuple[str, dict]], columns: list[str]) -> list[Operation]:
    """The operations of the steps, if each exists, likes its options and finds the columns that it needs."""
    found, wrong, at_hand = [], [], tuple(columns)
    for name, options in steps:
        operation = OPERATIONS.get(name)
        if operation is None:
            raise OperationError("INVALID_INPUT", f"no operation {name!r}")
        if at_hand is None:
            wrong.append(f"nothing can follow {found[-1].name}")
        else:
            wrong += [f"no column {c} for {name}" for c in operation.needs if c not in at_hand]
        wrong += operation.validate(options)
        found.append(operation)
        at_hand = operation.gives
    if wrong or not found:
        raise OperationError("INVALID_INPUT", "; ".join(wrong) or "no operation")
    return found


def _tasks(context: SparkContext, group: str, stages: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Tasks done and known of the group's stages; ``stages`` remembers those that are no longer listed."""
    tracker = context.statusTracker()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            if s := tracker.getStageInfo(stage):
                stages[stage] = (max(s.numCompletedTasks, stages.get(stage, (0, 0))[0]), s.numTasks)
    return sum(d for d, _ in stages.values()), sum(t for _, t in stages.values())


KEPT_PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


def run_chain(
    steps: list[tuple[str, dict]], documents: DataFrame, path: str, timeout: float | None = None, cancel: threading.Event | None = None,
    progress: Callable[[Progress], None] | None = None, overwrite: bool = False,
) -> Outcome:
    """Runs operations (name, options), each on the result of the one before, into ``path``, which must not exist unless ``overwrite``.

    All jobs are one group: ``timeout`` seconds or a set ``cancel`` end them, and ``progress`` is told of their tasks. The
    caller's own job group comes back. Whatever goes wrong is raised as an OperationError."""
    operations = _checked(steps, documents.columns)
    name = " > ".join(o.name for o in operations)
    if cancel is not None and cancel.is_set():
        raise OperationError("CANCELLED", name)
    spark = documents.sparkSession
    context, group, over, why, stages, last = spark.sparkContext, f"{operations[0].name}-{uuid.uuid4().hex}", threading.Event(), [], {}, [None]

    def tell(ended: bool = False) -> None:
        done, total = _tasks(context, group, stages)
        now = Progress(name, total if ended else min(done, total), total)
        if progress is not None and now != last[0]:
            last[0] = now
            progress(now)

    def watch() -> None:
        end = None if timeout is None else time.monotonic() + timeout
        while not over.wait(0.1):
            tell()
            late = end is not None and time.monotonic() > end
            if late or (cancel is not None and cancel.is_set()):
                why.append("TIMEOUT" if late else "CANCELLED")
                # Again and again: a group without a running job, as while a plan is made, cannot be cancelled.
                context.cancelJobGroup(group)

    began = time.monotonic()
    before = {k: context.getLocalProperty(k) for k in KEPT_PROPERTIES}
    watcher = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(group, name, interruptOnCancel=True)
    watcher.start()
    try:
        out = documents
        for operation, (_, options) in zip(operations, steps, strict=True):
            out = operation.apply(out, **options)
        out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
        data = spark.read.parquet(path)
        outcome = Outcome(data, time.monotonic() - began, data.count())
    except Exception as e:
        raise (OperationError(why[0], name) if why else mapped_error(e)) from e
    finally:
        over.set()
        watcher.join()
        for k, v in before.items():
            context.setLocalProperty(k, v)
    tell(ended=True)
    return outcome


def run_operation(name: str, documents: DataFrame, path: str, options: dict | None = None, **settings) -> Outcome:
    """One operation, with the settings of ``run_chain``."""
    return run_chain([(name, options or {})], documents, path, **settings)
