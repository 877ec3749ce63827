"""Edits of a grid of pages from a log of commands, with undo and redo.

log: doc_id, seq, command, keys (array<int>, the pages selected), delta (degrees), source and target (places from 0); what a
command has no use for is null. Commands are rotate, delete, duplicate, move, reset, undo and redo.

Pages have keys: at first their places, and every page that a command makes gets the next free number, in order of
place. Rotating nothing selected turns all pages; deleting or doubling nothing selected, moving from or to a place
that is not there, undoing at the start, redoing without an undo before it and unknown commands change nothing. Every other command
can be undone and ends what could be redone. A document's log is a fold, whose state is its pages and both stacks; documents
are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = "struct<key:int,src_idx:int,rotation:int>"


def _page(key: Column, src_idx: Column, rotation: Column) -> Column:
    return F.struct(key.cast("int").alias("key"), src_idx.cast("int").alias("src_idx"), rotation.cast("int").alias("rotation"))


def _fresh(n: Column, first: Column) -> Column:
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: _page(first + i, i, F.lit(0)))


def _moved(pages: Column, source: Column, target: Column) -> Column:
    rest = F.concat(F.slice(pages, F.lit(1), source), F.slice(pages, source + 2, F.size(pages)))
    return F.concat(F.slice(rest, F.lit(1), target), F.slice(pages, source + 1, F.lit(1)), F.slice(rest, target + 1, F.size(pages)))


def _without_last(stack: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))


def _step(n: Column, a: Column, c: Column) -> Column:
    pages, undo, redo, command = a["pages"], a["undo"], a["redo"], c["command"]
    keys = F.coalesce(c["keys"], F.array().cast("array<int>"))
    inside = lambda at: (at >= 0) & (at < F.size(pages))
    some = F.size(keys) > 0
    chosen = F.transform(F.filter(pages, lambda p: F.array_contains(keys, p["key"])), lambda p: p["key"])
    turned = F.transform(pages, lambda p: F.when(~some | F.array_contains(keys, p["key"]), _page(p["key"], p["src_idx"], F.pmod(p["rotation"] + F.coalesce(c["delta"], F.lit(0)), F.lit(360)))).otherwise(p))
    doubled = F.flatten(F.transform(pages, lambda p: F.when(F.array_contains(keys, p["key"]), F.array(p, _page(a["next"] + F.array_position(chosen, p["key"]) - 1, p["src_idx"], p["rotation"]))).otherwise(F.array(p))))
    edited = (
        F.when(command == "rotate", turned).when((command == "delete") & some, F.filter(pages, lambda p: ~F.array_contains(keys, p["key"]))).when((command == "duplicate") & some, doubled)
        .when((command == "move") & inside(c["source"]) & inside(c["target"]), _moved(pages, c["source"], c["target"])).when(command == "reset", _fresh(n, a["next"]))
    )
    made = F.when((command == "duplicate") & some, F.size(chosen)).when(command == "reset", n).otherwise(0)
    back, forth = (command == "undo") & (F.size(undo) > 0), (command == "redo") & (F.size(redo) > 0)

    def after(e: Column) -> Column:
        none = F.array().cast(f"array<array<{PAGE}>>")
        return F.struct(
            F.when(back, F.element_at(undo, -1)).when(forth, F.element_at(redo, -1)).otherwise(F.coalesce(e, pages)).alias("pages"),
            F.when(back, _without_last(undo)).when(forth | e.isNotNull(), F.array_append(undo, pages)).otherwise(undo).alias("undo"),
            F.when(back, F.array_append(redo, pages)).when(forth, _without_last(redo)).when(e.isNotNull(), none).otherwise(redo).alias("redo"), (a["next"] + made).cast("int").alias("next"),
        )

    return F.get(F.transform(F.array(edited), after), F.lit(0))


def edited_states(log: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, pages (array of key, src_idx, rotation), undo_depth, redo_depth of every document of
    ``counts`` (doc_id, page_count) after its log; a log without a document is left out."""
    entry = F.struct("seq", "command", F.col("keys").cast("array<int>").alias("keys"), *[F.col(c).cast("int").alias(c) for c in ("delta", "source", "target")])
    logs = log.where("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("log"))
    d = counts.select("doc_id", F.greatest(F.coalesce(F.col("page_count").cast("int"), F.lit(0)), F.lit(0)).alias("n")).join(logs, "doc_id", "left")
    none = F.array().cast(f"array<array<{PAGE}>>")
    zero = F.struct(_fresh(F.col("n"), F.lit(0)).alias("pages"), none.alias("undo"), none.alias("redo"), F.col("n").alias("next"))
    end = F.when(F.col("log").isNull(), zero).otherwise(F.aggregate("log", zero, lambda a, c: _step(F.col("n"), a, c)))
    return d.select("doc_id", end.alias("e")).select("doc_id", "e.pages", F.size("e.undo").alias("undo_depth"), F.size("e.redo").alias("redo_depth"))


def edited_pages(log: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, out_idx (from 0), src_idx, rotate_delta, key: the descriptors of the pages after the log."""
    s = edited_states(log, counts).select("doc_id", F.posexplode("pages").alias("out_idx", "p"))
    return s.select("doc_id", "out_idx", "p.src_idx", F.col("p.rotation").alias("rotate_delta"), "p.key")
