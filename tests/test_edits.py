from __future__ import annotations

import random

from leafmill.operators import edits

SCHEMA = "doc_id long, seq int, command string, keys array<int>, delta int, source int, target int"


def plain(n, log):
    """The same edits in a plain loop."""
    pages, undo, redo, free = [(i, i, 0) for i in range(n)], [], [], n
    for _, command, keys, delta, source, target in log:
        keys, new = keys or [], None
        if command == "rotate":
            new = [(k, s, (r + (delta or 0)) % 360) if not keys or k in keys else (k, s, r) for k, s, r in pages]
        elif command == "delete" and keys:
            new = [p for p in pages if p[0] not in keys]
        elif command == "duplicate" and keys:
            new = []
            for k, s, r in pages:
                new.append((k, s, r))
                if k in keys:
                    new.append((free, s, r))
                    free += 1
        elif command == "move" and source is not None and target is not None and 0 <= source < len(pages) and 0 <= target < len(pages):
            new = list(pages)
            new.insert(target, new.pop(source))
        elif command == "reset":
            new = [(free + i, i, 0) for i in range(n)]
            free += n
        elif command == "undo" and undo:
            redo.append(pages)
            pages = undo.pop()
        elif command == "redo" and redo:
            undo.append(pages)
            pages = redo.pop()
        if new is not None:
            undo.append(pages)
            redo, pages = [], new
    return pages, len(undo), len(redo)


def test_any_log_ends_as_a_plain_loop(spark):
    r = random.Random(4)
    logs, counts = {}, {}
    for d in range(60):
        counts[d] = r.choice([0, 1, 2, 5, 9])
        logs[d] = []
        for seq in range(r.choice([0, 1, 5, 40])):
            command = r.choice(["rotate", "delete", "duplicate", "duplicate", "move", "move", "reset", "undo", "undo", "redo", "redo", "what"])
            keys = r.choice([None, [], [r.randrange(12)], r.sample(range(12), 3)])
            logs[d].append((seq, command, keys, r.choice([None, 90, -90, 450]), r.choice([None, -1, 0, 1, 3]), r.choice([None, 0, 1, 4])))
    rows = [(d, *c) for d, log in logs.items() for c in log]
    r.shuffle(rows)
    table = spark.createDataFrame([*rows, (99, 0, "reset", None, None, None, None), (None, 0, "reset", None, None, None, None)], SCHEMA)
    known = spark.createDataFrame([*counts.items(), (100, None)], "doc_id long, page_count int")
    got = {x["doc_id"]: ([tuple(p) for p in x["pages"]], x["undo_depth"], x["redo_depth"]) for x in edits.edited_states(table, known).collect()}
    assert got == {d: plain(n, logs[d]) for d, n in counts.items()} | {100: ([], 0, 0)}
    places = sorted((x["doc_id"], x["out_idx"], x["src_idx"], x["rotate_delta"], x["key"]) for x in edits.edited_pages(table, known).collect())
    assert places == sorted((d, i, s, t, k) for d, (pages, *_) in got.items() for i, (k, s, t) in enumerate(pages))


def test_moves_and_undo(spark):
    log = spark.createDataFrame([(1, 0, "move", None, None, 0, 2), (1, 1, "rotate", [1], -90, None, None), (1, 2, "undo", None, None, None, None)], SCHEMA)
    one = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    assert [(r["src_idx"], r["rotate_delta"]) for r in edits.edited_pages(log, one).orderBy("out_idx").collect()] == [(1, 0), (2, 0), (0, 0)]
    redone = log.unionByName(spark.createDataFrame([(1, 3, "redo", None, None, None, None)], SCHEMA))
    assert [(r["src_idx"], r["rotate_delta"]) for r in edits.edited_pages(redone, one).orderBy("out_idx").collect()] == [(1, 270), (2, 0), (0, 0)]
