from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.sources import delimited


def brute_rows(source, delimiter):
    """One character after the other."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i <= len(source):
        c = source[i : i + 1]
        if quoted:
            if source[i : i + 2] == '""':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            elif not c:
                return rows
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c == delimiter:
            row, cell = [*row, cell], ""
        elif c in ("\n", "\r", ""):
            row, cell = [*row, cell], ""
            rows += [row] if any(row) else []
            row = []
        else:
            cell += c
        i += 1
    return rows


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(['"', '""', ",", "\n", "\r\n", "a", "bé", "日本 ", ";", "x" * 30, '","'], weights=[3, 2, 3, 2, 1, 3, 2, 1, 1, 1, 1], k=r.choice([0, 1, 5, 30, 120]))) for _ in range(n)]


def read(rows):
    out = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (str(r["doc_id"]), r["text"], r["row"])):
        out[r["doc_id"], r["text"]].append(r["cells"])
        assert r["row"] == len(out[r["doc_id"], r["text"]]) - 1
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_rows_at_any_cut(spark, size, monkeypatch):
    monkeypatch.setattr(delimited, "BLOCK", 3)
    monkeypatch.setattr(delimited, "BUCKET", 4)
    sources = texts(size, 40)
    out = read(delimited.csv_rows(spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string"), ",", size))
    assert {k: v for (k, _), v in out.items()} == {i: rows for i, s in enumerate(sources) if (rows := brute_rows(s, ","))}


def test_known_texts(spark):
    cases = {
        "quoted": ('name;note\n"Ada; L.";"two\nlines"\n"say ""hi""";x', [["name", "note"], ["Ada; L.", "two\nlines"], ['say "hi"', "x"]]),
        "open": ('a;b\n"never closed;c\nd', [["a", "b"]]), "late quote": ('a"b;c\n""d";e', [['a"b', "c"], ['d"', "e"]]), "blank": ("\n;\n\r\n;x", [["", "x"]]), "empty": ("", []),
    }
    out = read(delimited.csv_rows(spark.createDataFrame([(k, s) for k, (s, _) in cases.items()] + [("null", None)], "doc_id string, source string"), ";"))
    assert {k: v for (k, _), v in out.items()} == {k: rows for k, (_, rows) in cases.items() if rows}


def test_texts_without_names_stay_apart(spark):
    t = spark.createDataFrame([(None, "a,b\nc,d"), (None, "e,f"), (1, "g,h"), (1, "g,h")], "doc_id long, source string")
    assert sorted(read(delimited.csv_rows(t)).values()) == [[["a", "b"], ["c", "d"]], [["e", "f"]], [["g", "h"]], [["g", "h"]]]


@pytest.mark.parametrize("delimiter", ["^", "]", "\\", "-", "&", "|"])
def test_any_delimiter(spark, delimiter):
    s = f'a{delimiter}"b{delimiter}"\n{delimiter}c'
    (rows,) = read(delimited.csv_rows(spark.createDataFrame([(1, s)], "doc_id long, source string"), delimiter, 3)).values()
    assert rows == [["a", f"b{delimiter}"], ["", "c"]]


def test_delimiters(spark):
    cases = {"a;b\nc;d": ";", "a\tb": "\t", "x|y,z|w\nx|y|z": "|", "plain": ",", "": ",", 'a;"b,c,d\n': ",", '"a;b";c\n"d;e";f': ";", "a,b;c": ","}
    got = spark.createDataFrame([(s,) for s in cases], "s string").select("s", delimited.detected_delimiter(F.col("s")).alias("d")).collect()
    assert {r["s"]: r["d"] for r in got} == cases


def test_sections(spark):
    wide = "\n".join(",".join(f"{r}.{c}" for c in range(n)) for r, n in enumerate((22, 3, 45)))
    rows = delimited.csv_rows(spark.createDataFrame([(1, wide), (2, "a,b")], "doc_id long, source string"), ",")
    report = {r["n_rows"]: r for r in delimited.csv_report(rows).collect()}
    assert (report[3]["widest"], report[3]["sections"], len(report[3]["warnings"])) == (45, 4, 2) and (report[1]["sections"], report[1]["warnings"]) == (1, [])
    cut = {(r["doc_id"], r["section"], r["row"]): r["cells"] for r in delimited.csv_sections(rows).collect()}
    assert len(cut) == 13 and cut[1, 2, 0] == ["0.20", "0.21", *[""] * 8] and cut[1, 0, 1][:4] == ["1.0", "1.1", "1.2", ""] and cut[1, 3, 2][-1] == "2.39" and cut[2, 0, 0] == ["a", "b"]


def test_a_large_text_is_read_in_many_tasks(spark):
    n = 300_000
    line = F.concat_ws(",", F.col("id").cast("string"), F.concat(F.lit('"cell, with ""quotes""\n'), F.col("id").cast("string"), F.lit('"')), F.repeat(F.lit("é"), (F.col("id") % 13).cast("int")))
    text = spark.range(n).coalesce(1).agg(F.array_join(F.sort_array(F.collect_list(F.struct("id", line.alias("l")))).getField("l"), "\n").alias("source")).withColumn("doc_id", F.lit(1))
    rows = delimited.csv_rows(text, ",", 1 << 15)
    wanted = F.concat(F.lit('cell, with "quotes"\n'), F.col("cells")[0])
    row = rows.agg(F.count("*").alias("n"), F.sum("row").alias("s"), F.sum(((F.size("cells") == 3) & (F.col("cells")[0] == F.col("row").cast("string")) & (F.col("cells")[1] == wanted)).cast("long")).alias("ok")).first()
    assert (row["n"], row["s"], row["ok"]) == (n, n * (n - 1) // 2, n)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan


def test_texts_of_one_chunk_are_read_in_their_rows(spark):
    """Short texts are neither sent nor written; beside a long one they keep their rows and numbers of their own."""
    short = spark.createDataFrame([(1, 'a,"b\nc"\n\nd'), (2, 'x\n"open'), (2, "y,\r\n,"), (3, ",\n")], "doc_id long, source string")
    rows = delimited.csv_rows(short, ",")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(read(rows).values()) == [[["a", "b\nc"], ["d"]], [["x"]], [["y", ""]]]
    both = read(delimited.csv_rows(short.unionByName(spark.createDataFrame([(4, "l,m\n" * 20)], short.schema)), ",", 16))
    assert len(both) == 4 and sorted(both.values())[1] == [["l", "m"]] * 20
