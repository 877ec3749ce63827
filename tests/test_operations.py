from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from leafmill.functions import guards as G
from leafmill.plans import operations as O


def docs(spark):
    return spark.createDataFrame([(1, "mail a@b.io"), (2, None)], "doc_id long, text string")


def test_an_operation_runs(spark, tmp_path):
    out = O.run_operation("find-pii", docs(spark), str(tmp_path / "a"))
    assert out.rows == 1 and out.data.first()["value"] == "a@b.io" and out.seconds > 0
    assert O.estimate(docs(spark)) == {"documents": 2, "characters": 11, "longest": 11}
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


@pytest.mark.parametrize(("name", "options", "code"), [("none", {}, "INVALID_INPUT"), ("paginate", {"most_chars": 0}, "INVALID_INPUT"), ("find-pii", {"custom": ["("]}, "INVALID_INPUT"), ("find-pii", {"unknown": 1}, "UNKNOWN")])
def test_errors_have_codes(spark, tmp_path, name, options, code):
    with pytest.raises(O.OperationError) as e:
        O.run_operation(name, docs(spark), str(tmp_path / "b"), options)
    assert e.value.code == code


def test_columns_cancel_and_timeout(spark, tmp_path):
    with pytest.raises(O.OperationError, match="no column text"):
        O.run_operation("redact", docs(spark).drop("text"), str(tmp_path / "c"))
    stop = threading.Event()
    stop.set()
    with pytest.raises(O.OperationError, match="CANCELLED"):
        O.run_operation("redact", docs(spark), str(tmp_path / "c"), cancel=stop)
    # Tasks end between rows, so many rows of a moderate size.
    slow = spark.range(2_000_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("1111 "), 20), F.col("id").cast("string")).alias("text"))
    with pytest.raises(O.OperationError) as e:
        O.run_operation("find-pii", slow, str(tmp_path / "d"), timeout=0.5)
    assert e.value.code == "TIMEOUT"
    assert [O.mapped_error(ValueError(m)).code for m in ("MEMORY_LIMIT: x", "file is encrypted", "?")] == ["MEMORY_LIMIT", "ENCRYPTED_PDF", "UNKNOWN"]


def test_progress_only_grows(spark, tmp_path):
    seen = []
    many = spark.range(400_000, numPartitions=12).select(F.col("id").alias("doc_id"), F.concat(F.lit("1111 a@b.io "), F.col("id").cast("string")).alias("text"))
    out = O.run_operation("find-pii", many, str(tmp_path / "p"), progress=seen.append)
    assert out.rows == 400_000 and seen and seen[-1].done == seen[-1].total >= 12 and {p.operation for p in seen} == {"find-pii"}
    assert all(a.done <= b.done and a.total <= b.total for a, b in zip(seen, seen[1:], strict=False))


def test_paths_groups_and_unforeseen_errors(spark, tmp_path):
    context = spark.sparkContext
    context.setJobGroup("mine", "my work")
    O.run_operation("sha256", docs(spark), str(tmp_path / "q"))
    assert context.getLocalProperty("spark.jobGroup.id") == "mine" and context.getLocalProperty("spark.job.description") == "my work"
    for k in O.KEPT_PROPERTIES:
        context.setLocalProperty(k, None)
    with pytest.raises(O.OperationError):
        O.run_operation("sha256", docs(spark), str(tmp_path / "q"))
    assert O.run_operation("sha256", docs(spark), str(tmp_path / "q"), overwrite=True).rows == 2
    broken = O.Operation("broken", lambda d: {}["no key"])
    O.OPERATIONS["broken"] = broken
    with pytest.raises(O.OperationError, match="UNKNOWN"):
        O.run_operation("broken", docs(spark), str(tmp_path / "r"))
    del O.OPERATIONS["broken"]


def test_a_chain_is_one_group(spark, tmp_path):
    files = spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "doc_id long, page long")
    order = spark.createDataFrame([(8, 0), (7, 1)], "doc_id long, place long")
    turned = spark.createDataFrame([(0, 0, 3, 90), (0, 1, 1, 0), (0, 2, 1, 0)], "doc_id long, out_idx int, src_idx long, rotate_delta int")
    steps = [("merge", {"order": order}), ("organize", {"descriptors": turned}), ("page-numbers", {"start": 5})]
    out = O.run_chain(steps, files, str(tmp_path / "chain"))
    assert sorted((r["page"], r["label"]) for r in out.data.collect()) == [(1, "5 / 3"), (2, "6 / 3"), (3, "7 / 3")]
    for bad, why in (([*steps, ("redact", {})], "no column text for redact"), ([("organize", {})], "descriptors must be given"), ([("find-pii", {}), ("redact", {})], "nothing can follow"), ([], "no operation"), ([("split", {"span": 0})], "span must be at least 1")):
        with pytest.raises(O.OperationError, match=why):
            O.run_chain(bad, files, str(tmp_path / "none"))


def test_every_operation_names_what_it_gives(spark):
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 90)], "doc_id long, page long, rotation int")
    d = spark.createDataFrame([(1, "a b@c.io\n\n- x", "a,b", 3)], "doc_id long, text string, source string, page_count int")
    log = spark.createDataFrame([(1, 0, "reset", None, None, None, None)], "doc_id long, seq int, command string, keys array<int>, delta int, source int, target int")
    moved = spark.createDataFrame([(1, 0, 2, 90)], "doc_id long, out_idx int, src_idx long, rotate_delta int")
    options = {"search": {"term": "a"}, "verify-redactions": {"marked": spark.createDataFrame([("b@c",)], "term string")}, "merge": {"order": p.select("doc_id", F.lit(0).alias("place"))}, "organize": {"descriptors": moved}, "split": {"span": 1}, "edit-log": {"log": log}}
    for o in O.OPERATIONS.values():
        if o.gives:
            out = o.apply(d if "page" not in o.needs else p, **options.get(o.name, {}))
            assert set(out.columns) >= set(o.gives), o.name
            out.collect()


def test_guards_end_a_job_before_it_writes(spark, tmp_path):
    regions = spark.createDataFrame([(1, 1, "r"), (1, 2, "s"), (2, 1, "t")], "doc_id long, page_number int, region string")
    rasters = spark.createDataFrame([(1, 1, "A"), (1, 1, "B"), (1, 2, "C"), (2, 1, "D")], "doc_id long, page_number int, raster string")
    d = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert sorted((r["region"], r["raster"]) for r in G.redaction_plan(d, regions, rasters).collect()) == [("r", "A"), ("s", "C"), ("t", "D")]
    redact = O.Operation("redaction-plan", lambda x, regions, rasters: G.redaction_plan(x, regions, rasters), ("doc_id",))
    O.OPERATIONS[redact.name] = redact
    three = d.unionByName(spark.createDataFrame([(3,)], "doc_id long"))
    for k, (docs_, r, why) in enumerate(((d, rasters.where("page_number = 1"), "INVALID_INPUT: page 2 is missing its rendered image"), (three, rasters, "INVALID_INPUT: mark at least one area to redact"))):
        with pytest.raises(O.OperationError) as e:
            O.run_operation(redact.name, docs_, str(tmp_path / f"guarded{k}"), {"regions": regions, "rasters": r})
        assert str(e.value) == why and not list(tmp_path.glob("guarded*/part-*"))
    del O.OPERATIONS[redact.name]
    n = spark.createDataFrame([(3,), (0,)], "n int")
    assert n.where("n = 3").select(G.page_count(F.col("n"))).first()[0] == 3
    for bad in (n, spark.createDataFrame([(None,)], "n int")):
        with pytest.raises(Exception) as e:
            bad.select(G.page_count(F.col("n"))).collect()
        assert (O.mapped_error(e.value).code, O.mapped_error(e.value).args[0]) == ("FILE_CORRUPT", "FILE_CORRUPT: the document has no pages")
