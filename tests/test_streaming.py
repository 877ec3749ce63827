from __future__ import annotations

import datetime as dt

from leafmill.streaming import events


def test_windowed_stream_equals_the_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), f"t{i % 2}", float(i)) for i in range(30)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in"), schema))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["window_start"], r["event_type"], r["n"], r["total"])
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, events.windowed_counts(table).collect()))


def test_a_sink_that_stops_between_write_and_commit(spark, tmp_path):
    rows = [(i, f"t{i % 2}") for i in range(20)]
    spark.createDataFrame(rows, "event_id long, event_type string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: events.event_stream(spark, str(tmp_path / "in"), "event_id long, event_type string", 1)
    calls, folders = [], events.batch_folders(str(tmp_path / "out"))

    def stops_once(batch, batch_id):
        folders(batch, batch_id)
        calls.append(batch_id)
        if calls == [0, 1]:
            raise RuntimeError("stopped after the write of batch 1")

    checkpoint = str(tmp_path / "checkpoint")
    q = events.to_sink(stream(), stops_once, checkpoint)
    try:
        q.awaitTermination()
        raise AssertionError("the first run must stop")
    except Exception as e:
        assert "stopped after the write" in str(e)
    events.to_sink(stream(), stops_once, checkpoint).awaitTermination()
    assert calls[:3] == [0, 1, 1] and len(calls) == len(set(calls)) + 1
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "event_type")
    assert sorted(map(tuple, got.collect())) == rows
    # A batch that was recorded but whose commit was lost is not written again.
    (last := sorted((tmp_path / "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]).unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    n = len(calls)
    events.to_sink(stream(), stops_once, checkpoint).awaitTermination()
    assert len(calls) == n
