"""Usage events as a stream: allowed keys only, counted by window with late data dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import sanitized


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of events as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window_start, event_type, n, total of a stream or a table of events (ts, event_type, value)."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sanitized_stream(events: DataFrame) -> DataFrame:
    """The events with their JSON properties reduced to the allowed keys."""
    return events.withColumn("p", sanitized(F.from_json("props", "map<string,string>"))).select("event_id", "ts", "event_type", "p.sanitized", "p.dropped_keys")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a folder, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _recorded(spark: SparkSession, path: str, make: bool = False) -> bool:
    """Whether a mark is at ``path``, on any store that Spark reaches; ``make`` sets it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.createNewFile(at) if make else files.exists(at)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own and replaces it if the batch comes again."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands a stream's batches to any sink ``write(batch, batch_id)``.

    A batch that was written is recorded beside the checkpoint, so that it is not written again when it comes again. Between
    writing and recording a stop can still repeat a batch: a sink is exactly-once if writing one id twice is
    writing it once, as in ``batch_folders``."""

    def once(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, f"{checkpoint}/written/{batch_id}"
        if not _recorded(spark, mark):
            write(batch, batch_id)
            _recorded(spark, mark, make=True)

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
