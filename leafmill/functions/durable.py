"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='leafmill-')}"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, a temporary folder if driver and
    executors are one process (tests), else an error: other machines would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


@contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as a job of ours runs; the caller's come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Later jobs start from the files, so a lost executor costs no recomputation of
    what came before and nondeterministic plans are pinned. The shuffle files of the job go
    when it ends; the table stays until ``dropped`` or until the folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/leafmill-{name}-{uuid.uuid4().hex}"
    with session_conf(spark, {SHUFFLE_CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more: call it only when all that was
    made of them is written itself."""
    for t in tables:
        deleted(t.sparkSession, t._written_to)
