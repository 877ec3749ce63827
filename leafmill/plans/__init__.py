"""The registry of queries over the test tables, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import packaged
from .oracles import ORACLES
from .queries import QUERIES, pii_by_type

PARTS = (packaged,)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by type over all documents."""
    return pii_by_type(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES) | {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | {k: q for p in PARTS for k, q in p.ORACLES.items()}
