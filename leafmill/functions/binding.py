"""Binding a value inside one Spark expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a lambda, a column that the optimizer inlines is computed anew for each element;
    a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
