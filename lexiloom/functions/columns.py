"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be sent to every task.
SMALL = 1_000_000


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def small(table: DataFrame, rows: int = SMALL) -> DataFrame:
    """The table marked for broadcast, if it has so few rows; else as it is, to be joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
