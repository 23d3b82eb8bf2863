"""Shared column helpers of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(x: Column | str, scale: float = 1e6) -> Column:
    """A double as a whole number of 1/scale, the same in every engine."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)).cast("long")


def place() -> list[Column]:
    """The place of a row of a table as read: its file, by name, and its number in it."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
