"""Joins of sides that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` as a join side that is never broadcast.

    Spark guesses the size of a derived table from its compressed files, and knows neither what
    ``explode`` adds nor how far rows unpack: millions of them pass for a few megabytes, and a broadcast
    gathers them on the driver.
    """
    return rows.hint("merge")
