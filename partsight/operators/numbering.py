"""Exact per-key windows that do not put a whole key into one task.

A plain window sorts all rows of a key in one task. Here a key is first cut into order-preserving
buckets (an hour of its time line, a thousand of its ids). Totals per (key, bucket) are tiny and are
accumulated over the buckets; the rows themselves are only sorted within (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def hour_of(ts: str, seconds: int = 3600) -> Column:
    """Order-preserving bucket of a timestamp column."""
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("bigint")


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def with_bucket(rows: DataFrame, bucket: Column) -> DataFrame:
    return rows.withColumn(_BUCKET, bucket)


def number_rows(
    rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "n"
) -> DataFrame:
    """``row_number()`` over ``keys`` by ``order``; ``bucket`` must not decrease along ``order``."""
    cut = with_bucket(rows, bucket)
    base = (
        cut.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__base", F.coalesce(F.sum("__n").over(_before(keys)), F.lit(0)))
        .drop("__n")
    )
    local = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return (
        cut.join(base, [*keys, _BUCKET])
        .withColumn(name, F.row_number().over(local) + F.col("__base"))
        .drop("__base", _BUCKET)
    )


def trailing_count(
    rows: DataFrame, keys: list[str], ts: str, seconds: int, name: str = "in_window"
) -> DataFrame:
    """Rows of the same key in the ``seconds`` up to and including each row.

    Every row goes into its own bucket of ``seconds`` and, as context, into the next one, so a
    range window within (key, bucket) sees all it needs.
    """
    own = hour_of(ts, seconds)
    twice = rows.withColumn(
        _BUCKET, F.explode(F.array(own, own + 1))
    ).withColumn("__own", F.col(_BUCKET) == own)
    w = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(F.unix_micros(ts))
        .rangeBetween(-(seconds * 1_000_000 - 1), 0)
    )
    return (
        twice.withColumn(name, F.count(F.lit(1)).over(w)).where("__own").drop("__own", _BUCKET)
    )


def last_at_or_before(
    asks: DataFrame, offers: DataFrame, keys: list[str], at: str, value: str, seconds: int = 86_400
) -> DataFrame:
    """``asks`` with the ``value`` of the last of the ``offers`` (keys, at, value) at or before ``at``; asks
    without one are left out. Of offers at one time the largest value counts.

    The last offer of each bucket is carried over the buckets that follow; rows meet only within one.
    """
    held = [c for c in asks.columns if c not in (*keys, at)]
    rows = with_bucket(
        asks.select(*keys, at, F.struct(*held).alias("__ask")).unionByName(
            offers.select(*keys, at, F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("__offer")), allowMissingColumns=True
        ),
        hour_of(at, seconds),
    )
    carried = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.max("__offer").alias("__last"))
        .withColumn("__carried", F.last("__last", ignorenulls=True).over(_before(keys)))
        .drop("__last")
    )
    local = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(at, F.col("__ask").isNotNull(), "__offer")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = rows.withColumn("__here", F.last("__offer", ignorenulls=True).over(local)).where("__ask IS NOT NULL")
    return (
        found.join(carried, [*keys, _BUCKET])
        .withColumn("__found", F.coalesce("__here", "__carried"))
        .where("__found IS NOT NULL")
        .select(*keys, at, "__ask.*", F.col("__found.value").alias(value))
    )
