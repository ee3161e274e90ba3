"""an attempt log against rate limits and pauses, in windows that survive hot endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.operators.numbering import hour_of, trailing_count, with_bucket
from partsight.rules import traffic as R


def _limits(attempts: DataFrame) -> DataFrame:
    """Rate (per second) and capacity per endpoint as columns, from the fixed table."""

    def of(position: int, other: float) -> Column:
        pairs = [F.lit(x) for name, lim in R.RATE_LIMITS.items() for x in (name, float(lim[position]))]
        return F.coalesce(F.create_map(*pairs)[F.col("endpoint")], F.lit(other))

    return attempts.withColumns({"rate": of(0, 30.0) / 60, "capacity": of(1, 2.0)})


def with_pauses(attempts: DataFrame, *, bucket_seconds: int = 3600) -> DataFrame:
    """Adds ``paused``: an earlier attempt of the endpoint was answered 429, and its pause still holds.

    Input: ``attempt_id, endpoint, started_at, status, retry_after_s``. The end of the longest pause so far
    is a running maximum: within a time bucket by a window, over the buckets before it by their maxima.
    """
    pause = F.coalesce("retry_after_s", F.lit(float(R.DEFAULT_429_COOLDOWN_S)))
    at = F.unix_micros("started_at")
    ends = F.when(F.col("status") == 429, at + (pause * 1_000_000).cast("long"))
    rows = with_bucket(attempts.withColumns({"__at": at, "__ends": ends}), hour_of("started_at", bucket_seconds))
    key = ["endpoint", "__bucket"]
    before = Window.partitionBy("endpoint").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*key).agg(F.max("__ends").alias("__last")).withColumn("__carried", F.max("__last").over(before)).drop("__last")
    within = Window.partitionBy(*key).orderBy("__at", "attempt_id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.greatest("__carried", "__here")
    return (
        rows.withColumn("__here", F.max("__ends").over(within))
        .join(carried, key)
        .withColumn("paused", F.coalesce(F.col("__at") < until, F.lit(False)))
        .drop("__at", "__ends", "__here", "__carried", "__bucket")
    )


def window_rate(attempts: DataFrame, seconds: int = 60) -> DataFrame:
    """F14, native: attempts of the endpoint in the trailing window against its allowance."""
    counted = trailing_count(_limits(attempts), ["endpoint"], "started_at", seconds)
    allowed = F.round(F.col("rate") * seconds + F.col("capacity")).cast("bigint")
    return counted.withColumns({"allowed": allowed, "over": F.col("in_window") > allowed})
