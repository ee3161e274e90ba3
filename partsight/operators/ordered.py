"""Running totals along an order, for keys of any size.

The rows are range partitioned by key and order once and stored with the number of their partition. A key
with a third of all rows, even of one instant, lies in many partitions then. A running total is carried
from partition to partition by one row for each key and partition; rows are only sorted within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.session import run_dir

BUCKET = "bucket"


def stored(rows: DataFrame, what: str = "rows") -> DataFrame:
    """``rows`` written to the shared folder once, for callers that read them several times."""
    spark, path = rows.sparkSession, run_dir(rows.sparkSession, what)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, keys: list[str], order: list[str], what: str = "ordered") -> DataFrame:
    """``rows`` stored in the shared folder with ``bucket``, which does not fall along keys and order.

    Stored, because the ranges come from a sample: taken twice they could differ.
    """
    return stored(rows.repartitionByRange(*keys, *order).withColumn(BUCKET, F.spark_partition_id()), what)


def running(
    rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None
) -> DataFrame:
    """``dealt`` rows with sums and maxima over the rows of the same keys strictly before each.

    A sum over no rows is 0, a maximum over none is null. Rows with a null key are left out; the order
    must tell all rows of a key apart.
    """
    columns = {**(sums or {}), **(maxima or {})}
    fold = {n: F.sum if n in (sums or {}) else F.max for n in columns}
    cut = rows.withColumns({f"__{n}": c for n, c in columns.items()})
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, BUCKET).agg(*(fold[n](f"__{n}").alias(f"__{n}") for n in columns))
    carried = totals.select(*keys, BUCKET, *(fold[n](f"__{n}").over(earlier).alias(f"__before_{n}") for n in columns))

    def whole(n: str) -> Column:
        before, local = F.col(f"__before_{n}"), fold[n](f"__{n}").over(here)
        return F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0)) if n in (sums or {}) else F.greatest(before, local)

    met = cut.join(carried, [*keys, BUCKET]).withColumns({n: whole(n) for n in columns})
    return met.drop(*(f"__{n}" for n in columns), *(f"__before_{n}" for n in columns))
