"""Row rules in one pass per table, key rules by aggregation and anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``violations``: the names of the rules a row breaks (all rules in one projection)."""
    broken = [F.when(~F.coalesce(F.expr(p), F.lit(True)), F.lit(n)) for n, p in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def violation_counts(rows: DataFrame, table: str, rules: dict[str, str]) -> DataFrame:
    """Broken rules of one table with their row counts."""
    return (
        row_violations(rows, rules)
        .select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(table).alias("table_name"), "rule", "violations")
    )


def duplicate_keys(rows: DataFrame, rule: str, keys: tuple[str, ...], condition: str) -> DataFrame:
    """Keys that break a (partial) unique rule: how many, and how many rows are too many."""
    return (
        rows.where(condition)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))
        .select(F.lit(rule).alias("rule"), F.lit("unique").alias("kind"), "keys", "excess")
    )


def missing_references(
    rows: DataFrame, rule: str, column: str, other: DataFrame, other_column: str
) -> DataFrame:
    """References without a target: distinct values and rows."""
    targets = other.select(F.col(other_column).alias(column))
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(targets, column, "left_anti")
        .agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("excess"))
        .select(F.lit(rule).alias("rule"), F.lit("reference").alias("kind"), "keys", "excess")
    )
