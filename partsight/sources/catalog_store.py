"""Catalogue data sets as tables: read, check, join, write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.session import run_dir

_PROVENANCE = "verified_at timestamp"

# Sections of a data set document and their columns.
SECTIONS = {
    "vehicle_specs": "id string, make string, model string, chassis_code string, year_from int, "
    "year_to int, facelift boolean",
    "products": "sku string, title string, part_type string, condition string, color string, "
    "condition_notes string, set_kind string, brand string, oem_numbers array<string>, "
    "last_verified_at timestamp",
    "fitments": "id string, sku string, vehicle_spec string, status string, conditions string, "
    "evidence_type string, evidence_ref string, verified_by string, " + _PROVENANCE,
    "set_components": "set_sku string, component_sku string, qty int, present boolean, "
    "optional boolean",
    "stock": "ref string, sku string, location string, physical_qty int, "
    "external_reserved_qty int, available_qty int, " + _PROVENANCE,
    "prices": "sku string, amount_minor bigint, currency string, discount_rule_key string, "
    + _PROVENANCE,
    "photos": "stock_ref string, key string, sort_order int, " + _PROVENANCE,
}


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Data set documents (one JSON object per file) as one table per section."""
    fields = [
        T.StructField(name, T.ArrayType(T.StructType.fromDDL(ddl))) for name, ddl in SECTIONS.items()
    ]
    header = T.StructType.fromDDL(
        "dataset string, data_origin string, source string, snapshot_at timestamp"
    )
    docs = spark.read.schema(T.StructType([*header.fields, *fields])).json(path, multiLine=True)
    return {
        name: docs.select(
            "dataset", "data_origin", "source", F.col("snapshot_at").alias("fetched_at"),
            F.inline(name),
        )
        for name in SECTIONS
    }


def load_catalog(
    products: DataFrame, oems: DataFrame, fitments: DataFrame, skus: DataFrame | None = None
) -> DataFrame:
    """Products with their part numbers and records summed up; ``skus`` filters first."""
    if skus is not None:
        products = products.join(skus, "sku", "left_semi")
    numbers = oems.groupBy("sku").agg(
        F.count(F.lit(1)).alias("n_oems"), F.min("oem_number").alias("min_oem")
    )
    records = fitments.groupBy("sku").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("chassis_code").alias("n_chassis"),
        F.min("year_from").cast("bigint").alias("first_year"),
        F.max("year_to").cast("bigint").alias("last_year"),
    )
    return (
        products.select("sku", "set_kind")
        .join(numbers, "sku", "left")
        .join(records, "sku", "left")
        .fillna({"n_oems": 0, "min_oem": "", "n_records": 0, "n_chassis": 0, "first_year": -1,
                 "last_year": -1})
    )


def write_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """C17: one Parquet table per section under the shared folder; natural keys stay keys and
    ``key_hash`` (of the natural key) replaces generated ids."""
    base = run_dir(spark, "catalog")
    written = []
    for name, df in tables.items():
        keys = [c for c in df.columns if c in ("sku", "set_sku", "component_sku", "record_id",
                                               "oem_number", "stock_ref")]
        path = f"{base}/{name}"
        df.withColumn("key_hash", F.xxhash64(*keys)).write.parquet(path)
        written.append(
            spark.read.parquet(path).agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.countDistinct("key_hash").alias("keys"),
            )
        )
    return reduce(DataFrame.unionByName, written)


def unknown_references(
    rows: DataFrame, column: str, known: DataFrame, known_column: str, rule: str,
    item: str | None = None,
) -> DataFrame:
    """Rows whose reference does not exist, as (rule, item)."""
    keys = known.select(F.col(known_column).alias(column))
    return rows.join(keys, column, "left_anti").select(
        F.lit(rule).alias("rule"), F.col(item or column).cast("string").alias("item")
    )


def duplicate_keys(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once, as (rule, first key column)."""
    return (
        rows.groupBy(*keys)
        .count()
        .where(F.col("count") > 1)
        .select(F.lit(rule).alias("rule"), F.col(keys[0]).cast("string").alias("item"))
    )


def violation_summary(checks: list[DataFrame]) -> DataFrame:
    return (
        reduce(DataFrame.unionByName, checks)
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("violations"), F.min("item").alias("first_item"))
    )
