"""Availability of sets. One join with the claims and one ``groupBy`` per set; the names
of missing and unknown components stay rows of their own (``set_component_states``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_component_states(sets: DataFrame, components: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per component: complete sets it allows and whether it is missing or unknown."""
    virtual = F.col("set_kind") == "virtual_set"
    known = F.col("claim_status").isin("available", "not_available")
    units = F.when(
        virtual & known, F.floor(F.coalesce("sellable_qty", F.lit(0)) / F.col("qty"))
    ).cast("bigint")
    c = claims.select(
        F.col("sku").alias("component_sku"), F.col("status").alias("claim_status"),
        "sellable_qty", "as_of",
    )
    required = ~F.col("optional")
    return (
        sets.select("set_sku", "set_kind")
        .join(components, "set_sku")
        .join(c, "component_sku", "left")
        .withColumn("set_units", units)
        .withColumn(
            "state",
            F.when(virtual & required & F.col("set_units").isNull(), "unknown")
            .when(virtual & required & (F.col("set_units") == 0), "missing")
            .when(~virtual & required & ~F.col("present"), "missing")
            .otherwise("ok"),
        )
    )


def set_availability(sets: DataFrame, components: DataFrame, claims: DataFrame) -> DataFrame:
    """C14 + C15 + C16. ``claims`` may also hold the kits' own claims (stocked sets)."""
    lines = set_component_states(sets, components, claims)
    required = ~F.col("optional")
    per_set = lines.groupBy("set_sku").agg(
        F.count_if(required).alias("n_required"),
        F.count_if(F.col("state") == "unknown").alias("n_unknown"),
        F.count_if(F.col("state") == "missing").alias("n_missing"),
        F.min(F.when(required, F.col("set_units"))).alias("units"),
        F.min(F.when(required, F.col("as_of"))).alias("components_as_of"),
    )
    own = claims.select(
        F.col("sku").alias("set_sku"), F.col("status").alias("own_status"),
        F.col("sellable_qty").alias("own_qty"), F.col("reason").alias("own_reason"),
        F.col("as_of").alias("own_as_of"),
    )
    rolled = sets.select("set_sku", "set_kind").join(per_set, "set_sku", "left")
    zero = {c: 0 for c in ("n_required", "n_unknown", "n_missing")}
    virtual = (
        rolled.where(F.col("set_kind") == "virtual_set")
        .fillna(zero)
        .withColumn(
            "reason",
            F.when(F.col("n_required") == 0, "set_has_no_components")
            .when(F.col("n_unknown") > 0, "component_unknown")
            .when(F.col("units") == 0, "missing_components"),
        )
        .withColumn(
            "status",
            F.when((F.col("n_required") == 0) | (F.col("n_unknown") > 0), "unknown")
            .when(F.col("units") > 0, "available")
            .otherwise("not_available"),
        )
        .select(
            "set_sku", "set_kind", "status",
            F.when(F.col("status") != "unknown", F.col("units")).alias("complete_sets"),
            "reason",
            F.when(F.col("status") != "unknown", F.col("components_as_of")).alias("as_of"),
            "n_missing", "n_unknown",
        )
    )
    status = F.coalesce("own_status", F.lit("unknown"))
    stocked = (
        rolled.where(F.col("set_kind") == "stocked_set")
        .fillna(zero)
        .join(own, "set_sku", "left")
        .select(
            "set_sku", "set_kind", status.alias("status"),
            F.when(status != "unknown", F.col("own_qty")).alias("complete_sets"),
            F.when(F.col("own_status").isNull(), F.lit("no_claim"))
            .otherwise(F.col("own_reason")).alias("reason"),
            F.col("own_as_of").alias("as_of"), "n_missing",
            F.when(status == "unknown", 1).otherwise(0).cast("bigint").alias("n_unknown"),
        )
    )
    return virtual.unionByName(stocked).withColumn(
        "complete",
        F.when((F.col("n_unknown") > 0) | (F.col("status") == "unknown"), None).otherwise(
            (F.col("n_missing") == 0) & (F.col("status") == "available")
        ),
    )
