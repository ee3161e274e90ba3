"""Sides that pass for small but grow with the input are not broadcast."""

from __future__ import annotations

import re

import pytest

from partsight import plans

SCHEMAS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey long, c_name string",
}
ORDERS = "o_orderkey long, o_custkey long"
LINES = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"


def _orders(spark, folder) -> str:
    """Parts, customers and their orders in a folder."""
    parts = [(i, f"part {i}", f"Brand#{i % 9}", "T", i % 40, 1.0) for i in range(1, 40)]
    tables = {
        "part": (parts, SCHEMAS["part"]), "customer": ([(i, f"c{i}") for i in range(1, 40)], SCHEMAS["customer"]),
        "orders": ([(i, i % 40) for i in range(1, 80)], ORDERS),
        "lineitem": ([(i, i % 39 + 1, k, 2.0) for i in range(1, 80) for k in (1, 2)], LINES),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["part_number_match", "product_search", "search_basis"])
def test_derived_sides_are_not_broadcast(spark, tmp_path, name):
    spark.createDataFrame([(i, f"part {i}", f"Brand#{i % 9}", "T", i % 40, 1.0) for i in range(1, 40)], SCHEMAS["part"]).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"c{i}") for i in range(1, 40)], SCHEMAS["customer"]).write.parquet(f"{tmp_path}/customer.parquet")
    found = plans.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["fitment_evidence", "fitment_set", "fitment_outcome", "fitment_batch", "fitment_questions"])
def test_vehicles_records_and_products_are_never_broadcast(spark, tmp_path, name):
    plan = plans.queries()[name](spark, _orders(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    one_key = r" \[(vehicle_id|sku)#\d+L?\], \[\1#\d+L?\]"
    assert re.search("SortMergeJoin" + one_key, plan) and not re.search("BroadcastHashJoin" + one_key, plan)


def test_checks_of_records_are_not_shuffled(spark, tmp_path):
    folder = _orders(spark, tmp_path)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = plans.queries()["fitment_evidence"](spark, folder)
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(threshold, before)
    below = [plan[i + 1] for i, line in enumerate(plan[:-1]) if "Exchange hashpartitioning" in line]
    assert below and not any("check_make" in line for line in below)
