"""The result does not depend on files, batches or their order; a stopped job goes on."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from partsight.sources.tables import TABLES, read_table
from partsight.streaming import state as st
from partsight.streaming.runner import StreamDomain, append_to_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["in order", "reversed", "mixed"])
def live(request, spark, tmp_path_factory):
    """The tables as folders of four files, one file a batch."""
    root = str(tmp_path_factory.mktemp("tables"))
    for name, by in (("events", "event_id"), ("conversations", "conv_id")):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        key = F.xxhash64(by) if request.param == "mixed" else F.col(by)
        cuts = table.select(by, F.ntile(4).over(Window.orderBy(key)).alias("n"))
        numbered = table.join(cuts.distinct().groupBy(by).agg(F.min("n").alias("n")), by)
        order = (1, 2, 3, 4) if request.param != "reversed" else (4, 3, 2, 1)
        for i, n in enumerate(order):
            numbered.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(f"{root}/{name}.parquet")
            for f in os.listdir(f"{root}/{name}.parquet"):
                path = f"{root}/{name}.parquet/{f}"
                if f.startswith("part-") and os.path.getmtime(path) > 1_000_000_100:
                    os.utime(path, (1_000_000_000 + i, 1_000_000_000 + i))
    for name in TABLES:
        if not os.path.exists(f"{root}/{name}.parquet"):
            os.symlink(f"{SF}/{name}.parquet", f"{root}/{name}.parquet")
    return StreamDomain(spark, root, {"events", "conversations"}, files=1)


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _static(spark):
    return StreamDomain(spark, SF, set())


def test_counts_and_ids_of_any_cut(spark, live):
    attempts = _static(spark)["attempt"]
    metrics = st.attempt_metrics(live["attempt"])
    assert metrics.agg(F.sum("attempts")).first()[0] == attempts.count()
    rate = st.rate_check(live["attempt"], F.lit(5))
    assert rate.agg(F.sum("attempts")).first()[0] == 2 * attempts.count()
    want = _static(spark)["inbound_message"].select("message_id", "conversation_id", "author_role").distinct()
    once = st.dedup(live["inbound_message"].select("message_id", "conversation_id", "author_role"))
    assert _rows(once) == _rows(want)


def test_a_stopped_job_goes_on(spark, live, tmp_path):
    masked = st.mask_stream(live["conversations"].select("conv_id", "turn", "text"))
    n = read_table(spark, SF, "conversations").count()
    for _ in range(2):
        assert append_to_table(masked, "mask", str(tmp_path / "mask")).count() == n
    first = st.attempt_metrics(live["attempt"], folder=str(tmp_path / "metrics"))
    again = st.attempt_metrics(live["attempt"], folder=str(tmp_path / "metrics"))
    assert _rows(first) == _rows(again)
    queue = _static(spark)["queued_job"]
    one = st.pending_table(live["enqueue_request"], queue, folder=str(tmp_path / "queue"))
    two = st.pending_table(live["enqueue_request"], queue, folder=str(tmp_path / "queue"))
    assert _rows(one) == _rows(two) and one.count() >= queue.count()
