"""E, F and numbering: windows against brute force, hot keys, the rate replay, queue merges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from partsight.operators import jobs as jb
from partsight.operators import messages as ms
from partsight.operators.numbering import hour_of, number_rows, trailing_count
from partsight.operators.rate import with_pauses
from partsight.rules import traffic as R

START = datetime(2024, 1, 1)


def _log(spark, n=3000, seed=7):
    """A third of all rows belong to one key."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(50)}"
        rows.append((i, key, START + timedelta(seconds=rnd.randrange(40000))))
    return rows, spark.createDataFrame(rows, "id long, key string, ts timestamp").repartition(7)


def test_numbering_of_hot_keys(spark):
    rows, df = _log(spark)
    got = {r.id: r.n for r in number_rows(df, ["key"], hour_of("ts"), [F.col("ts"), F.col("id")]).collect()}
    want, seen = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key]
    assert got == want


def test_trailing_counts(spark):
    rows, df = _log(spark, 1500)
    got = {r.id: r.in_window for r in trailing_count(df, ["key"], "ts", 600).collect()}
    want = {i: sum(k == key and 0 <= (ts - t).total_seconds() < 600 for _, k, t in rows) for i, key, ts in rows}
    assert got == want


def test_pauses_are_the_sequential_ones(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(2000):
        endpoint = "chats_list" if rnd.random() < 0.6 else rnd.choice(["items_list", "item_detail"])
        rows.append((i, endpoint, START + timedelta(seconds=rnd.randrange(9000)), 429 if rnd.random() < 0.03 else 200, rnd.choice([None, 5.0, 4000.0])))
    df = spark.createDataFrame(rows, "attempt_id long, endpoint string, started_at timestamp, status int, retry_after_s double").repartition(5)
    until, want = {}, {}
    for i, endpoint, at, status, wait in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = endpoint in until and at < until[endpoint]
        if status == 429:
            end = at + timedelta(seconds=R.DEFAULT_429_COOLDOWN_S if wait is None else wait)
            until[endpoint] = max(end, until.get(endpoint, end))
    for bucket in (60, 3600):
        assert {r.attempt_id: r.paused for r in with_pauses(df, bucket_seconds=bucket).collect()} == want
    assert sum(want.values()) > 100


def test_dedup_takes_the_first(spark):
    rows = [("m1", 1, "poller", START + timedelta(seconds=5)), ("m1", 1, "webhook", START),
            ("m2", 1, "import", START), ("m2", 1, "webhook", START)]
    df = spark.createDataFrame(rows, "message_id string, conversation_id int, source string, received_at timestamp")
    assert {r.message_id: r.source for r in ms.dedup_messages(df).collect()} == {"m1": "webhook", "m2": "import"}


def test_backoff(spark):
    df = spark.range(0, 15).select(jb.backoff_ceiling(F.col("id")).alias("d"))
    assert [r.d for r in df.collect()] == [10, 10, 20, 40, 80, 160, 320, 640, 1280, 2560] + [3600] * 5


def _jobs(spark, rows):
    return spark.createDataFrame(
        rows, "job_id long, kind string, dedup_key string, status string, attempts long, max_attempts long, "
              "claimed_by string, run_after timestamp, last_error_code string, version long")


def test_requeue_merge(spark):
    jobs = _jobs(spark, [
        (1, "k", "a", "running", 3, 12, "w", START, None, 0), (2, "k", "a", "queued", 1, 12, None, START, None, 0),
        (3, "k", "b", "running", 2, 12, "w", START, None, 0), (4, "k", "b", "running", 5, 12, "w", START, None, 0)])
    out = jb.requeue(jobs, jobs.where("status = 'running'"), run_after=F.lit(START), error_code="x")
    assert {r.job_id: (r.status, r.attempts) for r in out.collect()} == {
        1: ("superseded", 3), 2: ("queued", 3), 3: ("queued", 5), 4: ("superseded", 5)}


def test_orphans(spark):
    jobs = _jobs(spark, [
        (1, "k", "a", "running", 12, 12, "old", START, None, 0), (2, "k", "b", "running", 1, 12, None, START, None, 0),
        (3, "k", "c", "running", 1, 12, "me", START, None, 0)])
    out = {r.job_id: r.status for r in jb.recover_orphans(jobs, "me", F.lit(START)).collect()}
    assert out == {1: "dead", 2: "queued"}


def test_enqueue_respects_backoff(spark):
    queued = _jobs(spark, [(1, "k", "a", "queued", 1, 12, None, START + timedelta(hours=2), "err", 0),
                           (2, "k", "b", "queued", 1, 12, None, START + timedelta(hours=2), None, 0)])
    req = spark.createDataFrame([(i, "k", d, START) for i, d in enumerate("abcb")],
                                "request_id long, kind string, dedup_key string, run_after timestamp")
    out = {r.dedup_key: (r.action, r.requests) for r in jb.merge_enqueue(queued, req).collect()}
    assert out == {"a": ("in_backoff", 1), "b": ("pulled_forward", 2), "c": ("inserted", 1)}


def test_streams_read_tables_of_several_files(spark, tmp_path):
    from partsight import plans

    source = "/root/testdata/sf0.001"
    for name in ("events", "conversations", "orders", "customer", "part", "documents"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    query = plans.queries()["stream_dedup"]
    assert query(spark, str(tmp_path)).count() == query(spark, source).count() > 0
