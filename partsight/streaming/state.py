"""Streaming forms of the message, job and traffic operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from partsight.operators.jobs import BACKOFF_BASE_S, BACKOFF_MAX_S, KEY, merge_enqueue
from partsight.operators.masking import mask_texts
from partsight.operators.traffic import classify_attempts
from partsight.session import run_dir
from partsight.streaming.runner import for_each_batch, merge_to_table


def dedup(messages: DataFrame, what: str = "dedup", folder: str | None = None) -> DataFrame:
    """One message per id, whichever batches its copies came in. Every batch stores its distinct
    ids, the reader takes the smallest row of each."""
    rest = [c for c in messages.columns if c != "message_id"]

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("message_id").agg(F.min(F.struct(*rest)).alias("row"))

    found = merge_to_table(messages, once, what, folder)
    return found.groupBy("message_id").agg(F.min("row").alias("row")).select("message_id", "row.*")


def _number(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counter and last customer position of one conversation."""
    seq, inbound = state.get if state.exists else (0, 0)
    # A micro-batch brings the few new messages of the conversation.
    batch = pd.concat(list(rows)).sort_values(["created_at", "message_id"])
    batch["seq"] = range(seq + 1, seq + 1 + len(batch))
    pointer = batch["seq"].where(batch["author_role"] == "customer").ffill().fillna(inbound)
    batch["last_inbound_seq"] = pointer.astype("int64")
    state.update((int(seq + len(batch)), int(pointer.iloc[-1])))
    yield batch[["message_id", "conversation_id", "seq", "last_inbound_seq"]]


def sequence(messages: DataFrame) -> DataFrame:
    """Gap-free numbers per conversation, in the order of arrival, and at each message the pointer
    to the newest customer message so far. For messages that arrive in order it is the same however
    they are cut into batches."""
    return (
        messages.select("message_id", "conversation_id", "author_role", "created_at")
        .groupBy("conversation_id")
        .applyInPandasWithState(
            _number,
            outputStructType="message_id string, conversation_id bigint, seq bigint, "
            "last_inbound_seq bigint",
            stateStructType="seq bigint, inbound bigint",
            outputMode="append",
            timeoutConf=GroupStateTimeout.NoTimeout,
        )
    )


def pending_table(
    requests: DataFrame, start: DataFrame, what: str = "pending", folder: str | None = None
) -> DataFrame:
    """The queue as a versioned table; every batch merges its requests (E07) into the version
    before it and writes the next one, so a repeated batch gives the same table. A job that goes on
    after a stop names its ``folder`` again."""
    spark = requests.sparkSession
    folder = folder or run_dir(spark, what)
    out = f"{folder}/table"
    columns = [*KEY, "job_id", "run_after", "last_error_code"]
    start.select(*columns).write.mode("ignore").parquet(f"{out}/version=0")

    def write(batch: DataFrame, batch_id: int) -> None:
        before = batch.sparkSession.read.parquet(f"{out}/version={batch_id}")
        merged = merge_enqueue(before, batch).join(
            before.select(*KEY, "last_error_code"), KEY, "left"
        )
        merged.select(*columns).write.mode("overwrite").parquet(f"{out}/version={batch_id + 1}")

    for_each_batch(requests, write, folder)
    versions = spark.read.parquet(out)
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def retries(outcomes: DataFrame, max_attempts: int = 12) -> DataFrame:
    """Attempts, backoff and dead letters as a stream. ``outcomes``: ``work_key, event_id, ts,
    failed``. A success clears the attempts, the last one makes the work dead; ``dead`` rows are the
    alerts."""

    def follow(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event_id, failed in zip(batch["event_id"], batch["failed"], strict=True):
            n = n + 1 if failed else 0
            status = "done" if not failed else "dead" if n >= max_attempts else "requeue"
            delay = min(BACKOFF_MAX_S, BACKOFF_BASE_S * 2 ** min(max(n - 1, 0), 40))
            out.append((key[0], int(event_id), n, status, delay if status == "requeue" else -1))
            n = 0 if status == "dead" else n
        state.update((int(n),))
        yield pd.DataFrame(out, columns=["work_key", "event_id", "attempts", "status", "delay_s"])

    return outcomes.groupBy("work_key").applyInPandasWithState(
        follow,
        outputStructType="work_key string, event_id bigint, attempts bigint, status string, "
        "delay_s bigint",
        stateStructType="n bigint",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def attempt_metrics(
    attempts: DataFrame, width: str = "1 hour", what: str = "attempts", folder: str | None = None
) -> DataFrame:
    """Attempts per endpoint and outcome in tumbling windows."""
    keys = ["window_s", "endpoint", "outcome"]

    def count(rows: DataFrame) -> DataFrame:
        return classify_attempts(rows).groupBy(
            F.unix_seconds(F.window("started_at", width)["start"]).alias("window_s"), "endpoint",
            F.coalesce("error_kind", F.lit("ok")).alias("outcome"),
        ).agg(F.count(F.lit(1)).alias("attempts"))

    found = merge_to_table(attempts, count, what, folder)
    return found.groupBy(*keys).agg(F.sum("attempts").alias("attempts"))


def rate_check(
    attempts: DataFrame, allowed: Column, width: str = "1 hour", slide: str = "30 minutes",
    what: str = "rate", folder: str | None = None,
) -> DataFrame:
    """Attempts per endpoint in sliding windows against what is allowed in one."""

    def count(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window("started_at", width, slide).alias("w"), "endpoint").agg(
            F.count(F.lit(1)).alias("attempts")
        ).select(F.unix_seconds("w.start").alias("window_s"), "endpoint", "attempts")

    found = merge_to_table(attempts, count, what, folder)
    return found.groupBy("window_s", "endpoint").agg(F.sum("attempts").alias("attempts")).withColumn(
        "over", F.col("attempts") > allowed
    )


def mask_stream(rows: DataFrame, text: str = "text") -> DataFrame:
    """Masking is stateless, so the batch operator is the streaming one."""
    return mask_texts(rows, text)
