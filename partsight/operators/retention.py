"""What was deleted does not come back, and what is past its time goes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tombstone(column: str):
    """What is kept of a deleted id: its SHA-256."""
    return F.sha2(F.col(column).cast("string"), 256)


def drop_deleted(messages: DataFrame, message_stones: DataFrame, chat_stones: DataFrame) -> DataFrame:
    """``messages`` (message_id, chat_id, ...) without those whose id, or whose chat's, has a tombstone.

    ``message_stones``, ``chat_stones``: sha256. Null ids match nothing; repeated rows and tombstones do no
    harm. Only ids travel to meet the tombstones; the rows with their texts are then filtered by the ids
    that were hit, which Spark broadcasts if they turn out few and joins by shuffle if not.
    """

    def hit(column: str, stones: DataFrame) -> DataFrame:
        ids = messages.select(column).where(F.col(column).isNotNull()).distinct()
        return ids.join(stones.select("sha256"), tombstone(column) == F.col("sha256"), "left_semi")

    kept = messages.join(hit("message_id", message_stones), "message_id", "left_anti").join(hit("chat_id", chat_stones), "chat_id", "left_anti")
    return kept.select(*messages.columns)


def past_retention(records: DataFrame, policy: DataFrame, as_of: datetime) -> DataFrame:
    """``records`` (class, created_at, ...) whose class keeps them no longer at ``as_of``.

    ``policy``: class, keep_days. A class without a policy, or with null days, is kept for ever, as are
    records without class or time. A record goes ``keep_days`` days after its creation, to the microsecond.
    """
    days = policy.where("keep_days IS NOT NULL").groupBy("class").agg(F.min("keep_days").alias("keep_days"))
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")
    return records.join(days, "class").where(age >= F.col("keep_days").cast("long") * 86_400_000_000).select(*records.columns)
