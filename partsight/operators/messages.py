"""Messages and drafts as tables: dedup, gap-free sequence, pointers, fences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators.numbering import hour_of, number_rows

# Draft statuses that count as open.
OPEN_DRAFT = ("proposed", "approved")


def dedup_messages(inbound: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per message id, the first one received wins (ties by source); ids already
    stored are dropped. ``min_by`` combines map-side, so a flood of one id stays cheap."""
    rest = [c for c in inbound.columns if c != "message_id"]
    first = (
        inbound.groupBy("message_id")
        .agg(F.min_by(F.struct(*rest), F.struct("received_at", "source")).alias("m"))
        .select("message_id", "m.*")
    )
    return first if stored is None else first.join(stored, "message_id", "left_anti")


def assign_sequence(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """``seq`` goes on from the stored maximum of the conversation, without gaps, in order of
    (created_at, message_id)."""
    start = stored.groupBy("conversation_id").agg(F.max("seq").alias("last_seq"))
    numbered = number_rows(
        messages, ["conversation_id"], hour_of("created_at"),
        [F.col("created_at"), F.col("message_id")],
    )
    return (
        numbered.join(start, "conversation_id", "left")
        .withColumn("seq", F.col("n") + F.coalesce("last_seq", F.lit(0)))
        .drop("n", "last_seq")
    )


def last_inbound(numbered: DataFrame) -> DataFrame:
    """The newest customer sequence per conversation."""
    return numbered.groupBy("conversation_id").agg(
        F.max(F.when(F.col("author_role") == "customer", F.col("seq"))).alias("last_inbound_seq"),
        F.max("seq").alias("last_seq"),
    )


def fence_drafts(drafts: DataFrame, conversations: DataFrame) -> DataFrame:
    """A draft is valid only if it answers the newest customer message."""
    conv = conversations.select("conversation_id", "last_inbound_seq", "last_processed_seq")
    same = F.col("based_on_seq") == F.col("last_inbound_seq")
    return drafts.join(conv, "conversation_id", "left").withColumn(
        "fence",
        F.when(F.col("last_inbound_seq").isNull(), "no_conversation")
        .when(same, "valid")
        .otherwise("stale"),
    )


def open_drafts(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """The open draft each (conversation, seq) ends up with: the one already open, else the
    first request. ``last_processed_seq`` only moves forward."""
    keys = ["conversation_id", "based_on_seq"]
    existing = (
        drafts.where(F.col("status").isin(*OPEN_DRAFT))
        .groupBy(*keys)
        .agg(F.min("draft_id").alias("open_id"))
    )
    wanted = requests.groupBy(*keys).agg(
        F.min("draft_id").alias("first_request"),
        F.count(F.lit(1)).alias("requests"),
        F.max("last_processed_seq").alias("processed_before"),
    )
    return wanted.join(existing, keys, "left").select(
        *keys,
        F.coalesce("open_id", "first_request").alias("draft_id"),
        F.col("open_id").isNotNull().alias("replayed"),
        "requests",
        F.greatest("processed_before", "based_on_seq").alias("last_processed_seq"),
    )
