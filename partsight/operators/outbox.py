"""Sending eligibility, the group stop rule, audit and settings logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.session import run_dir

# Fixed values.
SENDING_MODES = ("approve_to_send",)
STARTED = ("sending", "sent", "unknown", "needs_owner", "failed")


def send_eligibility(
    outbound: DataFrame, drafts: DataFrame, conversations: DataFrame, settings: DataFrame
) -> DataFrame:
    """Which pending parts may be sent, and what blocks the others.

    The previous part is found by an equi-join on (draft, generation, part): no group of parts is
    sorted in one task. ``settings`` has at most one row; a missing row or NULL blocks.
    """
    pending = outbound.where(F.col("status") == "pending")
    previous = outbound.where(F.col("status") == "sent").select(
        "draft_id", "generation", (F.col("part_no") + 1).alias("part_no"),
        F.lit(True).alias("previous_sent"),
    )
    d = drafts.select("draft_id", "conversation_id", "based_on_seq")
    c = conversations.select("conversation_id", "automation", "last_inbound_seq")
    allowed = settings.agg(
        F.coalesce(
            F.bool_or(
                (F.col("kill_switch") == F.lit(False))
                & F.col("automation_mode").isin(*SENDING_MODES)
            ),
            F.lit(False),
        )
    ).scalar()
    first = F.col("part_no") == 1
    active = F.coalesce(F.col("automation") == "active", F.lit(False))
    fresh = F.coalesce(F.col("last_inbound_seq") == F.col("based_on_seq"), F.lit(False))
    return (
        pending.join(d, "draft_id", "left")
        .join(c, "conversation_id", "left")
        .join(previous, ["draft_id", "generation", "part_no"], "left")
        .withColumn("settings_allow", allowed)
        .withColumn(
            "blocked_by",
            F.when(~F.col("settings_allow"), "settings")
            .when(~active, "automation")
            .when(first & ~fresh, "draft_stale")
            .when(~first & F.col("previous_sent").isNull(), "previous_part")
            .otherwise(""),
        )
    )


def stop_groups(
    outbound: DataFrame, drafts: DataFrame, conversations: DataFrame
) -> DataFrame:
    """Stopping cancels every pending part; a conversation whose group had started is paused.
    One aggregation per group replaces the self-join of started and cancelled rows."""
    groups = outbound.groupBy("draft_id", "generation").agg(
        F.count_if(F.col("status") == "pending").alias("cancelled"),
        F.bool_or(F.col("status").isin(*STARTED)).alias("started"),
    )
    per_conversation = (
        groups.where(F.col("cancelled") > 0)
        .join(drafts.select("draft_id", "conversation_id"), "draft_id")
        .groupBy("conversation_id")
        .agg(F.sum("cancelled").alias("cancelled_parts"), F.bool_or("started").alias("broken"))
    )
    state = conversations.select("conversation_id", "automation", "state_version")
    return per_conversation.join(state, "conversation_id", "left").withColumn(
        "paused", F.col("broken") & F.coalesce(F.col("automation") == "active", F.lit(False))
    ).withColumn(
        "new_state_version",
        F.when(F.col("paused"), F.col("state_version") + 1).otherwise(F.col("state_version")),
    )


def append_audit(events: DataFrame, path: str | None = None) -> DataFrame:
    """Append audit rows (ids and codes only), partitioned by day, and read the table back."""
    spark = events.sparkSession
    path = path or run_dir(spark, "audit")
    day = F.to_date("ts")
    events.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path)


def alert_feed(audit: DataFrame) -> DataFrame:
    """Alerts are audit rows with result ``alert``."""
    return audit.where(F.col("result") == "alert")


def current_settings(changes: DataFrame) -> DataFrame:
    """The value of every field after the last applied change, and how often sending had to
    stop (kill switch on, or a mode that does not send)."""
    stops = ((F.col("field") == "kill_switch") & (F.col("new_value") == "true")) | (
        (F.col("field") == "automation_mode") & ~F.col("new_value").isin(*SENDING_MODES)
    )

    def last(field: str) -> Column:
        at = F.when(F.col("field") == field, F.col("version"))
        return F.max_by("new_value", at).alias(field)

    return changes.groupBy("setting_id").agg(
        last("kill_switch"), last("automation_mode"), F.max("version").alias("version"),
        F.count_if(stops).alias("stops"),
    )
