"""Queries of area S: every stream runs over the whole table and is compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.plans.registry import query
from partsight.sources.domain import DUCK, Domain, with_domain
from partsight.streaming import state as st
from partsight.streaming.runner import StreamDomain, append_to_table


def _live(d: Domain, *tables: str) -> StreamDomain:
    return StreamDomain(d.spark, d.sf_dir, set(tables))


@query("stream_dedup", with_domain("inbound_message", """
    SELECT DISTINCT message_id, conversation_id, author_role FROM inbound_message"""))
def stream_dedup(d: Domain) -> DataFrame:
    """S01."""
    live = _live(d, "conversations")["inbound_message"]
    return st.dedup(live.select("message_id", "conversation_id", "author_role"), "stream-dedup")


@query("stream_seq", with_domain("inbound_message", """,
    m AS (SELECT DISTINCT message_id, conversation_id, author_role, created_at FROM inbound_message),
    n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, message_id)
          AS seq FROM m)
    SELECT message_id, conversation_id, seq, coalesce(max(CASE WHEN author_role = 'customer'
      THEN seq END) OVER (PARTITION BY conversation_id ORDER BY seq), 0) AS last_inbound_seq FROM n"""))
def stream_seq(d: Domain) -> DataFrame:
    """S02 on the messages without their copies."""
    live = _live(d, "conversations")["inbound_message"].where("source = 'webhook'")
    return append_to_table(st.sequence(live), "stream-seq")


@query("stream_pending", with_domain("queued_job enqueue_request", f""",
    w AS (SELECT kind, dedup_key, min(run_after) AS want FROM enqueue_request GROUP BY kind, dedup_key)
    SELECT coalesce(q.kind, w.kind) AS kind, coalesce(q.dedup_key, w.dedup_key) AS dedup_key,
      {DUCK.secs("CASE WHEN q.last_error_code IS NOT NULL THEN q.run_after ELSE least(q.run_after, w.want) END")}
      AS run_after_s
    FROM queued_job q FULL JOIN w ON w.kind = q.kind AND w.dedup_key = q.dedup_key"""))
def stream_pending(d: Domain) -> DataFrame:
    """S03."""
    requests = _live(d, "events")["enqueue_request"]
    table = st.pending_table(requests, d["queued_job"], "stream-pending")
    return table.select("kind", "dedup_key", F.unix_seconds("run_after").alias("run_after_s"))


@query("stream_retry", """
    WITH e AS (SELECT event_id, 'w' || CAST(user_id AS STRING) AS work_key,
        event_type IN ('error', 'view') AS failed, ts FROM events),
    g AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY work_key ORDER BY ts, event_id)
          AS run FROM e),
    r AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY work_key, run ORDER BY ts, event_id)
          AS c FROM g),
    a AS (SELECT *, CASE WHEN failed THEN (c - 1) % 3 + 1 ELSE 0 END AS n FROM r)
    SELECT work_key, event_id, n AS attempts, CASE WHEN NOT failed THEN 'done' WHEN n = 3 THEN 'dead'
        ELSE 'requeue' END AS status,
      CAST(CASE WHEN failed AND n < 3 THEN 10 * pow(2, n - 1) ELSE -1 END AS BIGINT) AS delay_s
    FROM a""")
def stream_retry(d: Domain) -> DataFrame:
    """S04 with three attempts."""
    outcomes = _live(d, "events")["events"].select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("work_key"), "event_id", "ts",
        F.col("event_type").isin("error", "view").alias("failed"),
    )
    return append_to_table(st.retries(outcomes, max_attempts=3), "stream-retry")


_KIND = """CASE WHEN status IS NULL AND transport LIKE '%timeout%' THEN 'timeout'
  WHEN status IS NULL THEN 'network' WHEN status BETWEEN 200 AND 299 THEN 'ok'
  WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate_limited'
  WHEN status BETWEEN 500 AND 599 THEN 'server' ELSE 'client' END"""


@query("stream_attempts", with_domain("attempt", f"""
    SELECT {DUCK.secs('started_at')} // 3600 * 3600 AS window_s, endpoint, {_KIND} AS outcome,
      count(*) AS attempts FROM attempt GROUP BY ALL"""))
def stream_attempts(d: Domain) -> DataFrame:
    """S05."""
    return st.attempt_metrics(_live(d, "events")["attempt"], what="stream-attempts")


@query("stream_rate", with_domain("attempt", f""",
    w AS (SELECT endpoint, unnest([s // 1800 * 1800, s // 1800 * 1800 - 1800]) AS window_s FROM (
          SELECT endpoint, {DUCK.secs('started_at')} AS s FROM attempt))
    SELECT window_s, endpoint, count(*) AS attempts, count(*) > 5 AS over FROM w GROUP BY ALL"""))
def stream_rate(d: Domain) -> DataFrame:
    """S06."""
    return st.rate_check(_live(d, "events")["attempt"], F.lit(5), what="stream-rate")


@query("stream_mask")
def stream_mask(d: Domain) -> DataFrame:
    """S07."""
    live = _live(d, "conversations")["conversations"].select("conv_id", "turn", "text")
    masked = st.mask_stream(live).select("conv_id", "turn", "masked", "mask_status")
    return append_to_table(masked, "stream-mask").select(
        "conv_id", "turn", "mask_status", F.md5("masked").alias("masked_md5")
    )
