"""Queries of selling."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from partsight.operators.facts import FIRST_HAND_KINDS, FRESH_SECONDS, ruling_facts
from partsight.operators.holds import hold_requests
from partsight.operators.reconcile import TOLERANCE_SECONDS, reconcile_sends
from partsight.operators.retention import drop_deleted, past_retention
from partsight.plans.registry import query
from partsight.sources.commerce import OWN_ID, SHOP_ITEMS, SHOPS
from partsight.sources.domain import Domain, with_domain

_HASH = "CASE WHEN kind = 'image' THEN '' ELSE sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) END"


@query("send_reconcile", with_domain("unknown_send chat_message assigned_message", f""",
    asked AS (SELECT outbox_id AS id, chat_id, kind, {_HASH} AS hash, coalesce(intent_at, created_at) - INTERVAL {TOLERANCE_SECONDS} SECOND AS due, 0 AS side FROM unknown_send),
    shown AS (SELECT message_id AS id, chat_id, kind, {_HASH} AS hash, created_at AS due, 1 AS side FROM chat_message
      WHERE author_id = {OWN_ID} AND message_id NOT IN (SELECT message_id FROM assigned_message)),
    line AS (SELECT *, row_number() OVER (PARTITION BY chat_id, kind, hash ORDER BY due, side, id) AS n
      FROM (SELECT * FROM asked WHERE due IS NOT NULL UNION ALL SELECT * FROM shown)),
    walk AS (SELECT chat_id, kind, hash, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS waiting, CAST(NULL AS BIGINT) AS outbox_id, CAST(NULL AS BIGINT) AS message_id, CAST(NULL AS TIMESTAMP) AS sent_at
        FROM (SELECT DISTINCT chat_id, kind, hash FROM line)
      UNION ALL SELECT l.chat_id, l.kind, l.hash, l.n, CASE WHEN side = 0 THEN list_append(waiting, id) ELSE waiting[2:] END,
        CASE WHEN side = 1 THEN waiting[1] END, CASE WHEN side = 1 THEN id END, CASE WHEN side = 1 THEN due END
      FROM walk w JOIN line l ON l.chat_id = w.chat_id AND l.kind = w.kind AND l.hash = w.hash AND l.n = w.n + 1)
    SELECT u.outbox_id, u.chat_id, CASE WHEN w.message_id IS NULL THEN 'needs_owner' ELSE 'sent' END AS status, w.message_id, w.sent_at
    FROM unknown_send u LEFT JOIN walk w ON w.outbox_id = u.outbox_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def send_reconcile(d: Domain) -> DataFrame:
    """X04."""
    return reconcile_sends(d["unknown_send"], d["chat_message"], d["assigned_message"], OWN_ID)


_ASKS = ", ".join(f"coalesce(sum(qty) FILTER (item_id % {SHOP_ITEMS} = {i}), 0)" for i in range(SHOP_ITEMS))
_FREE = ", ".join(f"coalesce(max(available - held) FILTER (item_id % {SHOP_ITEMS} = {i}), 0)" for i in range(SHOP_ITEMS))


@query("multi_hold", with_domain("hold_request hold_line hold_stock chat_hold", f""",
    asks AS (SELECT request_id, bool_and(qty > 0) AS good, CAST([{_ASKS}] AS BIGINT[]) AS ask FROM hold_line GROUP BY request_id),
    valid AS (SELECT r.request_id, confirmation_id, r.chat_id, confirmation_id % {SHOPS} AS shop, ask, coalesce(h.n, 0) AS before,
        row_number() OVER (PARTITION BY confirmation_id % {SHOPS} ORDER BY requested_at, r.request_id) AS n
      FROM hold_request r JOIN asks USING (request_id) LEFT JOIN chat_hold h ON h.chat_id = r.chat_id WHERE good),
    shops AS (SELECT v.shop, CAST([{_FREE}] AS BIGINT[]) AS free
      FROM (SELECT DISTINCT shop FROM valid) v LEFT JOIN hold_stock s ON s.item_id // {SHOP_ITEMS} = v.shop GROUP BY v.shop),
    walk AS (SELECT shop, CAST(0 AS BIGINT) AS n, free, CAST([] AS BIGINT[]) AS chats, CAST([] AS BIGINT[]) AS confirmations, CAST([] AS BIGINT[]) AS holds,
        CAST(NULL AS BIGINT) AS request_id, '' AS status, CAST(NULL AS BIGINT) AS hold_id, CAST(0 AS BIGINT) AS n_short FROM shops
      UNION ALL SELECT shop, n, CASE WHEN status = 'held' THEN [z[1] - z[2] FOR z IN list_zip(free, ask)] ELSE free END,
        CASE WHEN status = 'held' THEN list_append(chats, chat_id) ELSE chats END,
        CASE WHEN status = 'held' THEN list_append(confirmations, confirmation_id) ELSE confirmations END,
        CASE WHEN status = 'held' THEN list_append(holds, request_id) ELSE holds END, request_id, status,
        CASE status WHEN 'held' THEN request_id WHEN 'existing' THEN holds[list_position(confirmations, confirmation_id)] END, n_short
      FROM (SELECT *, CASE WHEN list_contains(confirmations, confirmation_id) THEN 'existing' WHEN before > 0 OR list_contains(chats, chat_id) THEN 'limit'
            WHEN n_short > 0 THEN 'stock' ELSE 'held' END AS status
          FROM (SELECT w.shop, v.n, free, ask, chats, confirmations, holds, v.request_id, confirmation_id, chat_id, before,
              CAST(len([1 FOR z IN list_zip(free, ask) IF z[2] > 0 AND z[1] < z[2]]) AS BIGINT) AS n_short
            FROM walk w JOIN valid v ON v.shop = w.shop AND v.n = w.n + 1)))
    SELECT r.request_id, coalesce(w.status, 'invalid') AS status, w.hold_id, coalesce(w.n_short, 0) AS n_short
    FROM hold_request r LEFT JOIN walk w ON w.request_id = r.request_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def multi_hold(d: Domain) -> DataFrame:
    """X06."""
    return hold_requests(d["hold_request"], d["hold_line"], d["hold_stock"], d["chat_hold"])


_KINDS = ", ".join(f"'{k}'" for k in FIRST_HAND_KINDS)


@query("fact_ruling", with_domain("fact", f""",
    said AS (SELECT topic, level, fact_id, valid_from, CASE WHEN level = 1 THEN least(valid_to, valid_from + INTERVAL {FRESH_SECONDS} SECOND) ELSE valid_to END AS valid_to,
      level < 5 AND (level = 1 OR kind NOT IN ({_KINDS})) AS hears FROM fact),
    good AS (SELECT * FROM said WHERE valid_to IS NULL OR valid_to > valid_from),
    times AS (SELECT topic, valid_from AS since FROM good UNION SELECT topic, valid_to FROM good WHERE hears AND valid_to IS NOT NULL),
    last AS (SELECT t.topic, since, level, max((valid_from, fact_id, valid_to)) AS f FROM times t JOIN good g ON g.topic = t.topic AND valid_from <= since AND hears
      GROUP BY t.topic, since, level),
    top AS (SELECT topic, since, min((level, f[2])) AS r FROM last WHERE f[3] IS NULL OR f[3] > since GROUP BY topic, since),
    line AS (SELECT t.topic, t.since, r[1] AS level, r[2] AS fact_id, row_number() OVER w AS n, lag(r[2]) OVER w AS before
      FROM times t LEFT JOIN top ON top.topic = t.topic AND top.since = t.since WINDOW w AS (PARTITION BY t.topic ORDER BY t.since))
    SELECT topic, since, CAST(level AS INTEGER) AS level, fact_id FROM line WHERE n = 1 OR before IS DISTINCT FROM fact_id"""))
def fact_ruling(d: Domain) -> DataFrame:
    """X13."""
    return ruling_facts(d["fact"])


@query("deleted_dropped", with_domain("kept_message message_stone chat_stone", """
    SELECT message_id, chat_id, class, created_at, text FROM kept_message
    WHERE sha256(CAST(message_id AS STRING)) NOT IN (SELECT sha256 FROM message_stone) AND sha256(CAST(chat_id AS STRING)) NOT IN (SELECT sha256 FROM chat_stone)"""))
def deleted_dropped(d: Domain) -> DataFrame:
    """Tombstones."""
    return drop_deleted(d["kept_message"], d["message_stone"], d["chat_stone"])


_AS_OF = "2024-01-08 12:00:00"


@query("retention_due", with_domain("kept_message keep_policy", f"""
    SELECT message_id, m.class, created_at FROM kept_message m JOIN keep_policy p ON p.class = m.class
    WHERE created_at + to_days(CAST(keep_days AS INTEGER)) <= TIMESTAMP '{_AS_OF}'"""))
def retention_due(d: Domain) -> DataFrame:
    """Retention."""
    return past_retention(d["kept_message"].select("message_id", "class", "created_at"), d["keep_policy"], datetime.fromisoformat(_AS_OF))
