"""Queries of the message history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partsight.operators import history as hs
from partsight.operators import similarity as sm
from partsight.plans.registry import query
from partsight.sources.domain import Domain, with_domain
from partsight.sources.history import ALLOWED

_SETS = r"""
    m AS (SELECT message_id, sent_at, list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF w <> ''])) AS w,
      regexp_extract_all(text, '[0-9]+') AS digits FROM sent_text),
    d AS (SELECT draft_id, created_at, stale_at, list_sort(list_distinct([w FOR w IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF w <> ''])) AS w,
      regexp_extract_all(text, '[0-9]+') AS digits FROM draft_text),
    p AS (SELECT message_id, sent_at, d.*, len(list_intersect(m.w, d.w)) AS common, len(m.w) + len(d.w) - len(list_intersect(m.w, d.w)) AS total
      FROM m JOIN d ON created_at <= sent_at AND len(m.w) > 0 AND 100 * least(len(m.w), len(d.w)) >= 60 * greatest(len(m.w), len(d.w))),
    near AS (SELECT *, row_number() OVER (PARTITION BY message_id, w ORDER BY created_at DESC, draft_id) AS newest FROM p WHERE 100 * common >= 60 * total),
    best AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY CAST(common AS DOUBLE) / total DESC, created_at DESC, draft_id) AS place
      FROM near WHERE newest = 1 AND (stale_at IS NULL OR stale_at + INTERVAL 24 HOUR >= sent_at))"""


@query("draft_match", with_domain("sent_text draft_text", "," + _SETS + """
    SELECT m.message_id, b.draft_id, CAST(1000 * b.common // b.total AS INTEGER) AS similarity,
      coalesce(m.digits = b.digits, false) AS digits_kept
    FROM m LEFT JOIN best b ON b.message_id = m.message_id AND place = 1"""))
def draft_match(d: Domain) -> DataFrame:
    """X05."""
    return sm.match_drafts(d["sent_text"], d["draft_text"])


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, targets in ALLOWED.items() for b in targets)


@query("state_replay", with_domain("state_move", f""",
    allowed AS (SELECT * FROM (VALUES {_PAIRS}) AS v(f, t)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY moved_at, request_id) AS n FROM state_move),
    walk AS (SELECT conversation_id, CAST(0 AS BIGINT) AS n, 'new_request' AS state, CAST(0 AS BIGINT) AS accepted
        FROM (SELECT DISTINCT conversation_id FROM state_move)
      UNION ALL SELECT w.conversation_id, s.n, CASE WHEN a.f IS NULL THEN w.state ELSE s.target END,
        w.accepted + CASE WHEN a.f IS NULL THEN 0 ELSE 1 END
      FROM walk w JOIN numbered s ON s.conversation_id = w.conversation_id AND s.n = w.n + 1
      LEFT JOIN allowed a ON a.f = w.state AND a.t = s.target)
    SELECT conversation_id, arg_max(state, n) AS state, max(accepted) AS accepted, max(n) - max(accepted) AS refused
    FROM walk GROUP BY conversation_id""").replace("WITH ", "WITH RECURSIVE ", 1))
def state_replay(d: Domain) -> DataFrame:
    """X10."""
    return hs.replay_states(d["state_move"].withColumnRenamed("moved_at", "at"), ALLOWED, "new_request")


_LISTED = with_domain("first_listing second_listing", """,
    a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chat, status, price) AS no FROM first_listing),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chat, status, price) AS no FROM second_listing),
    x AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.chat, b.chat) AS chat, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'missing'
        ELSE 'changed' END AS change, a.status AS before, b.status AS after
      FROM a FULL JOIN b ON a.id = b.id AND a.no = b.no
      WHERE a.id IS NULL OR b.id IS NULL OR (a.chat, a.status, a.price) IS DISTINCT FROM (b.chat, b.status, b.price))""")


def _changes(d: Domain) -> DataFrame:
    found = hs.compare_listings(d["first_listing"], d["second_listing"], "id", ["chat", "status", "price"])
    return found.select(
        "id", F.coalesce("first.chat", "second.chat").alias("chat"), "change",
        F.col("first.status").alias("before"), F.col("second.status").alias("after"),
    )


@query("import_changes", _LISTED + " SELECT id, chat, change, coalesce(before, '-') AS before, coalesce(after, '-') AS after FROM x")
def import_changes(d: Domain) -> DataFrame:
    """X11: what differs between two listings."""
    return _changes(d).fillna("-", ["before", "after"])


@query("import_report", _LISTED + """
    SELECT c.chat, c.n AS listed, count(x.id) FILTER (change = 'new') AS n_new, count(x.id) FILTER (change = 'missing') AS n_missing,
      count(x.id) FILTER (change = 'changed') AS n_changed, CASE WHEN count(x.id) FILTER (change = 'new') > 0 THEN 'partial' ELSE 'complete' END AS status
    FROM (SELECT chat, count(*) AS n FROM first_listing GROUP BY chat) c LEFT JOIN x ON x.chat = c.chat GROUP BY c.chat, c.n""")
def import_report(d: Domain) -> DataFrame:
    """X11: per chat, complete only if the second listing shows nothing new."""
    of = {f"n_{c}": F.count_if(F.col("change") == c) for c in ("new", "missing", "changed")}
    changes = _changes(d).groupBy("chat").agg(*(c.alias(n) for n, c in of.items()))
    chats = d["first_listing"].groupBy("chat").agg(F.count(F.lit(1)).alias("listed"))
    return chats.join(changes, "chat", "left").fillna(0, list(of)).withColumn(
        "status", F.when(F.col("n_new") > 0, "partial").otherwise("complete")
    )


@query("list_inversions", with_domain("listed", """
    SELECT list, count(*) AS n, CAST(sum(before) AS BIGINT) AS inversions FROM (
      SELECT a.list, a.position, (SELECT count(*) FROM listed b WHERE b.list = a.list AND b.position < a.position AND b.seen_s > a.seen_s) AS before
      FROM listed a) GROUP BY list"""))
def list_inversions(d: Domain) -> DataFrame:
    """X18 (M1): how far each list is from the order of its times."""
    return hs.inversions(d["listed"], "list", "position", "seen_s")
