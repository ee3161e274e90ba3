"""Derived tables of a message history: sent texts and drafts, state moves, two listings, list positions."""

from __future__ import annotations

from partsight.sources.domain import Dialect, binding

_TURN_ID = "conv_id * 100 + turn"
_START = 1_704_067_200


@binding("draft_text", "conversations")
def _draft_text(d: Dialect) -> str:
    """A draft for every turn; one in three goes stale after some hours."""
    created = f"{_START} + conv_id * 600 + turn * 60"
    stale = d.ts(f"{created} + (conv_id % 40) * 3600")
    return f"""SELECT {_TURN_ID} AS draft_id, text, {d.ts(created)} AS created_at,
      CASE WHEN ({_TURN_ID}) % 3 = 0 THEN {stale} END AS stale_at FROM {d.ref('conversations')}"""


@binding("sent_text", "conversations")
def _sent_text(d: Dialect) -> str:
    """What was sent: the drafts as they are, with words left out, with another number, or rewritten."""
    sent = d.ts(f"{_START} + conv_id * 600 + turn * 60 + (({_TURN_ID}) % 50) * 3600")
    return f"""SELECT {_TURN_ID} AS message_id, CASE ({_TURN_ID}) % 5 WHEN 0 THEN text WHEN 1 THEN replace(text, ' the', '')
        WHEN 2 THEN concat(text, ' ', CAST(turn AS STRING)) WHEN 3 THEN replace(text, '.', '!') ELSE replace(replace(text, 'a', 'o'), 'e', 'u') END AS text,
      {sent} AS sent_at FROM {d.ref('conversations')}"""


#: The moves that a conversation's state allows.
ALLOWED = {
    "new_request": ("awaiting_info", "researching", "closed"),
    "awaiting_info": ("researching", "closed"),
    "researching": ("awaiting_info", "offer_presented", "closed"),
    "offer_presented": ("awaiting_selection", "awaiting_confirmation", "closed"),
    "awaiting_selection": ("awaiting_confirmation", "researching", "closed"),
    "awaiting_confirmation": ("reservation_pending", "awaiting_selection", "researching", "closed"),
    "reservation_pending": ("completed", "awaiting_selection", "closed"),
    "completed": ("new_request",),
    "closed": ("new_request",),
}


@binding("state_move", "events")
def _state_move(d: Dialect) -> str:
    """Each event asks for a state; the states follow each other often enough to be allowed."""
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ALLOWED))
    return f"""SELECT user_id % 97 AS conversation_id, event_id AS request_id, ts AS moved_at,
      CASE {d.idiv('event_id', '3')} % 10 {cases} ELSE 'unheard_of' END AS target FROM {d.ref('events')}"""


@binding("first_listing", "orders")
def _first_listing(d: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, o_custkey % 50 AS chat, o_orderstatus AS status, o_totalprice AS price
      FROM {d.ref('orders')} WHERE o_orderkey % 197 <> 0"""


@binding("second_listing", "orders")
def _second_listing(d: Dialect) -> str:
    """The listing again: some rows are new, some are gone, one stands twice, some changed."""
    return f"""SELECT o_orderkey AS id, o_custkey % 50 AS chat, CASE WHEN o_orderkey % 389 = 0 THEN 'X' ELSE o_orderstatus END AS status,
      o_totalprice AS price FROM {d.ref('orders')} WHERE o_orderkey % 211 <> 0
      UNION ALL SELECT o_orderkey, o_custkey % 50, o_orderstatus, o_totalprice FROM {d.ref('orders')} WHERE o_orderkey % 499 = 1 AND o_orderkey % 211 <> 0"""


@binding("listed", "lineitem")
def _listed(d: Dialect) -> str:
    """Lists in the order of their ids, with the time that they should be sorted by; list 0 has most of the rows.

    Positions come from the rows before a thousand orders and the place among them, so no task sorts a list.
    """
    of, order = "CASE WHEN l_suppkey % 4 > 0 THEN 0 ELSE l_suppkey % 40 END AS list", "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey"
    if not d.spark:
        return f"""SELECT list, row_number() OVER (PARTITION BY list ORDER BY {order}) - 1 AS position,
        {d.secs('l_shipdate')} AS seen_s
      FROM (SELECT *, {of} FROM {d.ref('lineitem')})"""
    given = f"SELECT *, {of}, {d.idiv('l_orderkey', '1000')} AS thousand FROM {d.ref('lineitem')}"
    earlier = "OVER (PARTITION BY list ORDER BY thousand NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    place = f"row_number() OVER (PARTITION BY g.thousand, g.list ORDER BY {order})"
    return f"""SELECT g.list, coalesce(earlier, 0) + {place} - 1 AS position, {d.secs('l_shipdate')} AS seen_s
      FROM ({given}) g JOIN (SELECT list, thousand, sum(n) {earlier} AS earlier FROM (SELECT list, thousand, count(*) AS n FROM ({given}) c GROUP BY list, thousand) t) b
        ON g.list IS NOT DISTINCT FROM b.list AND g.thousand IS NOT DISTINCT FROM b.thousand"""
