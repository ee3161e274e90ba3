"""Derived tables of selling: sends of unknown fate and what the chats show, requests for holds and the stock they meet."""

from __future__ import annotations

from partsight.sources.domain import Dialect, binding

#: The account that sends for us.
OWN_ID = 1
_CHAT = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 50 END"
_KIND = "CASE WHEN event_id % 7 = 0 THEN 'image' ELSE 'text' END"


@binding("unknown_send", "events")
def _unknown_send(d: Dialect) -> str:
    """A third of the events; chat 0 has a third of them, some never got as far as an intent."""
    return f"""SELECT event_id AS outbox_id, {_CHAT} AS chat_id, {_KIND} AS kind, concat(event_type, ' ', CAST(user_id % 4 AS STRING)) AS text,
      CASE WHEN event_id % 11 <> 0 THEN ts END AS intent_at, CASE WHEN event_id % 121 <> 0 THEN ts - INTERVAL 120 SECOND END AS created_at
      FROM {d.ref('events')} WHERE event_id % 3 = 0"""


@binding("chat_message", "events")
def _chat_message(d: Dialect) -> str:
    """The other events: messages of the account and of others, with another spelling of the texts."""
    text = """CASE event_id % 4 WHEN 0 THEN concat(' ', event_type, '   ', CAST(user_id % 4 AS STRING))
        WHEN 1 THEN concat(upper(event_type), ' ', CAST(user_id % 4 AS STRING), ' ') ELSE concat(event_type, ' ', CAST(user_id % 4 AS STRING)) END"""
    return f"""SELECT event_id AS message_id, {_CHAT} AS chat_id, CASE WHEN event_id % 5 = 0 THEN 7 ELSE {OWN_ID} END AS author_id, {_KIND} AS kind,
      {text} AS text, ts AS created_at FROM {d.ref('events')} WHERE event_id % 3 <> 0"""


@binding("assigned_message", "events")
def _assigned_message(d: Dialect) -> str:
    return f"SELECT event_id AS message_id FROM {d.ref('events')} WHERE event_id % 13 = 1"


#: Items of one shop; a request asks one shop, which its confirmation names.
SHOPS, SHOP_ITEMS = 60, 20
_CONFIRMATION = "o_orderkey - CASE WHEN o_orderkey % 7 = 6 THEN 1 ELSE 0 END"


@binding("hold_request", "orders")
def _hold_request(d: Dialect) -> str:
    """Every order asks for a hold; one in seven repeats the confirmation of the order before it."""
    at = d.ts(f"{d.secs('o_orderdate')} + (o_orderkey * 37) % 86400")
    return f"""SELECT o_orderkey AS request_id, {_CONFIRMATION} AS confirmation_id, ({_CONFIRMATION}) % 6000 AS chat_id, {at} AS requested_at
      FROM {d.ref('orders')}"""


@binding("hold_line", "orders", "lineitem")
def _hold_line(d: Dialect) -> str:
    """Their lines; some ask for nothing and make the request invalid."""
    return f"""SELECT o_orderkey AS request_id, (({_CONFIRMATION}) % {SHOPS}) * {SHOP_ITEMS} + l_partkey % {SHOP_ITEMS} AS item_id,
      CASE WHEN o_orderkey % 53 = 0 AND l_linenumber = 1 THEN 0 ELSE 1 + CAST(l_quantity AS BIGINT) % 3 END AS qty
      FROM {d.ref('orders')} JOIN {d.ref('lineitem')} ON l_orderkey = o_orderkey"""


@binding("hold_stock", "hold_line")
def _hold_stock(d: Dialect) -> str:
    """Stock of all items asked for but a few that nobody has."""
    return f"""SELECT DISTINCT item_id, 10 + item_id % 30 AS available, item_id % 5 AS held FROM {d.ref('hold_line')} WHERE item_id % 97 <> 0"""


@binding("chat_hold", "hold_request")
def _chat_hold(d: Dialect) -> str:
    return f"SELECT DISTINCT chat_id, 1 AS n FROM {d.ref('hold_request')} WHERE chat_id % 41 = 0"


_TOPIC = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END"


@binding("fact", "orders")
def _fact(d: Dialect) -> str:
    """What is said about topics, a third of it about topic 0; the topic decides the kind."""
    start = f"{d.secs('o_orderdate')} + (o_orderkey % 5) * 600"
    return f"""SELECT o_orderkey AS fact_id, {_TOPIC} AS topic, CASE WHEN ({_TOPIC}) % 4 = 1 THEN 'price' ELSE 'policy' END AS kind,
      1 + o_orderkey % 5 AS level, {d.ts(start)} AS valid_from, CASE WHEN o_orderkey % 4 > 0 THEN {d.ts(f'{start} + (o_orderkey % 90) * 43200')} END AS valid_to
      FROM {d.ref('orders')}"""


@binding("kept_message", "events")
def _kept_message(d: Dialect) -> str:
    return f"SELECT event_id AS message_id, user_id AS chat_id, event_type AS class, ts AS created_at, props AS text FROM {d.ref('events')}"


def _sha(d: Dialect, column: str) -> str:
    return f"sha2(CAST({column} AS STRING), 256)" if d.spark else f"sha256(CAST({column} AS STRING))"


@binding("message_stone", "events")
def _message_stone(d: Dialect) -> str:
    """Tombstones of one in seventeen messages, some twice."""
    ref = d.ref("events")
    return f"""SELECT {_sha(d, 'event_id')} AS sha256 FROM {ref} WHERE event_id % 17 = 0
      UNION ALL SELECT {_sha(d, 'event_id')} FROM {ref} WHERE event_id % 51 = 0"""


@binding("chat_stone", "events")
def _chat_stone(d: Dialect) -> str:
    return f"SELECT DISTINCT {_sha(d, 'user_id')} AS sha256 FROM {d.ref('events')} WHERE user_id % 29 = 0"


@binding("keep_policy", "events")
def _keep_policy(d: Dialect) -> str:
    """Days that each class is kept; errors for ever, clicks without a policy."""
    return f"""SELECT DISTINCT event_type AS class, CASE WHEN event_type <> 'error' THEN length(event_type) END AS keep_days
      FROM {d.ref('events')} WHERE event_type <> 'click'"""
