"""X04, X06, X12, X13 and running totals against plain Python: hot keys, ties, nulls, chains, empty tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from partsight.operators import holds
from partsight.operators.facts import ruling_facts
from partsight.operators.holds import hold_requests
from partsight.operators.ordered import dealt, running
from partsight.operators.reconcile import reconcile_sends
from partsight.operators.retention import drop_deleted, past_retention

START = datetime(2024, 1, 1)
SENDS = "outbox_id long, chat_id long, kind string, text string, intent_at timestamp, created_at timestamp"
MESSAGES = "message_id long, chat_id long, author_id long, kind string, text string, created_at timestamp"
REQUESTS, LINES = "request_id long, confirmation_id long, chat_id long, requested_at timestamp", "request_id long, item_id long, qty int"
STOCK, CHAT_HOLDS = "item_id long, available int, held int", "chat_id long, n int"


def test_running_totals_of_a_hot_key_of_one_instant(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aaaaab"), 5 if rnd.random() < 0.8 else rnd.randrange(9), i, rnd.randrange(-9, 9)) for i in range(2000)]
    cut = dealt(spark.createDataFrame(rows, "k string, at int, id int, v int"), ["k"], ["at", "id"])
    got = {r.id: (r.total, r.top) for r in running(cut, ["k"], ["at", "id"], {"total": F.col("v")}, {"top": F.col("v")}).collect()}
    seen, want = defaultdict(list), {}
    for k, _, i, v in sorted(rows, key=lambda r: r[:3]):
        want[i] = (sum(seen[k]), max(seen[k], default=None))
        seen[k].append(v)
    assert got == want


def _queue(sends, messages, assigned, tolerance):
    """The waiting line itself: who came first is served first."""
    plain = lambda kind, text: "" if kind == "image" else " ".join((text or "").lower().split())
    events = defaultdict(list)
    for oid, chat, kind, text, intent, created in sends:
        bound = intent or created
        if chat is not None and kind and bound:
            events[chat, kind, plain(kind, text)].append((bound - timedelta(seconds=tolerance), 0, oid))
    for mid, chat, author, kind, text, created in messages:
        if author == 1 and mid not in assigned and chat is not None and kind and created:
            events[chat, kind, plain(kind, text)].append((created, 1, mid))
    found = {}
    for line in events.values():
        waiting = []
        for at, side, i in sorted(line):
            if side == 0:
                waiting.append(i)
            elif waiting:
                found[waiting.pop(0)] = (i, at)
    return found, events


def _largest(line):
    """The most sends that any assignment can settle: augmenting paths over who may take what."""
    sends, shown = [e for e in line if e[1] == 0], [e for e in line if e[1] == 1]
    holder = {}

    def settle(s, tried):
        for m in shown:
            if m[0] >= s[0] and m not in tried:
                tried.add(m)
                if m not in holder or settle(holder[m], tried):
                    holder[m] = s
                    return True
        return False

    return sum(settle(s, set()) for s in sends)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sends_are_settled_as_by_a_waiting_line(spark, seed):
    rnd = random.Random(seed)
    at = lambda: rnd.choice([None, *[START + timedelta(seconds=rnd.randrange(60 * seed)) for _ in range(9)]])
    text = lambda: rnd.choice(["Hello there", " hello  THERE ", "hello\tthere\n", "no", "", None, "ünü 5"])
    chat, kind = (lambda: rnd.choice([0, 0, 0, 1, 2, None])), (lambda: rnd.choice(["text", "text", "image", None]))
    sends = [(i, chat(), kind(), text(), at(), at()) for i in range(300)]
    messages = [(1000 + i, chat(), rnd.choice([1, 1, 1, 2, None]), kind(), text(), at()) for i in range(300)]
    assigned = set(rnd.sample(range(1000, 1300), 30))
    found = reconcile_sends(
        spark.createDataFrame(sends, SENDS).withColumn("status", F.lit("unknown")).repartition(3), spark.createDataFrame(messages, MESSAGES).repartition(4),
        spark.createDataFrame([(m,) for m in assigned], "message_id long"), 1,
    ).collect()
    want, events = _queue(sends, messages, assigned, 5)
    assert Counter(r.outbox_id for r in found) == Counter(range(300))
    assert {r.outbox_id: (r.message_id, r.sent_at) for r in found if r.status == "sent"} == want
    assert all(r.message_id is None for r in found if r.status == "needs_owner")
    assert sum(map(_largest, events.values())) == len(want)


def test_nothing_sent_nothing_shown(spark):
    sends, messages = spark.createDataFrame([(1, 1, "text", "a", START, START)], SENDS), spark.createDataFrame([], MESSAGES)
    none = spark.createDataFrame([], "message_id long")
    assert [(r.outbox_id, r.status) for r in reconcile_sends(sends, messages, none, 1).collect()] == [(1, "needs_owner")]
    assert reconcile_sends(sends.where("false"), messages, none, 1).count() == 0


def _serve(requests, lines, stock, chat_holds, limit):
    free = {i: a - h for i, a, h in stock}
    used, chats, holds, out = Counter(), Counter(dict(chat_holds)), {}, {}
    asks, bad = defaultdict(Counter), set()
    for r, i, q in lines:
        if i is None or q is None or q <= 0:
            bad.add(r)
        else:
            asks[r][i] += q
    for rid, conf, chat, at in sorted((r for r in requests if None not in r and r[0] in asks and r[0] not in bad), key=lambda r: (r[3], r[0])):
        short = sum(q > free.get(i, 0) - used[i] for i, q in asks[rid].items())
        if conf in holds:
            out[rid] = ("existing", holds[conf], short)
        elif chats[chat] >= limit:
            out[rid] = ("limit", None, short)
        elif short:
            out[rid] = ("stock", None, short)
        else:
            out[rid] = ("held", rid, 0)
            holds[conf] = rid
            chats[chat] += 1
            used.update(asks[rid])
    return {r[0]: out.get(r[0], ("invalid", None, 0)) for r in requests}


def _held(spark, requests, lines, stock, chat_holds, limit):
    frames = [spark.createDataFrame(rows, kinds).repartition(3) for rows, kinds in ((requests, REQUESTS), (lines, LINES), (stock, STOCK), (chat_holds, CHAT_HOLDS))]
    frames[0] = frames[0].withColumns({"key": F.lit("x"), "good": F.lit(1), "n": F.lit(0), "held": F.lit(2)})
    rows = hold_requests(*frames, limit=limit).collect()
    assert len(rows) == len(requests)
    return {r.request_id: (r.status, r.hold_id, r.n_short) for r in rows}


@pytest.mark.parametrize("limit", [1, 3])
def test_holds_equal_serving_one_by_one(spark, limit):
    rnd = random.Random(limit)
    requests = [(i, rnd.choice([i, i // 3, i // 3, None if rnd.random() < 0.1 else i]), rnd.choice([i, i // 4, 5, None if rnd.random() < 0.1 else i]),
                 START + timedelta(seconds=rnd.randrange(90))) for i in range(250)] + [(900, 900, 900, None)]
    # Item 0 is in most requests.
    lines = [(r[0], rnd.choice([0, 0, rnd.randrange(9)]), rnd.choice([1, 1, 2, 5])) for r in requests for _ in range(rnd.randint(1, 3)) if r[0] % 31]
    lines += [(7, None, 1), (8, 1, 0), (9, 1, None), (10, 99, 1), (5000, 0, 3)]
    stock = [(i, rnd.randrange(10, 60), rnd.randrange(5)) for i in range(9)]
    chat_holds = [(5, 1), (17, 3), (18, 0)]
    assert _held(spark, requests, lines, stock, chat_holds, limit) == _serve(requests, lines, stock, chat_holds, limit)


def test_a_chain_of_requests_that_hang_on_each_other(spark):
    n = 6
    requests = [(i, i, i, START + timedelta(seconds=i)) for i in range(n)]
    lines = [(i, j, 1) for i in range(n) for j in (i, i + 1)]
    stock = [(i, 1, 0) for i in range(n + 1)]
    got = _held(spark, requests, lines, stock, [], 1)
    assert [got[i][0] for i in range(n)] == ["held", "stock"] * 3
    assert _held(spark, [], lines, stock, [], 1) == {}
    assert _held(spark, requests, [], stock, [], 1) == {i: ("invalid", None, 0) for i in range(n)}


FACTS = "fact_id long, topic string, kind string, level int, valid_from timestamp, valid_to timestamp"


def _rules_at(facts, at, fresh):
    """The fact that rules one topic at one time."""
    best = None
    for level in (1, 2, 3, 4):
        begun = [(f, i, t) for i, kind, n, f, t in facts if n == level and f <= at and (n == 1 or kind not in ("price", "stock", "hold", "order"))]
        if begun and best is None:
            _, i, end = max(begun, key=lambda b: b[:2])
            if end is None or end > at:
                best = (level, i)
    return best or (None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_facts_rule_as_asked_at_every_time(spark, seed):
    rnd, fresh = random.Random(seed), timedelta(seconds=7)
    at = lambda: START + timedelta(seconds=rnd.randrange(80))
    topics = {"hot": "policy", "dear": "price", "few": None, "late": "stock"}
    rows = []
    for i in range(260):
        topic = rnd.choice(["hot", "hot", "dear", "few", "late", None])
        rows.append((i, topic, topics.get(topic), rnd.choice([1, 2, 2, 3, 4, 5, 9, None]), rnd.choice([at(), at(), None]), rnd.choice([None, at(), at()])))
    rows.append((999, "style", "policy", 5, START, None))
    got = defaultdict(list)
    for r in ruling_facts(spark.createDataFrame(rows, FACTS).withColumns({"bucket": F.lit(1), "start": F.lit(2)}).repartition(4), 7).collect():
        got[r.topic].append((r.since, r.level, r.fact_id))
    known = defaultdict(list)
    for i, topic, kind, level, start, end in rows:
        if topic and level and start:
            end = min(filter(None, (end, start + fresh))) if level == 1 else end
            if end is None or end > start:
                known[topic].append((i, kind, level, start, end))
    want = {}
    for topic, facts in known.items():
        want[topic], before = [], None
        for second in range(-1, 200):
            now = START + timedelta(seconds=second)
            rules = _rules_at(facts, now, fresh)
            if now >= min(f[3] for f in facts) and rules != before:
                want[topic].append((now, *rules))
                before = rules
    assert {t: sorted(v, key=lambda r: r[0]) for t, v in got.items()} == want
    assert ruling_facts(spark.createDataFrame([], FACTS)).count() == 0


def test_deleted_stays_deleted_and_time_runs_out(spark):
    sha = lambda v: hashlib.sha256(str(v).encode()).hexdigest()
    messages = [(i if i % 7 else None, i % 5 if i % 11 else None, "x" * i) for i in range(60)] * 2
    df = spark.createDataFrame(messages, "message_id long, chat_id long, sha256 string").repartition(3)
    stones = spark.createDataFrame([(sha(i),) for i in (1, 2, 2, 30, 500)] + [(None,)], "sha256 string")
    chats = spark.createDataFrame([(sha(3),)], "sha256 string")
    got = Counter(tuple(r) for r in drop_deleted(df, stones, chats).collect())
    assert got == Counter(m for m in messages if m[0] not in (1, 2, 30) and m[1] != 3)
    assert drop_deleted(df, stones.where("false"), chats.where("false")).count() == len(messages)
    records = [(i, rnd, START + timedelta(days=i)) for i in range(6) for rnd in ("raw", "hook", "audit", None)] + [(9, "raw", None)]
    policy = spark.createDataFrame([("raw", 3), ("raw", 9), ("hook", 0), ("audit", None)], "class string, keep_days int")
    due = past_retention(spark.createDataFrame(records, "id long, class string, created_at timestamp"), policy, START + timedelta(days=4))
    assert {(r.id, r["class"]) for r in due.collect()} == {(0, "raw"), (1, "raw"), *((i, "hook") for i in range(5))}


@pytest.mark.parametrize("front, growth", [(1, 2), (7, 3), (40, 16)])
def test_holds_do_not_depend_on_the_length_of_the_front(spark, monkeypatch, front, growth):
    """Several fronts, also of requests of one instant; scarce items refuse most of what comes later."""
    monkeypatch.setattr(holds, "FRONT", front)
    monkeypatch.setattr(holds, "GROWTH", growth)
    fronts, settled = [], holds._settled
    monkeypatch.setattr(holds, "_settled", lambda rows: fronts.append(rows) or settled(rows))
    rnd = random.Random(front)
    requests = [(i, rnd.choice([i, i - 1]), rnd.randrange(40), START + timedelta(minutes=rnd.randrange(30))) for i in range(90)]
    lines = [(i, rnd.randrange(12), rnd.randint(1, 3)) for i in range(90) for _ in range(rnd.randint(1, 3))]
    stock = [(k, rnd.randint(3, 60), rnd.randint(0, 2)) for k in range(12)]
    assert _held(spark, requests, lines, stock, [(3, 1)], 2) == _serve(requests, lines, stock, [(3, 1)], 2)
    assert len(fronts) > 1
