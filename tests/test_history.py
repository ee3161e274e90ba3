"""X05, X10, X11, X18 against plain Python, with hot keys, ties, nulls and empty tables."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from partsight.operators import history as hs
from partsight.operators import similarity as sm
from partsight.operators.numbering import last_at_or_before
from partsight.sources.domain import Domain
from partsight.sources.history import ALLOWED

START = datetime(2024, 1, 1)
MESSAGES, DRAFTS = "message_id long, text string, sent_at timestamp", "draft_id long, text string, created_at timestamp, stale_at timestamp"


def _words(text):
    return frozenset(w for w in re.split(r"[\W_]+", (text or "").lower()) if w)


def _match(messages, drafts, percent):
    out = {}
    for mid, text, sent in messages:
        mine, best = _words(text), None
        newest = {}
        for did, draft, created, stale in drafts:
            words = _words(draft)
            if words and created <= sent and (words not in newest or (created, -did) > newest[words][:2]):
                newest[words] = (created, -did, stale, draft)
        for words, (created, minus, stale, draft) in newest.items():
            common, whole = len(mine & words), len(mine | words)
            if mine and 100 * common >= percent * whole and (stale is None or stale + timedelta(hours=24) >= sent):
                rank = (common / whole, created, minus)
                if best is None or rank > best[0]:
                    best = (rank, 1000 * common // whole, re.findall("[0-9]+", text) == re.findall("[0-9]+", draft))
        out[mid] = (None, None, False) if best is None else (-best[0][2], best[1], best[2])
    return out


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_drafts_match_as_by_all_pairs(spark, percent):
    rnd = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12))) for _ in range(25)] + ["", None, "!!", "same 5", "SAME, 5!"]
    at = lambda: START + timedelta(hours=rnd.randrange(200))
    drafts = [(i, rnd.choice(texts), at(), rnd.choice([None, at()])) for i in range(150)]
    drafts += [(1000 + i, "same 5", START + timedelta(hours=i // 3), None) for i in range(90)]
    messages = [(i, rnd.choice(texts) if rnd.random() < 0.6 else (rnd.choice(texts) or "") + rnd.choice([" w1", " 7", ""]), at()) for i in range(120)]
    found = sm.match_drafts(spark.createDataFrame(messages, MESSAGES).repartition(3), spark.createDataFrame(drafts, DRAFTS).repartition(3), percent)
    assert {r[0]: tuple(r)[1:] for r in found.select("message_id", "draft_id", "similarity", "digits_kept").collect()} == _match(messages, drafts, percent)


def test_no_drafts_and_no_messages(spark):
    one = spark.createDataFrame([(1, "a b", START)], MESSAGES)
    none = spark.createDataFrame([], DRAFTS)
    assert [tuple(r) for r in sm.match_drafts(one, none).select("message_id", "draft_id").collect()] == [(1, None)]
    assert sm.match_drafts(one.where("false"), none).count() == 0


@pytest.mark.parametrize("seconds", [3600, 10**7])
def test_last_offer_is_carried_over_buckets(spark, seconds):
    rnd = random.Random(1)
    at = lambda: START + timedelta(minutes=rnd.randrange(6000))
    offers = [(rnd.choice("aab"), at(), i) for i in range(60)]
    asks = [(rnd.choice("aabc"), at(), i) for i in range(200)]
    got = last_at_or_before(
        spark.createDataFrame(asks, "k string, at timestamp, n int"), spark.createDataFrame(offers, "k string, at timestamp, v int"), ["k"], "at", "v", seconds
    )
    want = {n: max(((t, v) for k2, t, v in offers if k2 == k and t <= a), default=None) for k, a, n in asks}
    assert {r.n: r.v for r in got.collect()} == {n: w[1] for n, w in want.items() if w}


def test_states_are_replayed_across_partitions(spark):
    rnd = random.Random(4)
    names = [*ALLOWED, "nowhere"]
    rows = [(rnd.choice([1, 1, 1, 1, 2, None]), START + timedelta(seconds=rnd.randrange(500)), i, rnd.choice([*names, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "conversation_id long, at timestamp, request_id long, target string").repartition(7)
    want = {}
    for key, _, _, target in sorted(rows, key=lambda r: (r[1], r[2])):
        state, accepted, refused = want.get(key, ("new_request", 0, 0))
        good = target in ALLOWED[state]
        want[key] = (target if good else state, accepted + good, refused + (not good))
    got = {r[0]: tuple(r)[1:] for r in hs.replay_states(df, ALLOWED, "new_request").collect()}
    assert got == want
    assert hs.replay_states(df.where("false"), ALLOWED, "new_request").count() == 0


def test_listings_differ_by_rows(spark):
    rnd = random.Random(5)
    first = [(i % 300, rnd.randrange(3), rnd.choice(["x", None])) for i in range(400)]
    second = [r for r in first if rnd.random() < 0.9] + [(1000 + i, 1, "y") for i in range(20)] + [(None, 1, "n")]
    kinds = "id long, a int, b string"
    a, b = spark.createDataFrame(first, kinds).repartition(3), spark.createDataFrame(second, kinds).repartition(4)
    found = hs.compare_listings(a, b, "id", ["a", "b"], ranges=16).collect()

    def by_key(rows):
        out = {}
        for k, x, y in rows:
            out.setdefault(k, []).append((x, y))
        return {k: sorted(v, key=lambda r: (r[0], r[1] is not None, r[1] or "")) for k, v in out.items()}

    one, two, want = by_key(first), by_key(second), []
    for k in one.keys() | two.keys():
        x, y = one.get(k, []), two.get(k, [])
        for i in range(max(len(x), len(y))):
            p, q = x[i] if i < len(x) else None, y[i] if i < len(y) else None
            if p != q:
                want.append((k, "new" if p is None else "missing" if q is None else "changed", p, q))
    got = [(r.id, r.change, r.first and tuple(r.first), r.second and tuple(r.second)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert hs.compare_listings(a, a.repartition(2), "id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("block", [7, 100, 20_000])
def test_inversions_equal_counting_pairs(spark, block):
    rnd = random.Random(block)
    lists = {
        "hot": [rnd.randrange(40) for _ in range(600)], "ties": [3] * 300, "down": list(range(200, 0, -1)), "up": list(range(150)),
        "one": [5], "many": [rnd.random() for _ in range(400)],
    }
    rows = [(k, i, float(v)) for k, values in lists.items() for i, v in enumerate(values)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "list string, position long, v double").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in hs.inversions(df, "list", "position", "v", block_rows=block).collect()}
    assert got == {k: (len(v), sum(v[i] > v[j] for j in range(len(v)) for i in range(j))) for k, v in lists.items()}
    assert hs.inversions(df.where("false"), "list", "position", "v").count() == 0


def test_similar_sets_lose_no_pair(spark):
    rnd = random.Random(9)
    sets = [sorted(rnd.sample([f"w{i}" for i in range(14)], rnd.randint(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "set_key string, words array<string>")
    got = {(r.left_key, r.right_key) for r in sm.similar_sets(df, df, 70).collect()}
    assert got == {(str(i), str(j)) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len({*a} & {*b}) >= 70 * len({*a} | {*b})}
    assert sm.digit_runs(F.lit("a12b3")) is not None


def test_positions_number_each_list_without_gaps(spark, tmp_path):
    """Rows of several thousands of orders, some without an order or a supplier; the plan numbers no whole list."""
    rnd = random.Random(3)
    some = lambda n: None if rnd.random() < 0.05 else rnd.randrange(n)
    rows = [(some(5000), rnd.randrange(1, 8), START + timedelta(days=rnd.randrange(300)), some(50), some(80)) for _ in range(900)]
    schema = "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_partkey long, l_suppkey long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    listed = Domain(spark, str(tmp_path))["listed"]
    want, n = [], {}
    for r in sorted(rows, key=lambda r: [(v is not None, 0 if v is None else v) for v in r[:2]] + [(True, r[2])] + [(v is not None, v or 0) for v in r[3:]]):
        key = 0 if r[4] is not None and r[4] % 4 > 0 else None if r[4] is None else r[4] % 40
        want.append((key, n.get(key, 0), int((r[2] - datetime(1970, 1, 1)).total_seconds())))
        n[key] = n.get(key, 0) + 1
    assert sorted(map(tuple, listed.collect()), key=str) == sorted(want, key=str)
    whole = [line for line in listed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert whole and all("thousand" in line for line in whole)


def test_a_value_finds_its_range_by_halving(spark):
    """Ten blocks of a list with repeated, negative and equal values; each row compares with few bounds."""
    rnd = random.Random(8)
    values = [rnd.choice([-5, 0, 0, 7, rnd.randrange(-300, 300)]) for _ in range(1000)]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "list string, position long, v long")
    found = hs.inversions(df, "list", "position", "v", block_rows=100)
    assert found.collect()[0].inversions == sum(values[i] > values[j] for j in range(1000) for i in range(j))
    groups = np.sort(np.array([rnd.randrange(30) for _ in values]))
    want = sum(values[i] > values[j] and groups[i] != groups[j] for j in range(1000) for i in range(j))
    assert hs._later_smaller(np.array(values), groups) == want


def test_sets_that_cannot_share_enough_never_meet(spark):
    """Pairs of sets are written by short keys, and only if the words from the first common one on can be enough."""
    texts = spark.createDataFrame([(1, "a b c d e f g h i k"), (2, "z y x w e f g h i k")], "id long, text string")
    _, sets = sm._sets(texts, "id", "text")
    assert {r["n"] for r in sets.select(F.octet_length("set_key").alias("n")).collect()} == {16}
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate("abcdzyxwefghik")], "word string, texts long")
    met = sm.meeting_sets(sm._prefixes(sets, ranks, 60), sm._prefixes(sets, ranks, 60), 60).where("left_key <> right_key")
    assert met.count() == 0


def test_sets_that_differ_too_much_are_dropped_where_they_meet(spark):
    """Pairs of texts that share their rarest words and little else grow with the square of the texts; none is written."""
    rnd = random.Random(6)
    sets = [("rare", "seldom", *(f"w{i}_{rnd.randrange(40)}" for i in range(40))) for _ in range(30)]
    sets += [(*s[:-1], "other") for s in sets[:5]] + [("rare", "seldom", *(f"w{i}" for i in range(600)))]
    df = spark.createDataFrame([(str(i), [*s]) for i, s in enumerate(sets)], "set_key string, words array<string>")
    ranks = df.select(F.explode("words").alias("word")).select("word", F.when(F.col("word").isin("rare", "seldom"), 0).otherwise(1).alias("texts"))
    found = sm.meeting_sets(sm._prefixes(df, ranks, 60), sm._prefixes(df, ranks, 60), 60).distinct()
    alike = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len({*a} & {*b}) >= 60 * len({*a} | {*b})}
    assert len(alike) == 46 and found.count() == 46
    assert {(int(r.left_key), int(r.right_key)) for r in sm.similar_sets(df, df, 60).collect()} == alike


def test_rows_of_a_list_are_not_shuffled_to_be_placed(spark, monkeypatch):
    """The few facts about each list are stored: joined as they are computed they pass for as large as the rows."""
    rnd = random.Random(4)
    values = [rnd.randrange(10**9) for _ in range(20_000)]
    df = spark.createDataFrame([("x" if i % 50 else "y", i // 50 if i % 50 == 0 else i - i // 50 - 1, v) for i, v in enumerate(values)], "list string, position long, v long")
    plans, stored = {}, hs.stored

    def kept(rows, what="rows"):
        plans[what] = rows._jdf.queryExecution().executedPlan().toString()
        return stored(rows, what)

    monkeypatch.setattr(hs, "stored", kept)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "30k")
    try:
        found = {r.list: (r.n, r.inversions) for r in hs.inversions(df, "list", "position", "v", block_rows=5000).collect()}
    finally:
        spark.conf.set(threshold, before)
    assert "BroadcastHashJoin" in plans["cells"] and "SortMergeJoin" not in plans["cells"]
    for name, some in (("x", [v for i, v in enumerate(values) if i % 50]), ("y", values[::50])):
        v = np.array(some)
        assert found[name] == (len(v), sum(int((v[:j] > v[j]).sum()) for j in range(len(v))))
