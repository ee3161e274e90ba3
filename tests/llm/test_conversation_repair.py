"""Conversation repair against a search over all edits, on odd conversations, and past the spill."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from partsight.llm import conversation_repair as cr
from partsight.llm import queries

TURNS = "conv_id long, turn long, role string, text string, back string, state int"
BLANK, END = re.compile(r"[\x20\x09-\x0D]*"), re.compile(r"(?s).*[.!?][\x20\x09-\x0D]*")


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (turn, role, text) rows in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        if BLANK.fullmatch(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if END.fullmatch(text) else "truncated")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 4:
            for r in follows[last].replace("s", ""):
                cost, audit, kept = best(i, r, inserts + 1)
                options.append((cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[r], ""), *kept)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, kept = best(i + 1, last, 0)
            options.append((cost + 4, "D" + audit, kept))
            if faults[i] not in ("blank", "duplicate"):
                worse = 3 if faults[i] == "truncated" else 0
                if role[:1] and role[:1] in follows[last]:
                    cost, audit, kept = best(i + 1, role[:1], 0)
                    options.append((cost + worse, "K" + audit, ((role, text), *kept)))
                for r in follows[last].replace("s", ""):
                    cost, audit, kept = best(i + 1, r, 0)
                    options.append((cost + worse + 3, "R" + audit, (({"u": "user", "a": "assistant"}[r], text), *kept)))
        return min(options, default=(10**9, "", ()))

    cost, audit, kept = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    lines = "\n".join(f"{r}:{t}" for r, t in kept)
    counts = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()), kept


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["", " \t\n", "one.", "two", "three!", "four? ", "five", "six.", "seven\n\n", "é."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", "speaker", "answer"]
    found = {}
    for c in range(n):
        size = r.choice([1, 1, 2, 3, 4, 5, 6, 8])
        rows = [(r.choice([None, *range(10)]), r.choice(roles[: r.choice([3, 5, 10])]), r.choice(texts)) for _ in range(size)]
        found[c] = rows + [rows[0]] * r.choice([0, 0, 1, 2])
    return found


def frame(spark, found, parts=3):
    rows = [(c, *row, "x", 1) for c, rows in found.items() for row in rows]
    return spark.createDataFrame(rows, TURNS).repartition(parts)


@pytest.mark.parametrize("spill", [1 << 20, 2])
def test_equals_a_search_over_all_edits(spark, monkeypatch, spill):
    monkeypatch.setattr(cr, "SPILL_ROWS", spill)
    found = conversations(1, 250) | {None: [(0, "user", "a."), (2, "assistant", "b.")]}
    rows = cr.prepared(frame(spark, found))
    if spill == 2:  # in this process: tasks read the constant from the module
        assert _streamed(rows) == {c: brute(ordered(r))[0] for c, r in found.items()}
        return
    repairs = cr.repair(rows)
    got = {r[0]: tuple(r)[1:] for r in repairs.collect()}
    assert got == {c: brute(ordered(r))[0] for c, r in found.items()}
    kept: dict = {c: [] for c in found}
    for r in cr.repaired_turns(rows, repairs).orderBy("conv_id", "place").collect():
        assert r["place"] == len(kept[r["conv_id"]])
        kept[r["conv_id"]].append((r["role"], r["text"]))
    assert kept == {c: list(brute(ordered(r))[1]) for c, r in found.items()}


def _streamed(rows):
    """The two streams by hand, in one process, with small batches."""
    table = rows.orderBy("conv", "has_turn", "turn", "role", "text", "again").toPandas()
    batches = [table[i : i + 7].reset_index(drop=True) for i in range(0, len(table), 7)]
    out = [r for f in cr._search_stream(iter(batches)) for r in f.itertuples(index=False)]
    blocks = [r for r in out if r.block is not None]
    assert blocks and any(r.spilled for r in out if r.block is None)
    keys = sorted({r.conv for r in blocks}, key=str)
    before = {k: "" for k in keys}
    back = sorted(blocks, key=lambda r: (str(r.conv), -r.block))
    for f in cr._trace_stream(iter([cr._frame([tuple(r) for r in back[i : i + 3]], cr._STREAM_COLUMNS) for i in range(0, len(back), 3)])):
        for r in f.itertuples(index=False):
            before[r.conv] = r.edits + before[r.conv]
    return {
        None if r.conv is None else int(r.conv): (*r[5:11], before.get(r.conv, "") + r.audit, r.repaired_sha256)
        for r in out
        if r.block is None
    }


def test_a_long_conversation_spills_and_ends_whole(spark):
    search = cr.Search()
    conversation, want = cr._Conversation(search, "1"), cr._Conversation(search, "1")
    r = random.Random(3)
    pieces = []
    for i in range(30_000):
        given = (i, r.choice(["user", "assistant", "tool"]), r.choice(["a.", "b", ""]), r.random() < 0.1)
        conversation.add(*given)
        want.add(*given)
        if len(conversation.back) >= 4 * 1000:
            pieces.append(conversation.block())
    *last, summary = conversation.ended()
    pieces += last
    state, audit = pieces[-1][3], ""
    for piece in reversed(pieces):
        edits, state = cr._trace(zlib.decompress(piece[2]), state)
        audit = edits + audit
    assert audit + summary[-2] == want.ended()[-1][-2] and len(search.steps) < 2_000
    assert summary[-1] == want.ended()[-1][-1] and summary[4]


def test_absent_rows_and_empty_tables(spark):
    found = {1: [(0, "user", "a."), (1, "assistant", "b.")], 2: [(0, "user", "a.")]}
    rows = frame(spark, found)
    repairs = {r[0]: tuple(r)[1:] for r in cr.repair(cr.prepared(rows, present=rows["conv_id"] != 2)).collect()}
    assert repairs[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and repairs[1][6] == "KK"
    assert cr.repair(cr.prepared(rows.where("false"))).count() == 0


def test_query_damages_by_the_rule(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["Yes. No!", "so", None, "Why? "])) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 3, "user", "a."), (7, None, "user", "b."), (7, 2, "user", "twice."), (7, 2, "user", "twice.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        held = damaged.setdefault(conv, [])
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = {x[0]: tuple(x)[1:] for x in queries.op13_conversations(spark, str(tmp_path)).collect()}
    assert got == {c: brute(ordered(x))[0] for c, x in damaged.items()}
