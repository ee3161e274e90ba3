"""Cheapest repair of damaged conversations, as a secondary-sorted stream.

A conversation should read: a system turn or none, then user and assistant in turn, ending with an
assistant. Edits mend it: Keep a turn (0), Rerole it to user or assistant (3), Delete it (4), Insert
an empty user or assistant turn (3). Blank and repeated turns must be deleted; a turn that is kept
although it breaks off costs 3 more. Among the cheapest edit strings the least one in ASCII order wins.

Rows are dealt by conversation and sorted by turn; one pass carries the state of the search across
batches: for each of the four states of the pattern the cost of the best edits that reach it, the
order of their edit strings, and the running digest of the turns they leave. Two edit strings for the
same rows never are each other's beginning, as each ends with the edit of the last row, so the order
of the strings so far decides every later tie. Costs apart from the least and the order take few
values, so a step of the search is looked up, not computed.

What is kept of a row are four bytes, where each state's best edits came from. Past ``SPILL_ROWS``
rows of a conversation they leave the task as rows of their own, compressed, into the shared folder;
a second stream goes back over them from the last block to the first and writes the edits.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPILL_ROWS = 1 << 20
#: Rows of results that leave a task together.
_OUT_ROWS = 4096

#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: What may be done up to and with a row: so many inserts, then its edit.
_EDITS = tuple((inserts, edit) for inserts in range(3) for edit in "DKR")
#: Turns to insert at the end to reach an end of the pattern.
_TO_END = (0, 2, 1, 0)
_NO_PATH = 255
_WORD, _END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_LEGAL = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[state]
    return state


class Search:
    """Steps from the costs and order of the four states to those after one more row."""

    def __init__(self):
        self.steps: dict = {}

    def step(self, states: tuple, initial: str, fault: str) -> tuple[tuple, int, bytes]:
        """(states, cost, back): ``states`` has (cost above the least, place in order) or None of each state.

        back: for each state, where its best edits came from: state + 4 * number of the edits.
        """
        kind = (states, initial if initial in ("s", "u", "a") else "", fault)
        found = self.steps.get(kind)
        if found is None:
            found = self.steps[kind] = self._step(*kind)
        return found

    def _step(self, states: tuple, initial: str, fault: str) -> tuple[tuple, int, bytes]:
        best: list = [None] * 4
        for state, reached in enumerate(states):
            if reached is None:
                continue
            cost, place = reached
            for number, (inserts, edit) in enumerate(_EDITS):
                here, total = _inserted(state, inserts), cost + INSERT * inserts
                if edit == "D":
                    after, total = here, total + DELETE
                elif fault in ("blank", "duplicate"):
                    continue
                else:
                    total += TRUNCATED if fault == "truncated" else 0
                    if edit == "K":
                        legal = {"s": here == _START, "u": here != _USER, "a": here == _USER}
                        if not legal.get(initial, False):
                            continue
                        after, total = (_SYSTEM if initial == "s" else _NEXT[here]), total + KEEP
                    else:
                        after, total = _NEXT[here], total + REROLE
                rank = (total, place, "I" * inserts + edit, state + 4 * number)
                if best[after] is None or rank < best[after]:
                    best[after] = rank
        least = min(b[0] for b in best if b)
        # A state is out if another one stands for it at less: inserts lead from one to the next, and what
        # can follow no turn can follow an assistant's, but for one system turn (deleted at 4).
        bounds = ((_START, _ASSISTANT, DELETE), (_SYSTEM, _ASSISTANT, 0), (_USER, _ASSISTANT, INSERT), (_USER, _START, INSERT))
        bounds += ((_USER, _SYSTEM, INSERT), (_ASSISTANT, _USER, INSERT), (_ASSISTANT, _START, 2 * INSERT))
        bounds += ((_START, _USER, INSERT + DELETE), (_SYSTEM, _USER, INSERT))
        given = list(best)
        for state, other, most in bounds:
            if given[state] and given[other] and given[state][0] > given[other][0] + most:
                best[state] = None
        order = sorted((b[1], b[2], s) for s, b in enumerate(best) if b)
        places = {s: i for i, (_, _, s) in enumerate(order)}
        after = tuple((b[0] - least, places[s]) if b else None for s, b in enumerate(best))
        return after, least, bytes(b[3] if b else _NO_PATH for b in best)


def _trace(back: bytes, state: int) -> tuple[str, int]:
    """The edits of a block of rows that ends in ``state``, and the state before it."""
    edits = []
    for at in range(len(back) - 4, -1, -4):
        code = back[at + state]
        inserts, edit = _EDITS[code >> 2]
        edits.append("I" * inserts + edit)
        state = code & 3
    return "".join(reversed(edits)), state


class _Conversation:
    """The search over one conversation."""

    def __init__(self, search: Search, key):
        self.search, self.key = search, key
        self.states: tuple = ((0, 0), None, None, None)
        self.digests: list = [hashlib.sha256(), None, None, None]
        self.cost = self.rows = self.blocks = 0
        self.back = bytearray()
        self.counts = dict.fromkeys(FAULTS[1:], 0)
        self.illegal, self.initial = 0, None
        self.turns, self.least_turn, self.last_turn = 0, None, None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
        if not _WORD.search(text):
            fault = "blank"
        elif again:
            fault = "duplicate"
        else:
            fault = "" if _END.search(text) else "truncated"
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.rows and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial, self.rows = initial, self.rows + 1
        self.states, cost, back = self.search.step(self.states, initial, fault)
        self.cost += cost
        self.back += back
        digests: list = [None] * 4
        for state in range(4):
            if back[state] != _NO_PATH:
                digests[state] = self._extended(back[state], role, text)
        self.digests = digests

    def _extended(self, code: int, role: str, text: str):
        state, (inserts, edit) = code & 3, _EDITS[code >> 2]
        digest = self.digests[state].copy()
        for _ in range(inserts):
            digest.update((b"\n" if state != _START else b"") + _ROLE[_NEXT[state]].encode() + b":")
            state = _NEXT[state]
        if edit != "D":
            role = role if edit == "K" else _ROLE[_NEXT[state]]
            digest.update((b"\n" if state != _START else b"") + f"{role}:{text}".encode())
        return digest

    def block(self, state: int | None = None) -> tuple:
        """A row for the edits' way back so far; the last one knows the ``state`` it ends in."""
        row = (self.key, self.blocks, zlib.compress(bytes(self.back), 1), state, None, *[None] * 8)
        self.back, self.blocks = bytearray(), self.blocks + 1
        return row

    def ended(self) -> list[tuple]:
        """The rows of the result: one of the conversation, behind its last block if it has any."""
        ways = [(c[0] + INSERT * _TO_END[s], c[1], s) for s, c in enumerate(self.states) if c]
        extra, _, state = min(ways)
        digest, at = self.digests[state].copy(), state
        for _ in range(_TO_END[state]):
            digest.update((b"\n" if at != _START else b"") + _ROLE[_NEXT[at]].encode() + b":")
            at = _NEXT[at]
        rows, edits = [], ""
        if self.blocks:
            rows.append(self.block(state))
        else:
            edits, _ = _trace(bytes(self.back), state)
        gaps = self.last_turn - self.least_turn + 1 - self.turns if self.turns else 0
        edits += "I" * _TO_END[state]
        return [
            *rows,
            (self.key, None, None, None, self.blocks > 0, gaps, *self.counts.values(), self.illegal, self.cost + extra, edits, digest.hexdigest()),
        ]


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_STREAM = f"conv string, block long, back binary, state int, spilled boolean, {_SUMMARY}"
_STREAM_COLUMNS = [c.split()[0] for c in _STREAM.split(", ")]
_RESULT = [c.split()[0] for c in _SUMMARY.split(", ")]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


def _search_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    search, now, out = Search(), None, []
    for frame in frames:
        for conv, present, has_turn, turn, role, text, again in zip(
            *(frame[c].tolist() for c in ("conv", "present", "has_turn", "turn", "role", "text", "again"))
        ):
            if now is None or conv != now.key:
                if now is not None:
                    out += now.ended()
                now = _Conversation(search, conv)
            if present:
                now.add(turn if has_turn else None, role, text, again)
                if len(now.back) >= 4 * SPILL_ROWS:
                    out.append(now.block())
            if len(out) >= _OUT_ROWS:
                yield _frame(out, _STREAM_COLUMNS)
                out = []
    if now is not None:
        out += now.ended()
    if out:
        yield _frame(out, _STREAM_COLUMNS)


def _trace_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state, first = None, None, True
    for frame in frames:
        out = []
        for key, block, back, ends_in in zip(*(frame[c].tolist() for c in ("conv", "block", "back", "state"))):
            if first or key != conv:
                conv, state, first = key, int(ends_in), False
            edits, state = _trace(zlib.decompress(back), state)
            out.append((key, block, edits))
        yield _frame(out, ["conv", "block", "edits"])


def prepared(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """The rows of ``turns`` as the stream reads them: dealt by conversation, sorted by turn, then role and text.

    Null turns come first; a null role or text is one space; a null ``conv`` is a conversation as any
    other. again: a row before it in its conversation has its role and text. ``present``: rows where
    it is false only name their conversation. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv).cast("string").alias("conv"),
        F.coalesce(F.lit(True) if present is None else present, F.lit(False)).alias("present"),
        F.col(turn).isNotNull().alias("has_turn"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    equal = Window.partitionBy("conv", "present", "role", "text").orderBy("has_turn", "turn")
    # The window's keys hold the key that the rows are dealt by already: it only sorts.
    return (
        rows.repartition("conv")
        .withColumn("again", F.row_number().over(equal) > 1)
        .sortWithinPartitions("conv", "has_turn", "turn", "role", "text", "again")
    )


def repair(rows: DataFrame, conv_type: str = "long") -> DataFrame:
    """Of each conversation of ``prepared`` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers missing between the least and the largest. blank, duplicate, truncated: rows by
    their first fault. illegal: neighbours whose roles' initials are not su, ua or au (a role without
    letters has no initial). audit: the initials of the edits. The digest is that of the repaired
    ``role:text`` lines. A conversation without present rows has zeros, no edits and the digest of
    nothing; an empty table gives no rows.
    """
    found = stored(rows.mapInPandas(_search_stream, _STREAM), "conversation-search")
    whole = found.where(F.col("block").isNull())
    blocks = found.where(F.col("block").isNotNull()).select("conv", "block", "back", "state")
    dealt = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    edits = dealt.mapInPandas(_trace_stream, "conv string, block long, edits string")
    # The edits of a conversation are one value of the result; nothing else is gathered.
    edits = edits.groupBy(F.col("conv").alias("of")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda b: b["edits"]), "").alias("before")
    )
    short = whole.where(~F.col("spilled")).withColumn("before", F.lit(""))
    long = whole.where("spilled").join(edits, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return short.unionByName(long).select(
        F.col("conv").cast(conv_type).alias("conv_id"),
        *(F.concat("before", "audit").alias("audit") if c == "audit" else c for c in _RESULT),
    )


def _apply_stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ("conv", "edits", "role", "text")
    audit, at, place, state, out = "", 0, 0, _START, []

    def insert(conv) -> None:
        nonlocal at, place, state
        while audit[at : at + 1] == "I":
            state = _NEXT[state]
            out.append((conv, place, "I", _ROLE[state], ""))
            at, place = at + 1, place + 1

    for frame in frames:
        for conv, edits, role, text in zip(*(frame[c].tolist() for c in columns)):
            if edits is not None:
                audit, at, place, state = edits, 0, 0, _START
                insert(conv)
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                if edit == "K" and role[:1] == "s":
                    state = _SYSTEM
                else:
                    state = _NEXT[state]
                out.append((conv, place, edit, role if edit == "K" else _ROLE[state], text))
                place += 1
            insert(conv)
        if out:
            yield _frame(out, ["conv", "place", "edit", "role", "text"])
            out = []


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The turns that the ``repairs`` leave of ``prepared`` rows: conv_id, place (from 0), edit, role, text."""
    kind = repairs.schema["conv_id"].dataType
    given = rows.where("present").withColumn("edits", F.lit(None).cast("string"))
    heads = repairs.select(F.col("conv_id").cast("string").alias("conv"), F.col("audit").alias("edits"))
    order = ("conv", "edits", "has_turn", "turn", "role", "text", "again")
    every = heads.unionByName(given.select(*order), allowMissingColumns=True).repartition("conv")
    dealt = every.sortWithinPartitions("conv", F.col("edits").asc_nulls_last(), *order[2:])
    return dealt.mapInPandas(_apply_stream, "conv string, place long, edit string, role string, text string").select(
        F.col("conv").cast(kind).alias("conv_id"), "place", "edit", "role", "text"
    )
