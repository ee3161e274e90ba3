"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from ordinary text needs few tokens for words and many for random characters.
Runs of key characters are cut at separators into parts. A join of neighbouring parts (or one part)
whose characters-per-token ratio stays below ``MAX_RATIO`` is reported as ``random``, so words in
front of or behind random characters do not hide them. Base spans, UUIDs and digests (hex of a digest's
length) are cut out first; numbers and joins of nothing but wordlike parts are left alone.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from partsight.llm.byte_bpe import encode_text, encoding
from partsight.llm.common import lean, stepped

#: The base patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST = 6
#: The runs of 20 and 24 characters at least; a shorter run holds no match, a longer one is one match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

MIN_RUN, MAX_RATIO = 16, 1.9
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
#: Parts and the separators between them.
_ITEM = re.compile(r"[A-Za-z0-9]+|[+/_=.-]+")
#: Parts of short numbers and versions, and of letters as words have them (those need a word's ratio too).
_SHORT_NUMBER = re.compile("v?[0-9]{1,8}")
_WORD = re.compile("[A-Za-z]+")
#: A part of so few letters says nothing by its ratio.
_SHORT_WORD = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start and kind; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of ``start`` to ``end`` no span covers; the spans are sorted."""
    free = []
    for a, b in spans:
        if a > start:
            free.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            return free
    return [*free, (start, end)]


def _maximal(weights: list[int]) -> list[tuple[int, int]]:
    """The maximal-scoring stretches (first, last) by Ruzzo and Tompa's method, in linear time."""
    found: list[tuple[int, int, int, int, int]] = []  # first, last, sum before, sum after, next to the left that is lower
    total = 0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        first, last, after = i, i, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, last, before, after, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(x[0], x[1]) for x in found]


def _is_separator(item: str) -> bool:
    return item[0] in "+/_=.-"


def _wordlike(item: str, tokens: int, max_ratio: float) -> bool:
    if _WORD.fullmatch(item):
        return len(item) <= _SHORT_WORD or len(item) >= max_ratio * tokens
    return _is_separator(item) or _SHORT_NUMBER.fullmatch(item) is not None


def _random_joins(piece: str, enc, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the joins of parts of ``piece`` with low token efficiency.

    A join's weight is what its characters fall short of ``max_ratio`` a token. The stretches that
    stand out most come first; among what they leave, any other join of positive weight that is long
    enough. A join begins and ends with a part.
    """
    items = [(m.start(), m.end(), m[0]) for m in _ITEM.finditer(piece)]
    counts = {item: len(encode_text(enc, item)) for _, _, item in items}
    unit, per_token = 1_000_000, round(1_000_000 * max_ratio)  # whole numbers, so that sums are exact
    sums, odd_at = [0], []  # odd_at: up to each item, the last start of a join that is more than words or a number
    odd = number = letters = -1
    for i, (start, end, item) in enumerate(items):
        sums.append(sums[-1] + per_token * counts[item] - unit * (end - start))
        if not item.isdigit() and not _is_separator(item):
            letters = i
        if not _wordlike(item, counts[item], max_ratio):
            number, odd = (i, odd) if item.isdigit() else (number, i)
        odd_at.append(max(odd, min(number, letters)))

    def join(first: int, last: int) -> tuple[int, int] | None:
        first += first < last and _is_separator(items[first][2])
        last -= first < last and _is_separator(items[last][2])
        start, end = items[first][0], items[last][1]
        if end - start < MIN_RUN or odd_at[last] < first or sums[last + 1] <= sums[first]:
            return None
        return start, end

    found, gaps, at = [], [], 0
    for first, last in _maximal([y - x for x, y in zip(sums, sums[1:])]):
        if span := join(first, last):
            found.append(span)
            gaps.append((at, first))
            at = last + 1
    for first, behind in [*gaps, (at, len(items))]:
        low, at, last = -1, first, first  # low: the least sum among the starts far enough back
        while last < behind:
            while at <= min(last, odd_at[last]) and items[last][1] - items[at][0] >= MIN_RUN:
                if not _is_separator(items[at][2]) and (low < 0 or sums[at] < sums[low]):
                    low = at
                at += 1
            if low >= 0 and sums[last + 1] > sums[low] and not _is_separator(items[last][2]):
                while last + 2 < behind and sums[last + 3] > sums[last + 1]:
                    last += 2
                found.append((items[low][0], items[last][1]))
                low, at = -1, last + 1
            last += 1
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], enc, max_ratio: float) -> list[tuple[int, int, int]]:
    """Joins of parts of low token efficiency outside the spans in ``taken`` (sorted by start)."""
    found = []
    at, reach = 0, []  # of the taken spans: the first that starts behind the run, those that can reach into it
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach.append((taken[at][0], taken[at][2]))
            at += 1
        reach = [x for x in reach if x[1] > start]
        cut = reach + [u.span() for u in _UUID.finditer(text, start, end)]
        for item in _ITEM.finditer(text, start, end):
            if len(item[0]) in _DIGEST_LENGTHS and _HEX_ONLY.fullmatch(item[0]):
                cut.append(item.span())
        for a, b in _outside(start, end, sorted(cut)):
            if b - a >= MIN_RUN:
                found += [(a + x, 3, a + y) for x, y in _random_joins(text[a:b], enc, max_ratio)]
    return found


_SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def scan(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    text: str = "text",
    into: str = "secrets",
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """Adds ``into``: array of (kind, start, end) of the whole text, by start, then kind.

    Null and empty texts give an empty array; an input column called ``into`` is replaced. Rows are
    independent: no shuffle, and a long text costs time in proportion to its length.
    """
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(_SPAN))])
    names = [*(f.name for f in kept), into]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(batches):
        enc = encoding(rank_file, pattern)
        for batch in stepped(batches, text):
            rows = []
            for s in batch.column(text).to_pylist():
                base = base_spans(s or "")
                spans = sorted(base + random_spans(s or "", base, enc, max_ratio))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(rows, kind)], names)

    return docs.mapInArrow(lean(step), schema)


def redact(docs: DataFrame, secrets: str = "secrets", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The texts with each run of overlapping secret spans replaced by ``mark``; other texts unchanged."""

    def step(batches):
        for batch in stepped(batches, text):
            out = []
            for s, spans in zip(batch.column(text).to_pylist(), batch.column(secrets).to_pylist()):
                if s and spans:
                    parts, at, end = [], 0, -1
                    for span in spans:
                        if span["start"] >= end:
                            parts += [s[at : span["start"]], mark]
                        end = at = max(end, span["end"])
                    s = "".join([*parts, s[at:]])
                out.append(s)
            where = batch.schema.get_field_index(text)
            yield batch.set_column(where, text, pa.array(out, pa.string()))

    return docs.mapInArrow(lean(step), docs.schema)
