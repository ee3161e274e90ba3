"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A suffix array sorted to depth ``WINDOW`` puts suffixes that share their first ``WINDOW`` bytes into
one bucket; strings in buckets of two or more are the repeated ones. The buckets are refined as in
bucket-pointer refinement, distributed:

1. Every position has a q-gram bucket. Its identifier is built by doubling: the bucket of 2n bytes at
   i from the buckets of n bytes at i and i + n, so each level reuses the last one's identifiers.
2. All windows of ``WINDOW`` bytes with the same least q-gram in them fall into the same coarse
   bucket, whatever document they are in. A run of neighbouring windows with one least q-gram is a
   *stretch*; coarse buckets with a single stretch hold no repeated string and are dropped. That is
   nearly all of them, and only 16 bytes for about 140 windows are shuffled to find them.
3. Stretches of the rest are refined by all bucket identifiers in them: equal stretches are repeated
   as a whole. A bucket of one kind of stretch is done.
4. Where stretches of a bucket differ, one of each kind is refined: steps 2 and 3 again with longer
   q-grams, which split it into shorter stretches, and at last window by window, on the identifiers
   of the buckets at the later offsets q, 2q, ... of the window: windows alike in all are equal.
   The last q-grams are nearly as long as a window, so that only the two or three windows next to a
   place where texts begin to differ become rows, however many documents share the text before it.

Coarse buckets are counted by a window over the one shuffle of their rows, so that texts are taken
apart once a round; the window is sorted and goes to disk where a bucket is large. All other groups
are counted with partial sums and joined back by key, never gathered. Texts travel compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partsight.llm.common import compressed, decompressed, lean, mix, stepped, stored

#: Bytes of a repeated string, and of the q-grams of each round of refinement.
WINDOW, GRAMS = 400, (128, 320, 376, 392, 398)
#: Bytes of text in one vector step, and of a block of a longer text.
BLOCK_BYTES = 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R = (np.uint64(0xA0761D6478BD642F | 1), np.uint64(0xE7037ED1A0B428DB | 1))
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * _A)


def gram_names(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit bucket identifiers of the ``gram``-byte strings at each position."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    if gram < 8:
        names, n = _BYTE_NAMES[data], 1
    else:  # eight bytes are their own name, well spread
        names, n = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)) ^ _R[0], 8
        names *= _A
        names ^= names >> np.uint64(32)
        names *= _B
    while n < gram:
        step = min(n, gram - n)  # the last step may overlap: bytes up to n, and the last n bytes
        left = names[:-step] * _A
        left += names[step:]
        left ^= left >> np.uint64(29)
        left *= _B
        names = left
        n += step
    return names


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values = of(values[:-n], values[n:])
        n *= 2
    return of(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def _powers(r: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Stretches:
    """Finds the stretches of blocks of text; holds the tables of powers."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def _tables(self, n: int):
        if not self.powers or len(self.powers[0][0]) < n:
            self.powers = []
            for r in _R:
                inverse = np.uint64(pow(int(r), -1, 1 << 64))
                self.powers.append((_powers(r, n), _powers(inverse, n)))
        return self.powers

    def __call__(self, data: np.ndarray, lengths: np.ndarray):
        """Of texts laid end to end: (text, start, windows, name, digest, digest, again) arrays.

        start: of the first window, from the text's start. again: the least q-gram may stand in the
        stretch twice, so its own windows may be equal.
        """
        span = self.window - self.gram + 1
        empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, bool))
        if len(data) < self.window:
            return empty
        ends = np.cumsum(lengths)
        starts = ends - lengths
        names = gram_names(data, self.gram)
        least = _sliding(names, span, np.minimum)
        # Windows that begin in a text and end in it.
        valid = np.zeros(len(least) + 1, np.int8)
        long = lengths >= self.window
        if not long.any():
            return empty
        np.add.at(valid, starts[long], 1)
        np.add.at(valid, ends[long] - self.window + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        new = np.empty(len(least), bool)
        new[0] = True
        new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        new[starts[long]] = True
        first = np.flatnonzero(new & valid)
        after = np.flatnonzero(np.concatenate((~valid | new, [True])))
        stop = after[np.searchsorted(after, first, side="right")]
        count = stop - first
        name = least[first]
        text = np.searchsorted(ends, first, side="right")
        last = first + count + span - 1  # behind the last q-gram of the stretch
        digests = []
        for powers, inverses in self._tables(len(names) + 1):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * powers[: len(names)])))
            digests.append(mix((total[last] - total[first]) * inverses[first] + count.astype(np.uint64)))
        # A q-gram is chosen where the largest least value of the windows that hold it is its own.
        padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
        chosen = np.flatnonzero(_sliding(padded, span, np.maximum) == names)
        twice = names[chosen[1:]] == names[chosen[:-1]] if len(chosen) else np.empty(0, bool)
        pairs = np.concatenate((np.zeros(1, np.int64), np.cumsum(twice)))
        lo = np.searchsorted(chosen, first)
        hi = np.searchsorted(chosen, last)
        again = pairs[np.maximum(hi - 1, lo)] > pairs[lo]
        return text, first - starts[text], count, name, digests[0], digests[1], again


def _blocks(texts: list[bytes], window: int, limit: int = BLOCK_BYTES):
    """(row, offset, bytes) lists of about ``limit`` bytes; a longer text in blocks that share window - 1 bytes."""
    held, size = [], 0
    for row, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - window + 1), limit) if len(raw) > limit else (0,):
            part = raw[at : at + limit + window - 1] if len(raw) > limit else raw
            if held and size + len(part) > limit:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def _keyed(docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry, k, l, raw: 128 bits that name the row's key and text, and the text's bytes (null: empty)."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    named = F.col(key).cast("string")
    return docs.select(
        key, *carry, F.xxhash64(named, raw).alias("k"), F.xxhash64(F.lit(1), raw, named).alias("l"), raw.alias("raw")
    )


_STRETCH = "k long, l long, base long, start long, windows long, done boolean, name long, d1 long, d2 long, again boolean"


def _stretches(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretches of ``texts``: k, l, base, done and raw, or packed, of a part of a text that begins at base."""
    column = "raw" if "raw" in texts.columns else "packed"

    def step(batches):
        find = Stretches(window, gram)
        for batch in stepped(batches, column, 1 << 20):
            k, l, base, done = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "l", "base", "done"))
            raws = batch.column("raw").to_pylist() if column == "raw" else decompressed(batch.column("packed"))
            for held in _blocks(raws, window):
                rows = np.array([h[0] for h in held])
                offsets = np.array([h[1] for h in held])
                data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
                text, start, count, name, d1, d2, again = find(data, np.array([len(h[2]) for h in held]))
                at = rows[text]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(k[at]),
                        pa.array(l[at]),
                        pa.array(base[at]),
                        pa.array(start + offsets[text] + base[at]),
                        pa.array(count),
                        pa.array(done[at].astype(bool)),
                        *(pa.array(x.view(np.int64)) for x in (name, d1, d2)),
                        pa.array(again),
                    ],
                    ["k", "l", "base", "start", "windows", "done", "name", "d1", "d2", "again"],
                )

    return texts.select("k", "l", "base", "done", column).mapInArrow(lean(step), _STRETCH)


def _cut(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The ``wanted`` stretches (k, l, base, start, windows, done) cut out of ``texts``, as texts."""
    # The stretches of a text: bounded by the text, which is one row too.
    per_text = wanted.groupBy("k", "l", "base").agg(F.collect_list(F.struct("start", "windows", "done")).alias("stretches"))

    def step(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in stepped(batches, "packed", 1 << 20):
            k, l, base = (batch.column(c).to_pylist() for c in ("k", "l", "base"))
            found = []
            for i, (raw, stretches) in enumerate(zip(decompressed(batch.column("packed")), batch.column("stretches").to_pylist())):
                for s in stretches:
                    at = s["start"] - base[i]
                    part = press.compress(raw[at : at + s["windows"] + window - 1])
                    found.append((k[i], l[i], s["start"], s["done"], part))
            columns = list(zip(*found)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["k", "l", "base", "done", "packed"]
            )

    joined = texts.join(per_text, ["k", "l", "base"]).select("k", "l", "base", "packed", "stretches")
    return joined.mapInArrow(lean(step), "k long, l long, base long, done boolean, packed binary")


def _windows(parts: DataFrame, window: int, gram: int) -> DataFrame:
    """Each window of the parts: k, l, start, done, and 128 bits from its buckets at later offsets."""
    offsets = [*range(0, window - gram, gram), window - gram]

    def step(batches):
        for batch in stepped(batches, "packed", 1 << 17):
            k, l, base, done = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "l", "base", "done"))
            raws = decompressed(batch.column("packed"))
            lengths = np.array([len(raw) for raw in raws])
            names = gram_names(np.frombuffer(b"".join(raws), np.uint8), gram)
            counts = lengths - window + 1
            first = np.cumsum(lengths) - lengths
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(first, counts) + within
            w1 = w2 = np.zeros(len(at), np.uint64)
            for number, offset in enumerate(offsets):
                part = names[at + offset]
                w1 = mix(w1 * _A + part)
                w2 = mix(w2 * _B + (part ^ np.uint64(number + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(k, counts)),
                    pa.array(np.repeat(l, counts)),
                    pa.array(np.repeat(base, counts) + within),
                    pa.array(np.repeat(done.astype(bool), counts)),
                    pa.array(w1.view(np.int64)),
                    pa.array(w2.view(np.int64)),
                ],
                ["k", "l", "start", "done", "w1", "w2"],
            )

    return parts.mapInArrow(lean(step), "k long, l long, start long, done boolean, w1 long, w2 long")


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, grams: tuple[int, ...] = GRAMS
) -> DataFrame:
    """k, l, spans: per row that holds repeated bytes, the [start, end) runs of windows that repeat.

    Spans of a row may overlap and are in no order. Rows equal in key and text share k and l.
    """
    texts = _keyed(docs, key, text).withColumns({"base": F.lit(0).cast("long"), "done": F.lit(False)})
    spans = []
    for gram in grams:
        found = _stretches(texts, window, gram)
        alike = F.count("*").over(Window.partitionBy("name"))
        kept = stored(found.withColumn("n", alike).where((F.col("n") > 1) | F.col("again")).drop("n"), "stretches")
        one = F.min(F.struct("k", "l", "base", "start", "windows")).alias("one")
        kinds = stored(
            kept.groupBy("name", "d1", "d2").agg(
                F.count("*").alias("n"), F.max("again").alias("again"), F.max("done").alias("done"), one
            ),
            "stretch-kinds",
        )
        equal = kinds.where("n > 1").select("name", "d1", "d2")
        spans.append(
            kept.where(~F.col("done")).join(equal, ["name", "d1", "d2"], "left_semi").select(
                "k", "l", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("end")
            )
        )
        buckets = kinds.groupBy("name").agg(F.count("*").alias("kinds"), F.max("again").alias("again"))
        mixed = buckets.where((F.col("kinds") > 1) | F.col("again")).select("name")
        wanted = kinds.join(mixed, "name", "left_semi").select(
            "one.*", (F.col("done") | (F.col("n") > 1)).alias("done")
        )
        if "raw" in texts.columns:
            texts = compressed(texts.select("k", "l", "base", "raw"), "raw", "packed")
        texts = stored(_cut(texts, wanted, window), "stretch-texts")
    windows = stored(_windows(texts, window, grams[0]), "windows")
    equal = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    spans.append(
        windows.where(~F.col("done")).join(equal, ["w1", "w2"], "left_semi").select(
            "k", "l", "start", (F.col("start") + window).alias("end")
        )
    )
    every = spans[0]
    for part in spans[1:]:
        every = every.unionByName(part)
    return every.groupBy("k", "l").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, in order; touching spans are one run."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    grams: tuple[int, ...] = GRAMS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, the columns in ``carry``, packed (the text's bytes as a zstandard frame), spans (start, end).

    The bytes in the spans repeat elsewhere: a string of ``window`` bytes that covers them starts
    anywhere else too, in this or another row; overlapping occurrences count, matches never cross rows.
    Spans overlap, ``merged`` makes runs of them. Null texts are empty, texts shorter than ``window``
    have no spans (null), repeated rows are each other's repeats. Every row of ``docs`` gives one row.
    """
    spans = repeated_spans(docs, key, text, window, grams)
    rows = compressed(_keyed(docs, key, text, carry), "raw", "packed").join(spans, ["k", "l"], "left")
    return rows.select(key, *carry, "packed", "spans")


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in runs:
        parts.append(raw[at:start])
        at = end
    return b"".join([*parts, raw[at:]])


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of ``remove_repeats``: key, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = T.StructType([found.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def step(batches):
        for batch in stepped(batches, "packed", 1 << 20):
            raws = decompressed(batch.column("packed"))
            runs = [merged(spans) for spans in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                    pa.array([len(r) for r in runs], pa.int64()),
                    pa.array([hashlib.sha256(kept_bytes(a, b)).hexdigest() for a, b in zip(raws, runs)], pa.string()),
                ],
                schema.names,
            )

    return found.mapInArrow(lean(step), schema)


def kept_texts(found: DataFrame, into: str = "text") -> DataFrame:
    """Of ``remove_repeats``: its key and carried columns, ``into`` (the text without its runs), n_removed.

    A run that begins or ends inside a character leaves that character, so the rest is valid text.
    """
    kept = [f for f in found.schema.fields if f.name not in ("packed", "spans")]
    schema = T.StructType([*kept, T.StructField(into, T.StringType()), T.StructField("n_removed", T.LongType())])

    def whole(raw: bytes, start: int, end: int) -> tuple[int, int]:
        while start < end and raw[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        return start, end

    def step(batches):
        for batch in stepped(batches, "packed", 1 << 20):
            texts, removed = [], []
            for raw, spans in zip(decompressed(batch.column("packed")), batch.column("spans").to_pylist()):
                rest = kept_bytes(raw, [whole(raw, *run) for run in merged(spans)])
                texts.append(rest.decode())
                removed.append(len(raw) - len(rest))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                schema.names,
            )

    return found.mapInArrow(lean(step), schema)
