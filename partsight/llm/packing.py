"""Best-fit packing of token pieces into sequences, with lower bounds as certificates.

Pieces are dealt into groups of bounded size and packed best-fit decreasing. A group whose number of
sequences equals a lower bound from dual feasible functions is proven optimal and done. The
sequences with room of all other groups are dealt anew, so that their documents meet those of other
groups, and each new group is packed again; the better of the old and the new packing stays. This
repeats until every group is certified, ``rounds`` are over, or a round gains nothing.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from partsight.llm.common import stepped, stored, whole_groups

CAPACITY = 2048
#: Pieces of a group: a task's memory is bounded by it, whatever the number of documents.
GROUP_PIECES = 20_000
ROUNDS = 3
#: Chunks between white space and words in them whose ids a Python worker remembers from task to task, and
#: the longest of them. At half as many, those not looked up since the last half are forgotten.
MEMORY_CHUNKS, MEMORY_CHARS = 1_500_000, 48

_PIECE = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
]


#: A word of Latin-1 letters and the ASCII punctuation behind it.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _split(text: str) -> list[str]:
    """What stands between white space. \\x1c to \\x1f are white space to Python but not to the tokenizer."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return text.split()


class _Seen(dict):
    """Ids of chunks; a chunk that is not there is made by ``make``, and kept if it is short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= MEMORY_CHARS:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """Ids of texts by the tokenizer, chunk between white space by chunk.

    Special tokens of the file that stand in a text are their own ids, as the library gives them; the
    rest of the text is encoded around them. The tokenizer must drop white space and never join what it separates, lower-case, part letters
    from punctuation, and give a word to its model in byte-level characters; then the ids of a text are
    those of its chunks in order, a chunk of a word and punctuation has the ids of the two, a word of
    Latin-1 letters has those of the model, and what was seen before needs no work.
    """

    def __init__(self, path: str, memory: int = MEMORY_CHUNKS):
        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().items()
        self.special = {token.content: np.array([code], "<u4").tobytes() for code, token in added}
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.seen: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Forgets what was not looked up since the last time."""
        self.older, self.seen = self.seen, _Seen(self._make)
        #: A chunk never holds a special token, so those can be looked up among the chunks.
        self.seen.update(self.special)

    def _chunks(self, text: str) -> list[str]:
        if self.parted and any(s in text for s in self.special):
            parts = self.parted.split(text)
            return [c for i, part in enumerate(parts) for c in ([part] if i % 2 else _split(part))]
        return _split(text)

    def _make(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is not None:
            return ids
        word, tail = chunk, ""
        if not (chunk.isascii() and chunk.isalpha()):
            if not (m := _WORD.fullmatch(chunk)):
                code = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0]
                return np.array(code.ids, "<u4").tobytes()
            word, tail = m.groups()
        low = word.lower()
        if tail:
            return self.seen[low] + self.seen[tail]
        if low != chunk:
            return self.seen[low]
        if not low.isascii():
            low = low.translate(self.level)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(low)])

    def __call__(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text, and ``end`` behind them."""
        if 2 * len(self.seen) > self.memory:
            self.forget()
        of = self.seen.__getitem__
        return [b"".join(map(of, self._chunks(t))) + end for t in texts]


@lru_cache(maxsize=1)
def encoder_of(tokenizer_file: str, memory: int) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_file, memory)


def pieces(
    docs: DataFrame,
    tokenizer_file: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    checksums: bool = False,
    memory: int = MEMORY_CHUNKS,
) -> DataFrame:
    """The token pieces of each document: ``key``, piece (from 0), start, length, ids or their CRC-32 as ids_crc32.

    A document is its ids and then ``end_id``; only longer ones than ``capacity`` are cut. ids are
    little-endian unsigned 32-bit values. Null and empty texts are one piece of ``end_id`` alone;
    repeated rows give repeated pieces; no other column is read.
    """
    what = T.StructField("ids_crc32", T.LongType()) if checksums else T.StructField("ids", T.BinaryType())
    schema = T.StructType([docs.schema[key], *_PIECE, what])

    def step(batches):
        encoder, end = encoder_of(tokenizer_file, memory), np.array([end_id], "<u4").tobytes()
        for batch in stepped(batches, text, 1 << 20):
            rows, numbers, starts, lengths, parts = [], [], [], [], []
            for i, ids in enumerate(encoder([t or "" for t in batch.column(text).to_pylist()], end)):
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    numbers.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    parts.append(zlib.crc32(part) if checksums else part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(parts, pa.int64() if checksums else pa.binary()),
                ],
                schema.names,
            )

    return docs.select(key, text).mapInArrow(step, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, packed best-fit decreasing; ties by position."""
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = count, capacity
            count += 1
        bins[i] = b
        room -= size
        if room:
            open_bins[room].append(b)
            rooms |= 1 << room
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound over three families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # u_k in units of 1 / (k * capacity): sizes that (k + 1) divides into whole bins keep their share.
        value = np.where(scaled % capacity == 0, k * sizes, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    below = np.concatenate(([0], np.cumsum(counts)))
    mass = np.concatenate(([0], np.cumsum(counts * sizes)))
    for e in range(capacity // 2 + 1):
        # Pieces over capacity - e fill a bin, those under e count nothing, the others their size.
        full = int(below[capacity + 1] - below[capacity - e + 1])
        best = max(best, full + -(-int(mass[capacity - e + 1] - mass[e]) // capacity))
    half = capacity // 2
    large = int(below[capacity + 1] - below[half + 1])
    return max(best, large)


_PLAN = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("open", T.BooleanType()),
    ]
)


def _offsets(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
    base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
    offsets = np.empty(len(bins), np.int64)
    offsets[order] = ends - lengths[order] - base
    return offsets


def _repack(items: DataFrame, capacity: int, numbered: int) -> DataFrame:
    """Packs each group of ``items`` (group, uid, length, sequence_id or null) anew.

    ``open``: the group is not certified and the sequence has room.
    """

    def step(batches):
        for rows, starts in whole_groups(batches, "group"):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                part = rows.slice(a, b - a)
                group = part.column("group")[0].as_py()
                lengths = part.column("length").to_numpy()
                bins = best_fit(lengths, capacity)
                base = (numbered << 58) + (group << 26)
                if part.column("sequence_id").null_count == 0:
                    old, old_bins = np.unique(part.column("sequence_id").to_numpy(), return_inverse=True)
                    if len(old) <= bins.max() + 1:
                        bins = old_bins
                used = int(bins.max()) + 1
                gap = used > lower_bound(lengths, capacity)
                room = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uid").combine_chunks(),
                        pa.array(lengths),
                        pa.array(base + bins),
                        pa.array(_offsets(bins, lengths)),
                        pa.array((room[bins] > 0) & gap),
                    ],
                    _PLAN.names,
                )

    return items.repartition("group").sortWithinPartitions("group", F.desc("length"), "uid").mapInArrow(step, _PLAN)


def pack(items: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Sequences for ``items`` (uid long, unique; length long, 1 to capacity).

    Returns uid, length, sequence_id, offset: no sequence is longer than ``capacity``, and its pieces
    lie gapless from 0. Pieces of ``capacity`` are sequences of their own. No rows give no rows.
    """
    full = items.where(F.col("length") >= capacity).select(
        "uid", "length", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = items.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.select(
        F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("group"),
        "uid",
        "length",
        F.lit(None).cast("long").alias("sequence_id"),
    )
    plan = stored(_repack(dealt, capacity, 0), "packing")
    done = [full]
    for n in range(1, rounds):
        bins = plan.groupBy("open").agg(F.count("*").alias("pieces"), F.countDistinct("sequence_id").alias("bins"))
        found = {r["open"]: r for r in bins.collect()}
        if True not in found or n > 1 and found[True]["bins"] >= previous:
            break
        previous = found[True]["bins"]
        done.append(plan.where(~F.col("open")).drop("open"))
        groups = max(1, -(-found[True]["pieces"] // group_pieces))
        again = plan.where("open").select(
            F.pmod(F.xxhash64(F.lit(n), "sequence_id"), F.lit(groups)).alias("group"), "uid", "length", "sequence_id"
        )
        plan = stored(_repack(again, capacity, n), "packing")
    out = plan.drop("open")
    for part in done:
        out = out.unionByName(part)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_file: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, memory: int = MEMORY_CHUNKS
) -> DataFrame:
    """The pieces of ``docs`` with ids_crc32, sequence_id and offset.

    The pieces are tokenised once and their keys and checksums written to the shared folder; packing
    moves numbers only.
    """
    cut = pieces(docs, tokenizer_file, key, text, capacity, checksums=True, memory=memory)
    cut = stored(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    plan = pack(cut.select("uid", "length"), capacity)
    return cut.join(plan.drop("length"), "uid").select(
        key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
