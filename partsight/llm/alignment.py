"""Alignment of two tokenizers over a corpus, scored through inverted pair bitmaps.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B). Where tokens of both end, the text
is cut into groups; two tokens are *linked* where their byte ranges overlap. How good a link is
depends on the whole corpus: on how many links hold its pair of ids.

1. *Index.* Documents are taken in blocks and numbered within them. For each pair of ids a block keeps
   compressed bitmaps of its documents: plane k has the documents whose number of links of the pair
   has bit k set. The OR of the planes are the documents that hold the pair.
2. *Counts.* Popcounts of the OR give a pair's documents, popcounts of plane k times 2**k its links;
   both are summed over blocks with partial sums. Blocks share no document, so merging the bitmaps of
   a pair is putting its blocks side by side, and nothing larger than one block is ever in a task.
3. *Scores.* The counts go back along the same postings: joined by pair, dealt by block, and each
   plane adds 2**k times the pair's count to its documents.

Both tokenizers end a token in front of a blank that follows another character than white space, so
a text is encoded chunk by chunk between such blanks, and what a task has seen needs no work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from partsight.llm.common import give_back, lean, small_batches, stepped, stored, whole_groups

#: A block of documents: bytes of text (a longer text is a block of its own) and documents.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 1 << 14
#: Bytes of text that are encoded at a time.
PART_BYTES = 1 << 20
#: Chunks that a task remembers between blocks, and their characters.
MEMORY_CHUNKS, MEMORY_CHARS = 200_000, 4_000_000
#: Chunks that go to A as one text.
_LOT = 256
#: Where a chunk begins, and what a text has where its chunks are not what stands between blanks.
_CUT, _LOOSE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level BPE: printable ones are themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers chunks as they are first seen; ``new`` are those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class Aligner:
    """Numbers chunks (without the blank that each begins with); tables of their ids, groups and links."""

    def __init__(self, a_file: str, b_file: str):
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters, vocabulary = _byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        #: Whether B never joins a blank to what stands in front of it.
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.ids = max(len(self.a_bytes), len(pieces))
        self.names = [f"{i}{end}".encode() for end in ",|;" for i in range(self.ids)]
        self.name_sizes = np.array([len(n) for n in self.names], np.int64)
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.groups: list[bytes] = []
        self.chars = 0
        self._sums = [np.zeros((0, 4), np.int64)]
        self._bad = [np.zeros(0, bool)]
        self._links = [np.zeros(0, np.int64)]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk: (n_a, n_b, n_groups, n_links), whether its bytes differ; of all links the pairs."""
        for held in (self._sums, self._bad, self._links):
            if len(held) > 1:
                held[:] = [np.concatenate(held)]
        return self._sums[0], self._bad[0], self._links[0]

    @staticmethod
    def _split(text: str) -> list[str]:
        """The chunks of a blank and ``text``."""
        if text[:1] != " " and _LOOSE.search(text) is None:
            return text.split(" ")
        return [c[1:] for c in _CUT.split(" " + text)]

    def chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a blank and ``text``, in lists of about ``PART_BYTES`` characters."""
        if not self.parts:
            yield [text]
            return
        start = 0
        while len(text) - start > PART_BYTES:
            cut = _CUT.search(text, start + PART_BYTES)
            if cut is None:
                break
            yield self._split(text[start : cut.start()])
            start = cut.start() + 1
        yield self._split(text[start:])

    def _encode_a(self, new: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all chunks in order, and how many each has.

        Many chunks are encoded as one text; one that ends in white space is the last of its text.
        """
        lots, lot = [], []
        for chunk in new:
            lot.append(chunk)
            if len(lot) == _LOT or not chunk or chunk[-1].isspace():
                lots.append(" " + " ".join(lot))
                lot = []
        if lot:
            lots.append(" " + " ".join(lot))
        codes = self.a.encode_batch_fast(lots, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(c.ids for c in codes), np.int64)
        ends = np.cumsum(self.a_sizes[ids])
        return ids, np.bincount(np.searchsorted(np.cumsum(sizes), ends), minlength=len(new))

    def learn(self) -> None:
        """Encodes and aligns the chunks first seen since the last time."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        raws = [b" " + c.encode() for c in new]
        sizes = np.array([len(raw) for raw in raws], np.int64)
        a_ids, n_a = self._encode_a(new, sizes)
        b_lists = [ids or [self.blank] for ids in self.b.encode(new, num_threads=1)]
        n_b = np.array([len(ids) for ids in b_lists], np.int64)
        b_ids = np.fromiter(chain.from_iterable(b_lists), np.int64)
        a_of, b_of = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        bad = np.zeros(len(new), bool)
        for ids, n, words in ((a_ids, n_a, self.a_bytes), (b_ids, n_b, self.b_bytes)):
            cut = np.concatenate(([0], np.cumsum(n))).tolist()
            tokens = list(map(words.__getitem__, ids.tolist()))
            for i, raw in enumerate(raws):
                if b"".join(tokens[cut[i] : cut[i + 1]]) != raw:
                    bad[i] = True
        if bad.any():
            a_ids, b_ids = a_ids[~bad[a_of]], b_ids[~bad[b_of]]
            n_a, n_b, sizes = (np.where(bad, 0, x) for x in (n_a, n_b, sizes))
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        # Between neighbouring ends of either side lies the overlap of one token of A and one of B.
        cuts = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        again = np.concatenate((cuts[1:] == cuts[:-1], [False])) if len(cuts) else np.zeros(0, bool)
        common, cuts = cuts[again], cuts[~again]
        a_of_cut, b_of_cut = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
        self._links.append((a_ids[a_of_cut] << 32) | b_ids[b_of_cut])
        ends = np.cumsum(sizes)
        n_links, n_groups = (np.bincount(np.searchsorted(ends, x), minlength=len(new)) for x in (cuts, common))
        self._sums.append(np.stack((n_a, n_b, n_groups, n_links), axis=1))
        self._bad.append(bad)
        # The groups as text: A's tokens of a group, then B's.
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_at = np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)
        b_at = np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")
        ids, kind = np.empty((2, len(a_ids) + len(b_ids)), np.int64)
        ids[a_at], ids[b_at] = a_ids, b_ids
        kind[a_at], kind[b_at] = 2 * a_group, 2 * b_group + 1
        step = np.diff(kind, append=2 * len(common))
        named = np.where(step == 0, 0, np.where((step == 1) & (kind % 2 == 0), 1, 2)) * self.ids + ids
        text = b"".join(map(self.names.__getitem__, named.tolist()))
        at = np.concatenate(([0], np.cumsum(self.name_sizes[named])))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        self.groups += [text[i:j] for i, j in zip(at, at[1:])]
        self.chars += int(sizes.sum())


class _Block:
    """The documents of a block, as chunk numbers; ``rows`` gives their index rows."""

    def __init__(self):
        self.size = self.docs = 0
        self.bad: list[bool] = []
        self.numbers: list[np.ndarray] = []
        self.of: list[int] = []
        self.keys: list[pa.Array] = []
        self.sums: list[np.ndarray] = []
        self.digests: list = []

    def planes(self, aligner: Aligner):
        """Per pair of ids: pair, n_docs, n_links, planes."""
        sums, _, links = aligner.tables()
        held = [(d, x) for d, x in zip(self.of, self.numbers) if not self.bad[d]]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        docs = np.repeat([d for d, _ in held], [len(x) for _, x in held])
        chunks = np.concatenate([x for _, x in held])
        key, times = np.unique(docs * len(sums) + chunks, return_counts=True)
        docs, chunks = np.divmod(key, len(sums))
        del key, held
        counts = sums[chunks, 3]
        starts = (np.cumsum(sums[:, 3]) - sums[:, 3])[chunks]
        at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pairs, code = np.unique(links, return_inverse=True)
        key = code[at] * self.docs + np.repeat(docs, counts)
        del at, docs, chunks, starts
        order = np.argsort(key)
        key, times = key[order], np.repeat(times, counts)[order]
        del order
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.add.reduceat(times, first)
        code, docs = np.divmod(key[first], self.docs)
        # Pairs of chunks that no document of this block holds have no postings.
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n_docs = np.diff(first, append=len(code))
        n_links = np.add.reduceat(times, first)
        bits = np.floor(np.log2(np.maximum.reduceat(times, first))).astype(np.int64) + 1
        base = np.cumsum(bits) - bits
        pair = np.repeat(np.arange(len(first)), n_docs)
        slots, members = [], []
        for k in range(int(bits.max())):
            chosen = (times >> k) & 1 == 1
            slots.append(base[pair[chosen]] + k)
            members.append(docs[chosen])
        slots, members = np.concatenate(slots), np.concatenate(members)
        members = members[np.argsort(slots, kind="stable")]
        ends = np.cumsum(np.bincount(slots, minlength=int(bits.sum())))
        maps = packed_planes(members, ends, self.docs)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate((base, [len(maps)])), pa.int32()), pa.array(maps, pa.binary())
        )
        return pairs[code[first]], n_docs, n_links, lists


def packed_planes(members: np.ndarray, ends: np.ndarray, docs: int) -> list[bytes]:
    """The bitmaps of sets of document numbers laid end to end: a list of 16-bit numbers, or bits where those are shorter."""
    raw, out, start = members.astype("<u2").tobytes(), [], 0
    for end in ends.tolist():
        if 16 * (end - start) <= docs:
            out.append(b"\0" + raw[2 * start : 2 * end])
        else:
            bits = np.zeros(docs, np.uint8)
            bits[members[start:end]] = 1
            out.append(b"\1" + np.packbits(bits, bitorder="little").tobytes())
        start = end
    return out


def plane_members(plane: bytes) -> np.ndarray:
    if plane[0] == 0:
        return np.frombuffer(plane, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8, offset=1), bitorder="little"))


def _index_schema(key: T.StructField) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in _DOC]
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("key", key.dataType),
            *longs,
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("pair", T.LongType()),
            T.StructField("pair_docs", T.LongType()),
            T.StructField("pair_links", T.LongType()),
            T.StructField("planes", T.ArrayType(T.BinaryType())),
        ]
    )


def index(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of ``docs``, written to the shared folder.

    Rows with ``place``: a document (key, n_a, n_b, n_groups, n_links, groups_sha256) and its number in
    its ``block``. Rows with ``pair``: A id times 2**32 plus B id, the pair's documents and links in the
    block, and its planes. Every row of ``docs`` is a document, repeated ones too; null and empty texts,
    and texts whose token bytes differ from blank and text, have no tokens. No other column is read.
    """
    schema = _index_schema(docs.schema[key])
    small_batches(docs.sparkSession)

    def step(batches):
        aligner = Aligner(a_file, b_file)
        block_id = TaskContext.get().partitionId() << 31
        block = _Block()

        def add(keys: pa.Array, texts: list[str | None]) -> None:
            first = block.docs
            sums = np.zeros((len(texts), 4), np.int64)
            hashes: list = [None] * len(texts)
            block.bad += [False] * len(texts)
            held, size = [], 0

            def encode() -> None:
                numbered = [np.fromiter(map(aligner.number.__getitem__, c), np.int64, len(c)) for _, c in held]
                aligner.learn()
                table, bad, _ = aligner.tables()
                for (i, _), numbers in zip(held, numbered):
                    sums[i] += table[numbers].sum(axis=0)
                    block.bad[first + i] |= bool(bad[numbers].any())
                    hashes[i] = hashes[i] or hashlib.sha256()
                    block.of.append(first + i)
                    block.numbers.append(numbers.astype(np.int32))
                    groups = b"".join(map(aligner.groups.__getitem__, numbers.tolist()))
                    # A text's last separator is not part of its groups: it is held back until more follows.
                    hashes[i].update(groups[:-1] if i not in open_rows else b";" + groups[:-1])
                    open_rows.add(i)
                held.clear()

            open_rows: set[int] = set()
            for i, t in enumerate(texts):
                for chunks in aligner.chunks(t) if t else ():
                    held.append((i, chunks))
                    size += min(len(t), PART_BYTES)
                    if size >= PART_BYTES:
                        encode()
                        size = 0
            if held:
                encode()
            wrong = np.array(block.bad[first:], bool)
            sums[wrong] = 0
            block.digests += [h.hexdigest() if h and not w else "" for h, w in zip(hashes, wrong)]
            block.sums.append(sums)
            block.keys.append(keys)
            block.docs += len(texts)
            block.size += sum(len(t) for t in texts if t)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal block, block_id
            sums = np.concatenate(block.sums)
            pair, n_docs, n_links, planes = block.planes(aligner)

            def batch(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
                kinds = {"block": pa.int64(), "place": pa.int32(), "groups_sha256": pa.string(), "planes": pa.list_(pa.binary())}
                kinds |= {"key": block.keys[0].type}
                given = {"block": pa.array(np.full(n, block_id)), **given}
                columns = [given[c] if c in given else pa.nulls(n, kinds.get(c, pa.int64())) for c in schema.names]
                return pa.RecordBatch.from_arrays(columns, schema.names)

            yield batch(
                block.docs,
                {
                    "place": pa.array(np.arange(block.docs, dtype=np.int32)),
                    "key": pa.concat_arrays(block.keys),
                    **{c: pa.array(sums[:, i]) for i, c in enumerate(_DOC)},
                    "groups_sha256": pa.array(block.digests, pa.string()),
                },
            )
            for start in range(0, len(pair), 10_000):
                part = slice(start, start + 10_000)
                n = len(pair[part])
                yield batch(
                    n,
                    {
                        "pair": pa.array(pair[part]),
                        "pair_docs": pa.array(n_docs[part].astype(np.int64)),
                        "pair_links": pa.array(n_links[part].astype(np.int64)),
                        "planes": planes.slice(start, n),
                    },
                )
            block_id += 1
            block = _Block()
            if len(aligner.number) > MEMORY_CHUNKS or aligner.chars > MEMORY_CHARS:
                aligner.forget()
            give_back()

        for batch in batches:
            for part in stepped([batch], "text", PART_BYTES):
                texts = part.column("text").to_pylist()
                size = sum(len(t) for t in texts if t)
                if block.docs and (block.size + size > BLOCK_BYTES or block.docs + len(texts) > BLOCK_DOCS):
                    yield from rows()
                for start in range(0, len(texts), BLOCK_DOCS):
                    if start:
                        yield from rows()
                    add(part.column("key").slice(start, BLOCK_DOCS), texts[start : start + BLOCK_DOCS])
        if block.docs:
            yield from rows()

    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return stored(given.mapInArrow(lean(step), schema), "pair-index")


def pair_counts(indexed: DataFrame) -> DataFrame:
    """Of each pair that is linked anywhere: pair, a, b, n_docs, n_links, best (no pair with its B id has more links)."""
    pairs = (
        indexed.where(F.col("pair").isNotNull())
        .groupBy("pair")
        .agg(F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
        .withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))})
    )
    most = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    return pairs.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def scores(indexed: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document: ``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: its links whose pair is a best one of its B id. count_sum: the corpus-wide links of the
    pairs of all its links, added up.
    """
    doc = ["block", "place", "key", *_DOC, "groups_sha256"]
    documents = indexed.where(F.col("place").isNotNull()).select(*doc)
    postings = (
        indexed.where(F.col("pair").isNotNull())
        .select("block", "pair", "planes")
        .join(pairs.select("pair", F.col("n_links").alias("weight"), "best"), "pair")
        .select("block", "planes", "weight", "best")
    )
    rows = documents.unionByName(postings, allowMissingColumns=True)
    added = ("n_best", "count_sum")
    schema = T.StructType(
        [
            T.StructField(key, indexed.schema["key"].dataType),
            *(T.StructField(c, T.LongType()) for c in (*_DOC, *added)),
            T.StructField("groups_sha256", T.StringType()),
        ]
    )

    def step(batches):
        for table, starts in whole_groups(batches, "block"):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                part = table.slice(a, b - a).combine_chunks()
                n = b - a - part.column("place").null_count
                here = part.slice(0, n)
                places = here.column("place").to_numpy()
                weights, best = (part.column(c).slice(n).to_numpy(zero_copy_only=False) if b - a > n else () for c in ("weight", "best"))
                members, sums, bests = [np.zeros(0, np.int64)], [], []
                lengths = []
                for weight, good, planes in zip(weights, best, part.column("planes").slice(n).to_pylist()):
                    for k, plane in enumerate(planes):
                        members.append(plane_members(plane))
                        lengths.append(len(members[-1]))
                        sums.append(int(weight) << k)
                        bests.append(int(good) << k)
                members = np.concatenate(members)
                n_best, count_sum = np.zeros((2, n), np.int64)
                np.add.at(count_sum, members, np.repeat(np.array(sums, np.int64), lengths))
                np.add.at(n_best, members, np.repeat(np.array(bests, np.int64), lengths))
                yield from pa.Table.from_arrays(
                    [
                        here.column("key"),
                        *(here.column(c) for c in _DOC),
                        pa.array(n_best[places]),
                        pa.array(count_sum[places]),
                        here.column("groups_sha256"),
                    ],
                    schema.names,
                ).to_batches()

    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return dealt.mapInArrow(lean(step), schema)


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``scores`` of all ``docs``: one row for each of their rows; an empty table gives none."""
    indexed = index(docs, a_file, b_file, key, text)
    return scores(indexed, pair_counts(indexed), key)
