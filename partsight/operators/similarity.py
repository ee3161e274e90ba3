"""Sent messages matched with the drafts they came from, by the similarity of their word sets.

A set-similarity join with prefix and length filters. Words are ranked by how few texts hold them;
two sets that share enough must share one of the rarest words of each, so only texts with such a
word in common meet, and they are checked on the whole sets. Texts with equal word sets are one set
in the join, however many there are: copies never meet each other. Rows that meet carry a parity
sketch of their set, and a pair whose sketches differ too much is dropped where it meets: such pairs
grow with the square of the texts and are never written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partsight.operators.numbering import last_at_or_before
from partsight.operators.ordered import stored

#: Buckets of word hashes whose counts order the words, and longs of 64 bits in a set's sketch.
BUCKETS, SKETCH = 1 << 20, 4
_BITS = [f"bits{i}" for i in range(SKETCH)]


def words_of(text: Column) -> Column:
    """The distinct words: letters and digits, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != ""))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def _sets(texts: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Each text's set (id, set_key), and the sets (set_key, words)."""
    keyed = texts.select(F.col(id_column).alias("id"), F.array_sort(words_of(F.coalesce(F.col(text), F.lit("")))).alias("words")).where(F.size("words") > 0)
    # 128 bits of the digest: pairs of keys are what most of the work writes.
    keyed = keyed.withColumn("set_key", F.unhex(F.substring(F.sha2(F.concat_ws(" ", "words"), 256), 1, 32)))
    return keyed.select("id", "set_key"), keyed.groupBy("set_key").agg(F.first("words").alias("words"))


def _rarity(ranks: DataFrame) -> np.ndarray:
    """How many texts hold a word of each bucket: an order of the words that fits into 4 MB, whatever their number."""
    counted = ranks.groupBy(F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("bucket")).agg(F.sum("texts").alias("texts")).toArrow()
    rarity = np.zeros(BUCKETS, np.uint32)
    rarity[counted["bucket"].to_numpy()] = np.minimum(counted["texts"].to_numpy(), np.iinfo(np.uint32).max)
    return rarity


def _prefixes(sets: DataFrame, ranks: DataFrame | np.ndarray, percent: int) -> DataFrame:
    """set_key, size, word, place, sketch: the rarest words of each set, as many as two similar sets cannot avoid sharing.

    Keys and words are 8 bytes of their hashes; equal ones of different sets or words only add pairs, which are
    checked on the whole sets. ``ranks``: word, texts, or the ``_rarity`` of them; any order that both sides
    share loses no pair. Bit i of the sketch is whether the set has an odd number of words with hash i, so
    sketches differ in no more bits than their sets in words.
    """
    rarity = sets.sparkSession.sparkContext.broadcast(ranks if isinstance(ranks, np.ndarray) else _rarity(ranks))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sizes = batch["words"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = batch["words"].flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                bits = np.zeros((len(sizes), SKETCH), np.uint64)
                at = words.view(np.uint64) >> np.uint64(20)
                np.bitwise_xor.at(bits, (owner, (at >> np.uint64(6)) % np.uint64(SKETCH)), np.uint64(1) << (at & np.uint64(63)))
                order = np.lexsort((words, rarity.value[words & (BUCKETS - 1)], owner))
                place = np.arange(1, len(words) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kept = place <= (sizes + (-sizes * percent // 100) + 1)[owner]
                owner = owner[kept]
                columns = [batch["set_key"].to_numpy(zero_copy_only=False)[owner], sizes[owner].astype(np.int32), words[order][kept], place[kept].astype(np.int32)]
                columns += [bits[owner, i].view(np.int64) for i in range(SKETCH)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["set_key", "size", "word", "place", *_BITS])

    hashed = sets.select(F.xxhash64("set_key").alias("set_key"), F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return hashed.mapInArrow(step, f"set_key long, size int, word long, place int, {', '.join(f'{b} long' for b in _BITS)}")


def meeting_sets(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """left_key, right_key of the prefixes that share a word and can still have enough in common; pairs may repeat.

    At the rarest word that both sets hold, they can have no more in common than it and what follows it in the
    shorter rest; and they differ in as many words at least as their sketches in bits.
    """
    a, b = (
        side.select(F.col("set_key").alias(f"{name}_key"), F.col("size").alias(n), "word", F.col("place").alias(f"{n}_place"), *(F.col(c).alias(f"{n}_{c}") for c in _BITS))
        for side, name, n in ((left, "left", "a"), (right, "right", "b"))
    )
    most = 1 + F.least(F.col("a") - F.col("a_place"), F.col("b") - F.col("b_place"))
    # common >= percent / 100 * (a + b - common)
    enough = (100 + percent) * most >= percent * (F.col("a") + F.col("b"))
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("a") + F.col("b"))
    close = (100 * F.least("a", "b") >= percent * F.greatest("a", "b")) & enough & near
    return a.join(b, "word").where(close).select("left_key", "right_key")


def similar_sets(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets (left_key, right_key, common, whole) with 100 * common >= percent * whole.

    ``left``, ``right``: set_key, words. No pair is lost: with J >= percent/100 the prefixes share a
    word, and neither size is below percent/100 of the other.
    """
    words = left.select(F.explode("words").alias("word")).unionByName(right.select(F.explode("words").alias("word")))
    rarity = _rarity(words.select("word", F.lit(1).alias("texts")))
    pairs = meeting_sets(_prefixes(left, rarity, percent), _prefixes(right, rarity, percent), percent).distinct()
    common = F.size(F.array_intersect("left_words", "right_words"))

    def whole_sets(sets: DataFrame, side: str) -> DataFrame:
        return sets.select(F.xxhash64("set_key").alias(f"{side}_short"), F.col("set_key").alias(f"{side}_key"), F.col("words").alias(f"{side}_words"))

    checked = (
        pairs.select(F.col("left_key").alias("left_short"), F.col("right_key").alias("right_short"))
        .join(whole_sets(left, "left"), "left_short").join(whole_sets(right, "right"), "right_short")
        .withColumn("common", common)
        .withColumn("whole", F.size("left_words") + F.size("right_words") - F.col("common"))
    )
    return checked.where(100 * F.col("common") >= percent * F.col("whole")).select("left_key", "right_key", "common", "whole")


def match_drafts(messages: DataFrame, drafts: DataFrame, percent: int = 60, stale_hours: int = 24) -> DataFrame:
    """Of each message the draft it came from, if any: message_id, draft_id, similarity (per mille), digits_kept.

    ``messages``: message_id, text, sent_at. ``drafts``: draft_id, text, created_at, stale_at (null while
    open). Of drafts with one word set the newest before the message counts, of those the smallest id; it
    can match until ``stale_hours`` after it went stale. The most similar one wins, then the newest, then
    the smallest id. digits_kept: the message has the draft's digit runs in its order. Texts without words
    match nothing; null texts have none.
    """
    m_ids, m_sets = _sets(messages, "message_id", "text")
    d_ids, d_sets = _sets(drafts, "draft_id", "text")
    pairs = similar_sets(stored(m_sets, "sets"), stored(d_sets, "sets"), percent)
    wanted = (
        m_ids.withColumnRenamed("id", "message_id").join(pairs, F.col("set_key") == F.col("left_key"))
        .join(messages.select("message_id", "sent_at"), "message_id")
        .select("message_id", F.col("right_key").alias("set_key"), "common", "whole", F.col("sent_at").alias("at"))
    )
    until = F.col("stale_at") + F.make_dt_interval(hours=F.lit(stale_hours))
    offered = d_ids.join(drafts.select(F.col("draft_id").alias("id"), "created_at", until.alias("until")), "id").select(
        "set_key", F.col("created_at").alias("at"), F.struct("created_at", (-F.col("id")).alias("minus"), "until").alias("draft")
    )
    found = last_at_or_before(wanted, offered, ["set_key"], "at", "draft").where("draft.until IS NULL OR draft.until >= at")
    per_mille = F.floor(1000 * F.col("common") / F.col("whole")).cast("int")
    best = found.groupBy("message_id").agg(
        F.max(F.struct(F.col("common") / F.col("whole"), "draft.created_at", "draft.minus", per_mille.alias("similarity"))).alias("best")
    )
    matched = best.select("message_id", (-F.col("best.minus")).alias("draft_id"), "best.similarity")
    texts = messages.select("message_id", digit_runs(F.col("text")).alias("sent_digits"))
    drafted = drafts.select("draft_id", digit_runs(F.col("text")).alias("draft_digits"))
    return (
        texts.join(matched, "message_id", "left").join(drafted, "draft_id", "left")
        .select("message_id", "draft_id", "similarity", F.coalesce(F.col("sent_digits") == F.col("draft_digits"), F.lit(False)).alias("digits_kept"))
    )
