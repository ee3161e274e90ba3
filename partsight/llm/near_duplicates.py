"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

1. A text's word shingles are hashed, and ``BANDS * ROWS`` universal hashes give their minima. Texts
   with equal shingle sets become one class at once, so copies cost nothing further on.
2. Classes that share all minima of a band meet in a bucket. In it, one byte of each minimum is
   compared; only a spanning forest of the likely links leaves the task. A bucket over
   ``BUCKET_BLOCK`` members is split into blocks, and pairs of blocks meet in separate tasks.
3. The likely links make candidate components. Within one, links are confirmed on full shingle sets.
   A component over ``SET_BLOCK`` members is dealt into blocks, each joined by the same few pivots;
   members that are still apart from its largest part then meet all blocks. No confirmed link
   between two parts is lost, and none within a part is needed.
4. Large-star and small-star steps on the confirmed links and the copies give the components.

With 24 bands of 5 minima, a pair at similarity 0.85 shares no band in one case of a million; a pair
fails the byte comparison in less than one of ten million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partsight.llm.common import compressed, decompressed, lean, mix, stepped, stored, whole_groups
from partsight.llm.components import components

BANDS, ROWS = 24, 5
#: Of 120 signature bytes, so many agree at least between likely links (for a similarity of 0.85).
SIGMAS = 6.2
BUCKET_BLOCK, SET_BLOCK, PIVOTS = 2048, 1024, 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTES = mix(np.arange(11, 267, dtype=np.uint64) * _A)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` universal hashes."""
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _B)
    return seeds[:count, None] | np.uint64(1), seeds[count:, None]


class Shingler:
    """Distinct shingle hashes of texts: words between the ASCII spaces, A-Z lower-cased."""

    def __init__(self, words: int = 3):
        self.words = words
        self.powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _tables(self, n: int):
        if len(self.powers[0]) < n:
            inverse = np.uint64(pow(int(_A), -1, 1 << 64))
            both = []
            for r in (_A, inverse):
                table = np.full(n, r, np.uint64)
                table[0] = 1
                both.append(np.multiply.accumulate(table))
            self.powers = tuple(both)
        return self.powers

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted; empty without words; the whole sequence as one shingle if it is shorter."""
        data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        space = np.concatenate(([True], _SPACE[data], [True]))
        first = np.flatnonzero(space[:-1] & ~space[1:])
        last = np.flatnonzero(~space[:-1] & space[1:])
        if not len(first):
            return np.empty(0, np.uint64)
        powers, inverses = self._tables(len(data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[: len(data)])))
        word = mix((total[last] - total[first]) * inverses[first])
        size = min(self.words, len(word))
        out = np.full(len(word) - size + 1, size, np.uint64)
        for n in range(size):
            out = mix(out * _A + word[n : n + len(out)])
        return np.unique(out)


def minima(shingles: np.ndarray, universal: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = universal
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        best = np.minimum(best, (a * shingles[None, at : at + 4096] + b).min(axis=1))
    return best


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """doc_id, n, s1, s2 (128 bits of the set), bands, sig for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def step(batches):
        shingler, universal = Shingler(words), _universal(BANDS * ROWS)
        for batch in stepped(batches, text):
            sizes, digests, bands, sigs = [], [], [], []
            for t in batch.column(text).to_pylist():
                shingles = shingler(t)
                least = minima(shingles, universal)
                keys = np.arange(BANDS, dtype=np.uint64)
                for row in range(ROWS):
                    keys = mix(keys * _A + least[row::ROWS])
                sizes.append(len(shingles))
                digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
                bands.append(keys.view(np.int64))
                sigs.append(mix(least.copy()).astype(np.uint8).tobytes())
            digest = np.array(digests)
            flat = pa.array(np.concatenate(bands))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest[:, 0]),
                    pa.array(digest[:, 1]),
                    pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS, flat),
                    pa.array(sigs, pa.binary()),
                ],
                ["doc_id", "n", "s1", "s2", "bands", "sig"],
            )

    return docs.select(key, text).mapInArrow(lean(step), f"doc_id {kind}, n long, s1 long, s2 long, bands array<long>, sig binary")


def _alike(n: np.ndarray, m, percent: int) -> np.ndarray:
    """Sizes whose ratio allows the similarity."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _forest(ids: np.ndarray, n: np.ndarray, sig: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the likely links between the members of one bucket."""
    out = []
    free = np.arange(len(ids))
    while len(free) > 1:
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            v = queue.pop()
            hit = _alike(n[free], n[v], percent) & ((sig[free] == sig[v]).sum(axis=1) >= least)
            found = free[hit]
            out += [(ids[v], ids[w]) for w in found.tolist()]
            queue += found.tolist()
            free = free[~hit]
    return out


def _likely(members: DataFrame, least: int, percent: int) -> DataFrame:
    """a, b: likely links of the groups of ``members`` (g, id, n, sig)."""

    def step(batches):
        for rows, starts in whole_groups(batches, "g"):
            ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            hit = _alike(n[two], n[two + 1], percent) & ((sig[two] == sig[two + 1]).sum(axis=1) >= least)
            links = [(ids[two[hit]], ids[two[hit] + 1])]
            for a, b in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist()):
                found = _forest(ids[a:b], n[a:b], sig[a:b], least, percent)
                if found:
                    links.append(tuple(np.array(found, np.int64).T))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*links)], ["a", "b"])

    return members.repartition("g").sortWithinPartitions("g", "id").mapInArrow(lean(step), "a long, b long")


def _blocked(rows: DataFrame, size: str, block: int, group: str) -> DataFrame:
    """Rows with g: one group while ``size`` is at most ``block``, else one for each pair of hash blocks."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    pairs = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    return pairs.withColumn("g", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))


class Sets:
    """The shingle sets of a group's rows, end to end."""

    def __init__(self, n: np.ndarray, raw: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.starts = np.cumsum(n) - n
        self.flat = np.frombuffer(b"".join(raw), np.uint64)

    def linked(self, v: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are similar enough to row v, on full sets."""
        hit = _alike(self.n[others], self.n[v], self.percent)
        rest = others[hit]
        if not len(rest):
            return hit
        own = self.flat[self.starts[v] : self.starts[v] + self.n[v]]
        sizes = self.n[rest]
        first = np.cumsum(sizes) - sizes
        flat = self.flat[np.repeat(self.starts[rest] - first, sizes) + np.arange(sizes.sum())]
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[place] == flat).astype(np.int64), first)
        hit[hit] = 100 * common >= self.percent * (sizes + self.n[v] - common)
        return hit


def _confirmed(members: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links that join what can be joined in each group of ``members``.

    members: g, id, n, shingles, label, leads. Rows of one label need no link. Where some rows of a
    group lead, only links with a leading row are sought.
    """

    def step(batches):
        for rows, starts in whole_groups(batches, "g"):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a < 2:
                    continue
                part = rows.slice(a, b - a)
                ids, label = part.column("id").to_numpy(), part.column("label").to_numpy()
                leads = part.column("leads").to_numpy(zero_copy_only=False)
                sets = Sets(part.column("n").to_numpy(), part.column("shingles").to_pylist(), percent)
                links = []
                if leads.any():
                    for v in np.flatnonzero(leads).tolist():
                        others = np.flatnonzero(label != label[v])
                        found = others[sets.linked(v, others)]
                        for w in found[np.unique(label[found], return_index=True)[1]].tolist():
                            links.append((ids[v], ids[w]))
                else:
                    free = np.arange(len(ids))
                    while len(free) > 1:
                        queue, free = [free[0]], free[1:]
                        while queue and len(free):
                            v = queue.pop()
                            hit = sets.linked(v, free)
                            found = free[hit].tolist()
                            links += [(ids[v], ids[w]) for w in found]
                            queue += found
                            free = free[~hit]
                if links:
                    x, y = np.array(links, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return members.select("g", "id", "n", "shingles", "label", "leads").repartition("g").sortWithinPartitions("g", "id").mapInArrow(
        lean(step), "a long, b long"
    )


def _shingled(docs: DataFrame, key: str, text: str, nodes: DataFrame, words: int) -> DataFrame:
    """id, part, size, n, shingles (sorted 64-bit hashes) of the documents in ``nodes`` (id, part, size)."""

    def step(batches):
        shingler = Shingler(words)
        for batch in stepped(batches, "packed", 1 << 20):
            sets = [shingler(t.decode()) for t in decompressed(batch.column("packed"))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "part", "size")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["id", "part", "size", "n", "shingles"],
            )

    texts = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("raw")
    )
    # Merged at every size, so that what is shuffled follows the input.
    rows = compressed(texts, "raw", "packed").join(nodes.hint("merge"), "id").select("id", "part", "size", "packed")
    return rows.mapInArrow(lean(step), "id long, part long, size long, n long, shingles binary").where("n > 0")


def _links(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: confirmed links that join each candidate component's members as far as they are linked."""
    small = rows.where(F.col("size") <= block).select(
        F.col("part").alias("g"), "id", "n", "shingles", F.col("id").alias("label"), F.lit(False).alias("leads")
    )
    links = stored(_confirmed(small, percent), "links")
    large = rows.where(F.col("size") > block)
    if large.isEmpty():
        return links
    # Blocks, each with the same pivots.
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("id", F.lit("set")), F.col("blocks"))
    dealt = large.withColumn("blocks", blocks).withColumn("own", own)
    chosen = Window.partitionBy("part").orderBy(F.xxhash64("id"), "id")
    pivots = large.select("part", "id", "size").withColumn("place", F.row_number().over(chosen)).where(F.col("place") <= PIVOTS)
    everywhere = (
        dealt.join(pivots.select("part", "id").distinct(), ["part", "id"], "left_semi")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .where("other <> own")
        .withColumn("own", F.col("other"))
        .drop("other")
    )
    group = F.xxhash64("part", "own").alias("g")
    first = dealt.unionByName(everywhere).select(
        group, "id", "n", "shingles", F.col("id").alias("label"), F.lit(False).alias("leads")
    )
    links = links.unionByName(stored(_confirmed(first, percent), "links"))
    # What is apart from its component's largest part meets every block.
    found = components(links)
    labelled = large.join(found.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn(
        "label", F.coalesce("label", "id")
    )
    counts = labelled.groupBy("part", "label").agg(F.count("*").alias("members"))
    main = counts.groupBy("part").agg(F.max_by("label", F.struct("members", "label")).alias("main"), F.sum("members").alias("all"), F.max("members").alias("most"))
    apart = main.where(F.col("all") > F.col("most")).withColumn("lead_blocks", F.ceil((F.col("all") - F.col("most")) / F.lit(block)).cast("long"))
    open_rows = labelled.join(apart.select("part", "main", "lead_blocks"), "part").withColumn("blocks", blocks)
    lead_block = F.pmod(F.xxhash64("id", F.lit("lead")), F.col("lead_blocks"))
    leading = open_rows.where(F.col("label") != F.col("main")).select(
        "part", "id", "n", "shingles", "label", lead_block.alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("leads"),
    )
    other = open_rows.select(
        "part", "id", "n", "shingles", "label",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("lead_blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("id", F.lit("set")), F.col("blocks")).alias("j"), F.lit(False).alias("leads"),
    )
    crossed = leading.unionByName(other).withColumn("g", F.xxhash64("part", "i", "j"))
    return links.unionByName(stored(_confirmed(crossed, percent), "links"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85
) -> DataFrame:
    """``key``, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their shingle sets
    (percent 70 to 100; the bands are chosen for 80 and more); component_id is the smallest key
    reachable, itself included, and kept marks the row that has it. Texts without words (null, empty) are
    linked with nothing. Rows that share a key are one document. Rows with a null key are linked with
    nothing, have a null component_id and are kept. Keys are integers.
    """
    seen = stored(signatures(docs, key, text, words), "signatures")
    known = seen.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = stored(
        known.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "bands", "sig")).alias("one")).select(
            "s1", "s2", F.col("one.doc_id").alias("id"), "one.n", "one.bands", "one.sig"
        ),
        "classes",
    )
    banded = classes.select("id", F.posexplode("bands").alias("band", "value")).select(
        "id", F.xxhash64("band", "value").alias("bucket")
    )
    crowded = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = banded.join(crowded, "bucket").join(classes.select("id", "n", "sig"), "id")
    total = BANDS * ROWS
    share = percent / 100
    least = int(total * share - SIGMAS * (total * share * (1 - share)) ** 0.5) if share < 1 else total
    likely = stored(_likely(_blocked(members, "size", BUCKET_BLOCK, "bucket"), least, percent).distinct(), "likely")
    found = components(likely).select(F.col("node").alias("id"), F.col("component").alias("part"))
    parts = stored(found.join(found.groupBy("part").agg(F.count("*").alias("size")), "part"), "parts")
    sets = stored(_shingled(docs, key, text, parts, words), "sets")
    links = _links(sets, percent, SET_BLOCK)
    copies = known.join(classes.select("s1", "s2", F.col("id").alias("b")), ["s1", "s2"]).select(F.col("doc_id").alias("a"), "b")
    found = components(links.unionByName(copies.where("a <> b")))
    kind = docs.schema[key].dataType
    out = seen.select("doc_id", F.col("n").alias("n_shingles")).join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).cast(kind)
    return out.select(
        F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
