"""A message history checked as a whole: state machines, two listings, and their order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.operators.ordered import stored

#: X11: rows of a range whose digests are compared before its rows are.
ROWS_A_RANGE = 10_000
#: Rows that one task counts inversions among, and the most blocks and ranges of a list.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 1_000


# -- X10: state machines -----------------------------------------------------------------------------


def replay_states(
    requests: DataFrame, allowed: dict[str, tuple[str, ...]], start: str, key: str = "conversation_id"
) -> DataFrame:
    """The state each conversation ends in when every move is checked: ``key``, state, accepted, refused.

    ``requests``: key, at, request_id, target. A move to a target that its state does not allow is refused
    and changes nothing, so what is allowed depends on all moves before. A run of moves is a map from the
    state before it to the state after it; such maps are composed. The rows are range partitioned by key
    and time, one pass turns each key's rows of a partition into one map, and the maps of a key, as many
    as it has partitions, are composed in order: a key with a third of all rows is worked on everywhere.
    Null keys are a key; targets that no state knows are refused.
    """
    states = sorted({start, *allowed, *(t for targets in allowed.values() for t in targets)})
    index = {s: i for i, s in enumerate(states)}
    n = len(states)
    # Per target, the state that each state moves to; the last row is for targets nobody knows.
    moves = np.tile(np.arange(n), (n + 1, 1))
    for state, targets in allowed.items():
        for target in targets:
            moves[index[target], index[state]] = index[target]
    refuses = moves == np.arange(n)
    for state, targets in allowed.items():
        if state in targets:
            refuses[index[state], index[state]] = False

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place, after, refused, count = None, -1, np.arange(n), np.zeros(n, np.int64), 0

        def row():
            return (now, place, after.tolist(), refused.tolist(), count)

        for frame in frames:
            out = []
            keys, targets = frame["key"].to_numpy(), frame["target"].map(lambda t: index.get(t, n)).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
            for a, b in zip((0, *cuts), (*cuts, len(keys))):
                if keys[a] != now or place < 0:
                    if place >= 0:
                        out.append(row())
                    now, place, after, refused, count = keys[a], int(frame["part"].iloc[a]), np.arange(n), np.zeros(n, np.int64), 0
                for t in targets[a:b]:
                    refused += refuses[t][after]
                    after = moves[t][after]
                count += b - a
            yield pd.DataFrame(out, columns=["key", "part", "after", "refused", "moves"])
        if place >= 0:
            yield pd.DataFrame([row()], columns=["key", "part", "after", "refused", "moves"])

    named = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("key"), "at", "request_id", F.coalesce("target", F.lit("")).alias("target"))
    dealt = named.repartitionByRange("key", "at", "request_id").sortWithinPartitions("key", "at", "request_id")
    parts = dealt.withColumn("part", F.spark_partition_id()).select("key", "target", "part")
    composed = parts.mapInPandas(maps, "key string, part int, after array<int>, refused array<long>, moves long")
    run = F.array_sort(F.collect_list(F.struct("part", "after", "refused")))
    first = F.struct(F.lit(index[start]).alias("state"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, m: Column) -> Column:
        return F.struct(F.get(m["after"], acc["state"]).alias("state"), (acc["refused"] + F.get(m["refused"], acc["state"])).alias("refused"))

    # One map for each partition that holds the key.
    ends = composed.groupBy("key").agg(F.aggregate(run, first, step).alias("end"), F.sum("moves").alias("moves"))
    names = F.array(*map(F.lit, states))
    return ends.select(
        F.when(F.col("key") != "\u0000", F.col("key")).cast(requests.schema[key].dataType).alias(key),
        F.get(names, F.col("end.state")).alias("state"),
        (F.col("moves") - F.col("end.refused")).alias("accepted"),
        F.col("end.refused").alias("refused"),
    )


# -- X11: two listings -------------------------------------------------------------------------------


def compare_listings(first: DataFrame, second: DataFrame, key: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """X11: rows that differ between two listings: ``key``, change (``new``, ``missing`` or ``changed``), first, second.

    Keys are dealt into ranges of their hash. Each range of each listing has a digest, summed up before
    anything is moved; only rows of ranges whose digests differ are joined. Two listings that agree cost two
    scans and no join of rows. A key may stand in a listing more than once; then the range is compared by
    the count of its rows too, and rows pair up by their number within the key. first, second: the rows'
    ``columns`` as structs, null where there is none.
    """
    if ranges is None:
        ranges = max(16, first.count() // ROWS_A_RANGE)

    def named(listing: DataFrame) -> DataFrame:
        row = F.struct(*columns)
        return listing.select(
            key, row.alias("row"), F.pmod(F.xxhash64(key), F.lit(ranges)).alias("range"), F.xxhash64(key, *columns).alias("h")
        )

    def digests(listing: DataFrame, side: str) -> DataFrame:
        summed = F.sum(F.col("h").cast("decimal(38,0)"))
        return listing.groupBy("range").agg(F.count(F.lit(1)).alias(f"n{side}"), F.bit_xor("h").alias(f"x{side}"), summed.alias(f"s{side}"))

    a, b = named(first), named(second)
    both = digests(a, "1").join(digests(b, "2"), "range", "full")
    same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("x1").eqNullSafe(F.col("x2")) & F.col("s1").eqNullSafe(F.col("s2"))
    open_ranges = both.where(~same).select("range")

    def numbered(listing: DataFrame, name: str) -> DataFrame:
        copies = listing.join(open_ranges, "range", "left_semi").groupBy(key, "row").agg(F.count(F.lit(1)).alias("n"))
        each = copies.select(key, "row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
        order = Window.partitionBy(key).orderBy("row", "copy")
        return each.withColumn("no", F.row_number().over(order)).select(F.col(key).alias(f"{name}_key"), "no", F.col("row").alias(name))

    left, right = numbered(a, "first"), numbered(b, "second").withColumnRenamed("no", "no2")
    joined = left.join(right, F.col("first_key").eqNullSafe(F.col("second_key")) & (F.col("no") == F.col("no2")), "full")
    change = F.when(F.col("no").isNull(), "new").when(F.col("no2").isNull(), "missing").otherwise("changed")
    return joined.where(~F.col("first").eqNullSafe(F.col("second"))).select(
        F.coalesce("first_key", "second_key").alias(key), change.alias("change"), "first", "second"
    )


# -- X18: order --------------------------------------------------------------------------------------


def _later_smaller(values: np.ndarray, groups: np.ndarray | None = None) -> int:
    """Pairs i < j with values[i] > values[j]; of those with ``groups`` only pairs from different ones (groups do not fall)."""

    def count(v: np.ndarray) -> int:
        # By the bits of the ranks from the top, rows whose higher bits are equal stand together in their order:
        # of these, each row whose bit is 0 is smaller than all before it whose bit is 1.
        v = np.unique(v, return_inverse=True)[1]
        total, ones, first = 0, np.zeros(len(v) + 1, np.int64), np.zeros(len(v), np.int64)
        for k in reversed(range(int(v.max(initial=0)).bit_length())):
            bit = (v >> k) & 1
            np.cumsum(bit, out=ones[1:])
            total += int((ones[:-1] - ones[first])[bit == 0].sum())
            v = v[np.argsort(v >> k, kind="stable")]
            starts = np.flatnonzero(np.diff(v >> k, prepend=-1))
            first = np.repeat(starts, np.diff(starts, append=len(v)))
        return total

    whole = count(values)
    if groups is None:
        return whole
    # Lifted by their group, values of different groups are in order: what is left are the pairs of one group.
    places, ranks = (np.unique(x, return_inverse=True)[1] for x in (groups, values))
    return whole - count(places * (len(values) + 1) + ranks)


def inversions(rows: DataFrame, list_key: str, position: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """X18 (M1): how far each list is from being sorted: ``list_key``, n, inversions.

    An inversion is a pair whose earlier row has the larger ``value``; ``position`` (whole numbers from 0,
    without gaps) orders a list. A list is cut into blocks of positions and into ranges of values, about as
    many of each. Pairs of different blocks and ranges come from the counts of the grid; pairs of one block
    are counted within the block, and pairs of one range but different blocks within the range. So no task
    holds more than a block or a range. Values that are a bound of a range are a range of their own, as
    equal values have no inversions. Null values are left out.
    """
    given = stored(rows.where(F.col(value).isNotNull()).select(
        F.col(list_key).alias("list"), F.col(position).cast("long").alias("at"), F.col(value).alias("value")
    ), "given")
    # Stored, as all below read them: joined as they are computed, they would be taken for as large as the rows, which
    # were shuffled by list then, most of them to one task.
    sizes = stored(given.groupBy("list").agg(F.count(F.lit(1)).alias("n"), (F.max("at") + 1).alias("span")), "sizes")
    blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n") / block_rows)).cast("int")
    sized = sizes.withColumn("blocks", F.greatest(blocks, F.lit(1)))
    ranked = given.join(sized, "list").withColumn("block", F.floor(F.col("at") * F.col("blocks") / F.col("span")).cast("int"))
    # Bounds of the ranges: from a sketch of the values of each list with more than one block.
    shares = [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    sketched = ranked.where("blocks > 1").groupBy("list").agg(F.percentile_approx("value", shares, 100_000).alias("bounds"), F.max("blocks").alias("blocks"))
    chosen = F.array_distinct(F.filter("bounds", lambda b, i: (i + 1) % F.ceil(F.lit(MOST_BLOCKS) / F.col("blocks")) == 0))
    bounds = stored(sketched.select("list", chosen.alias("bounds")), "bounds")
    cut = ranked.join(bounds, "list", "left").withColumn("bounds", F.coalesce("bounds", F.array().cast(bounds.schema["bounds"].dataType)))
    # Bounds below the value, by halving: comparing with each would cost a row up to a thousand steps.
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(MOST_BLOCKS.bit_length()))))
    below = F.aggregate(halves, F.lit(0), lambda n, half: F.when(F.get("bounds", n + half - 1) < F.col("value"), n + half).otherwise(n))
    placed = cut.withColumn("below", below).withColumn("on", F.coalesce(F.get("bounds", "below") == F.col("value"), F.lit(False)).cast("int"))
    cells = stored(placed.select("list", "at", "value", "block", (2 * F.col("below") + F.col("on")).alias("range")), "cells")

    within = _counted(cells, "block", spans=False)
    across = _counted(cells.where("range % 2 = 0").join(sized.where("blocks > 1").select("list"), "list", "left_semi"), "range", spans=True)

    # The grid: rows of earlier blocks in higher ranges, as running sums over a full grid.
    counts = cells.groupBy("list", "block", "range").agg(F.count(F.lit(1)).alias("n"))
    grid = (
        sized.join(bounds, "list")
        .select("list", "bounds", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .select("list", "block", F.explode(F.sequence(F.lit(0), 2 * F.size("bounds"))).alias("range"))
    )
    full = grid.join(counts, ["list", "block", "range"], "left").fillna({"n": 0})
    before = Window.partitionBy("list", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("list", "block").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = full.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    higher = earlier.withColumn("higher", F.coalesce(F.sum("earlier").over(above), F.lit(0)))
    crossed = higher.groupBy("list").agg(F.sum(F.col("n") * F.col("higher")).alias("inversions"))
    parts = within.unionByName(across).unionByName(crossed)
    total = parts.groupBy("list").agg(F.sum("inversions").alias("inversions"))
    return sizes.join(total, "list", "left").select(
        F.col("list").alias(list_key), "n", F.coalesce("inversions", F.lit(0)).cast("long").alias("inversions")
    )


def _counted(cells: DataFrame, part: str, spans: bool) -> DataFrame:
    """list, inversions: summed over the parts of the lists; with ``spans`` only pairs of different blocks."""
    kind = cells.schema["list"]

    def count(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("at", kind="stable")
        groups = ordered["block"].to_numpy() if spans else None
        return pd.DataFrame({"list": [group[1]], "inversions": [_later_smaller(ordered["value"].to_numpy(), groups)]})

    schema = f"list {kind.dataType.simpleString()}, inversions long"
    # By part first: rows are sorted by these keys, and most rows may be of one list.
    needed = cells.select(part, "list", "at", "value", *(["block"] if spans else []))
    found = needed.groupBy(part, "list").applyInPandas(count, schema)
    return found.groupBy("list").agg(F.sum("inversions").alias("inversions"))
