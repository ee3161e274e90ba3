"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

The graph is built by Spark joins: neighbours of a node, and nodes that have it as a neighbour, meet
at that node (neighbours of neighbours), each pair is scored there, and each node keeps its ``K``
best. It starts from exact neighbours within small blocks of vectors on the same side of random
planes. A query walks the graph greedily: the best unexpanded nodes of its pool are expanded, their
neighbours scored, the best ``POOL`` kept. Graph and walk use single-precision vectors, so near copies keep
their order; final scores are computed from the original vectors in double precision. Equal vectors are
one node.

Recall of the 20 nearest against brute force, with the values below: 0.94 over 51,282 vectors in ten
clusters of 64 dimensions (2,565 queries).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.llm.common import stored, whole_groups
from partsight.llm.topk import usable

#: Neighbours of a node; rounds of descent; of each node's new and old acquaintances, so many meet.
K, ROUNDS, MEET = 40, 7, 32
#: Tables of the start, and rows of a block in it.
TABLES, BLOCK = 6, 200
#: Updates that a meeting gives a node at most: its best. The next round brings the rest.
UPDATES = 12
#: The walk: nodes in a query's pool, expanded in a hop, hops.
POOL, EXPAND, HOPS = 200, 32, 6

_EDGE = "u long, v long, s float, new boolean"


def _nodes(rows: DataFrame, copies: int) -> DataFrame:
    """One row for each vector: id (the smallest key), vector, members (the ``copies`` smallest keys)."""
    order = Window.partitionBy("vector").orderBy("key")
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= copies)
    return few.groupBy("vector").agg(F.min("key").alias("id"), F.sort_array(F.collect_list("key")).alias("members"))


def _single(nodes: DataFrame, tables: int, planes: int) -> DataFrame:
    """id, dim, q (single-precision components), sides (which side of the planes, per table)."""

    def step(batches):
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, dims, qs, sides = batch.column("id"), [], [], []
            for vector in batch.column("vector"):
                x = np.array(vector.values, np.float64)
                if len(x) not in normals:
                    normals[len(x)] = np.random.default_rng(len(x)).standard_normal((tables * planes, len(x)))
                dims.append(len(x))
                qs.append(x.astype(np.float32).tobytes())
                bits = (normals[len(x)] @ x > 0).reshape(tables, planes)
                sides.append((bits @ (1 << np.arange(planes))).tolist())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(dims, pa.int32()), pa.array(qs, pa.binary()), pa.array(sides, pa.list_(pa.int64()))],
                ["id", "dim", "q", "sides"],
            )

    return nodes.select("id", "vector").mapInArrow(step, "id long, dim int, q binary, sides array<long>")


def _matrix(rows: pa.Table) -> np.ndarray:
    """The vectors ``q`` of the rows, which have one dimension."""
    return np.frombuffer(b"".join(rows.column("q").to_pylist()), np.float32).reshape(rows.num_rows, -1)


def _start(single: DataFrame, k: int, block: int) -> DataFrame:
    """Edges to the best ``k`` of each node's block in each table; a crowded block is split by hash."""
    sided = single.select("id", "dim", "q", F.posexplode("sides").alias("t", "side"))
    sizes = sided.groupBy("dim", "t", "side").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts"))
    dealt = sided.join(sizes, ["dim", "t", "side"]).select(
        F.xxhash64("dim", "t", "side", F.pmod(F.xxhash64("id", "t"), F.col("parts"))).alias("g"), "id", "q"
    )

    def step(batches):
        for rows, starts in whole_groups(batches, "g"):
            ids = rows.column("id").to_numpy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a < 2:
                    continue
                x = _matrix(rows.slice(a, b - a))
                scores = x @ x.T
                np.fill_diagonal(scores, -np.inf)
                best = np.argsort(-scores, axis=1)[:, : min(k, b - a - 1)]
                u = np.repeat(ids[a:b], best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), pa.array(ids[a:b][best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel()), pa.array(np.ones(len(u), bool))],
                    ["u", "v", "s", "new"],
                )

    return dealt.repartition("g").sortWithinPartitions("g", "id").mapInArrow(step, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's ``k`` best different neighbours; an edge that was there before is not new."""

    def step(batches):
        for rows, starts in whole_groups(batches, "u"):
            u, v, s, new = (rows.column(c).to_numpy() for c in ("u", "v", "s", "new"))
            # By node, neighbour, known edges first: of an edge's rows the first stays.
            order = np.lexsort((new, v, u))
            u, v, s, new = u[order], v[order], s[order], new[order]
            first = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])))
            u, v, s, new = u[first], v[first], s[first], new[first]
            order = np.lexsort((v, -s, u))
            u, v, s, new = u[order], v[order], s[order], new[order]
            begin = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            place = np.arange(len(u)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(u)]))))
            keep = place < k
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (u, v, s, new)], ["u", "v", "s", "new"])

    return edges.repartition("u").sortWithinPartitions("u").mapInArrow(step, _EDGE)


def _meetings(edges: DataFrame, single: DataFrame, k: int, number: int, meet: int, updates: int) -> DataFrame:
    """Better edges found where neighbours of neighbours meet."""
    both = edges.select(F.col("u").alias("at"), F.col("v").alias("id"), "new").unionByName(
        edges.select(F.col("v").alias("at"), F.col("u").alias("id"), "new")
    )
    order = Window.partitionBy("at", "new").orderBy(F.xxhash64("at", "id", F.lit(number)))
    few = both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= meet).select("at", "id", "new")
    least = F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(float("-inf")).cast("float"))
    worst = edges.groupBy("u").agg(least.alias("least")).withColumnRenamed("u", "id")
    known = single.select("id", "q").join(worst, "id")
    met = few.join(known, "id").select("at", "id", "new", "q", "least")

    def step(batches):
        for rows, starts in whole_groups(batches, "at"):
            ids, new = rows.column("id").to_numpy(), rows.column("new").to_numpy()
            least = rows.column("least").to_numpy()
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                fresh = new[a:b]
                if b - a < 2 or not fresh.any():
                    continue
                here = ids[a:b]
                x = _matrix(rows.slice(a, b - a))
                scores = x @ x.T
                scores[~(fresh[:, None] | fresh[None, :])] = -np.inf
                scores[here[:, None] == here[None, :]] = -np.inf
                if b - a > updates:
                    best = np.argpartition(-scores, updates - 1, axis=1)[:, :updates]
                else:
                    best = np.tile(np.arange(b - a), (b - a, 1))
                s = np.take_along_axis(scores, best, 1)
                row, column = np.nonzero(s > least[a:b, None])
                found.append((here[row], here[best[row, column]], s[row, column]))
            if found:
                u, v, s = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u), pa.array(v), pa.array(s.astype(np.float32)), pa.array(np.ones(len(u), bool))], ["u", "v", "s", "new"]
                )

    return met.repartition("at").sortWithinPartitions("at", "id").mapInArrow(step, _EDGE)


def build_graph(single: DataFrame, k: int = K, rounds: int = ROUNDS, meet: int = MEET, updates: int = UPDATES, block: int = BLOCK) -> DataFrame:
    """Edges u, v, s of the neighbour graph over ``single`` (id, dim, q, sides)."""
    edges = stored(_best(_start(single, k, block), k), "graph")
    for number in range(rounds):
        better = _meetings(edges, single, k, number, meet, updates)
        edges = stored(_best(edges.withColumn("new", F.lit(False)).unionByName(better), k), "graph")
    return edges.drop("new")


_STATE = "query long, node long, s float, state int"


def _walk(state: DataFrame, asked: DataFrame, edges: DataFrame, single: DataFrame, pool: int, expand: int) -> DataFrame:
    """One hop. state: query, node, s, state (1 in the pool, 2 to expand now, 3 expanded)."""
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("next"))
    back = edges.select(F.col("v").alias("node"), F.col("u").alias("next"), "s")
    order = Window.partitionBy("node").orderBy(F.desc("s"), "next")
    back = back.withColumn("place", F.row_number().over(order)).where(F.col("place") <= K).select("node", "next")
    reached = state.where("state = 2").select("query", "node").join(out.unionByName(back), "node").select("query", "next").distinct()
    scored = reached.join(single.select(F.col("id").alias("next"), "q"), "next").select(
        "query", F.col("next").alias("node"), F.lit(0.0).cast("float").alias("s"), F.lit(0).alias("state"), "q"
    )
    nothing = F.lit(None).cast("binary").alias("q")
    own = asked.select("query", F.lit(-1).cast("long").alias("node"), F.lit(0.0).cast("float").alias("s"), F.lit(-1).alias("state"), "q")
    rows = scored.unionByName(state.select("query", "node", "s", "state", nothing)).unionByName(own)

    def step(batches):
        for rows, starts in whole_groups(batches, "query"):
            query, node, s, states = (rows.column(c).to_numpy().copy() for c in ("query", "node", "s", "state"))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                here = states[a:b]
                fresh = np.flatnonzero(here == 0) + a
                if len(fresh):
                    x = _matrix(rows.slice(a, b - a).take(pa.array(np.flatnonzero(here == -1)[:1])))[0]
                    s[fresh] = _matrix(rows.take(pa.array(fresh))) @ x
                kept = np.flatnonzero(here >= 0) + a
                state_of = np.where(states[kept] == 2, 3, states[kept])
                # Of a node's rows the one furthest on stays.
                order = np.lexsort((-state_of, node[kept]))
                kept, state_of = kept[order], state_of[order]
                first = np.concatenate(([True], node[kept][1:] != node[kept][:-1])) if len(kept) else np.empty(0, bool)
                kept, state_of = kept[first], np.maximum(state_of[first], 1)
                order = np.lexsort((node[kept], -s[kept]))[:pool]
                kept, state_of = kept[order], state_of[order]
                state_of[np.flatnonzero(state_of == 1)[:expand]] = 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[kept]), pa.array(node[kept]), pa.array(s[kept]), pa.array(state_of.astype(np.int32))],
                    ["query", "node", "s", "state"],
                )

    return rows.repartition("query").sortWithinPartitions("query", "state", "node").mapInArrow(step, _STATE)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", hops: int = HOPS) -> DataFrame:
    """query_id, rank, vec_id, score: about the ``k`` nearest other rows of each query row.

    Nearest is the largest inner product, ties to smaller keys; score is that of the original vectors
    in double precision. Rows with a null key, or a vector that is null, zero or holds a null or
    non-finite component, take no part; vectors of different dimension never meet. A query finds fewer
    than ``k`` where fewer rows are there. Rows equal in key and vector are one; of query rows that share
    a key the smallest vector asks.
    """
    sound = vectors.where(F.col(key).isNotNull() & usable(F.col(vector)) & F.exists(vector, lambda x: x != F.lit(0.0)))
    rows = sound.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), is_query.alias("asked"))
    nodes = stored(_nodes(rows.select("key", "vector").distinct(), k + 1), "nodes")
    count = nodes.count()
    planes = max(1, math.ceil(math.log2(max(2, count) / BLOCK)) + 1) if count > BLOCK else 1
    single = stored(_single(nodes, TABLES, planes), "single")
    edges = build_graph(single)
    asked = rows.where("asked").groupBy("key").agg(F.min("vector").alias("vector"))
    placed = stored(asked.join(nodes.select("vector", "id"), "vector").select(F.col("key").alias("query"), "id", "vector"), "asked")
    # The walk depends on the vector only: one for each node that a query stands on.
    start = placed.select(F.col("id").alias("query")).distinct()
    own = start.join(single.select(F.col("id").alias("query"), "q"), "query")
    state = start.select("query", F.col("query").alias("node"), F.lit(float("inf")).cast("float").alias("s"), F.lit(2).alias("state"))
    for _ in range(hops):
        state = stored(_walk(state, own, edges, single, POOL, EXPAND), "walk")
    reached = state.select(F.col("query").alias("id"), "node").join(placed, "id").select("query", "vector", "node")
    pairs = reached.join(nodes.select(F.col("id").alias("node"), F.col("vector").alias("other"), "members"), "node")
    product = F.aggregate(
        F.zip_with("vector", "other", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    scored = pairs.select("query", product.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "vec_id", "score"
    )
