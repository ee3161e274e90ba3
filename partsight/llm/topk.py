"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length. For a query and a bucket, the k-th best score so far divided by both
lengths is a threshold on the cosine: over 1 the bucket is skipped, a high one prunes vectors by
their coordinates at the query's largest components, a low one by their lengths. What is left is
verified by full products. All arithmetic on scores is on integers and exact.

Spark deals the vectors into groups of bounded size by length (a crowded length is split by hash) and
the queries into blocks; a task scores one block against one group. The longest group goes first: its
k-th best scores let most queries skip the groups of short vectors before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partsight.llm.common import stored, whole_groups

#: Vectors of a group, queries of a block, vectors of a bucket within a group.
GROUP_ROWS, BLOCK_QUERIES, BUCKET_ROWS = 8192, 1024, 512
#: Ratio of two neighbouring length classes; local cosine from which coordinates prune.
CLASS_RATIO, COORDINATE_FROM = 1.1, 0.5
FOCUS = 3
_FLOAT_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, in double precision; beyond a long, the nearest long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.floor = floor  # scores below it cannot enter

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        merged = self.found[query] + [(-int(s), int(i)) for s, i in zip(scores[order], ids[order])]
        merged.sort()
        self.found[query] = merged[: self.k]
        if len(merged) >= self.k:
            self.floor[query] = max(self.floor[query], -merged[self.k - 1][0])


def search_group(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray
) -> Best:
    """The k best of ``vectors`` for each query, none with its own id; int64 matrices. ``floor``: known k-th best."""
    best = Best(len(queries), k, floor.astype(np.float64))
    largest = max((int(np.abs(m).max()) if m.size else 0) for m in (queries, vectors))
    if largest * largest * max(1, queries.shape[1]) >= _FLOAT_EXACT:
        for i, q in enumerate(queries.astype(object)):
            products = np.array([max(-_LONG - 1, min(_LONG, int(p))) for p in vectors.astype(object) @ q] or [], np.int64)
            other = ids != query_ids[i]
            best.add(i, products[other].astype(np.int64), ids[other])
        return best
    q, p = queries.astype(np.float64), vectors.astype(np.float64)
    q_len, p_len = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
    order = np.lexsort((ids, -p_len))
    p, p_len, ids = p[order], p_len[order], ids[order]
    q_unit = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.argsort(-np.abs(q_unit), axis=1)[:, :FOCUS]
    for start in range(0, len(p), BUCKET_ROWS):
        rows = slice(start, start + BUCKET_ROWS)
        bucket, lengths, names = p[rows], p_len[rows], ids[rows]
        reach = q_len * lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, best.floor / reach, np.where(best.floor > 0, 2.0, -1.0))
        live = np.flatnonzero(local <= 1 + 1e-9)
        by_coordinate = live[local[live] >= COORDINATE_FROM]
        by_length = live[local[live] < COORDINATE_FROM]
        if len(by_coordinate):
            unit = bucket / np.maximum(lengths, 1e-300)[:, None]
            for i in by_coordinate.tolist():
                t = min(1.0, max(0.0, local[i]))
                inside = np.ones(len(bucket), bool)
                for f in focus[i].tolist():
                    x = q_unit[i, f]
                    slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    # With a cosine of t at least, the component is this near t * x; from t on, x's side is free.
                    if x > -t:
                        inside &= unit[:, f] >= t * x - slack
                    if x < t:
                        inside &= unit[:, f] <= t * x + slack
                rest = np.flatnonzero(inside)
                products = bucket[rest] @ q[i]
                keep = (products >= best.floor[i]) & (names[rest] != query_ids[i])
                if keep.any():
                    best.add(i, products[keep].astype(np.int64), names[rest][keep])
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(q_len[by_length] > 0, best.floor[by_length] / q_len[by_length], -np.inf)
            count = np.searchsorted(-lengths, -least * (1 - 1e-12) + 1e-9, side="right")
            products = q[by_length] @ bucket[: max(1, count.max())].T
            for n, i in enumerate(by_length.tolist()):
                part = products[n, : count[n]]
                keep = (part >= best.floor[i]) & (names[: count[n]] != query_ids[i])
                if keep.any():
                    best.add(i, part[keep].astype(np.int64), names[: count[n]][keep])
    return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.empty((0, 0), np.int64)


def _scored(tasks: DataFrame, k: int) -> DataFrame:
    """Runs ``search_group`` on each task: rows of (task, is_query, id, vector, floor)."""

    def step(batches):
        for rows, starts in whole_groups(batches, "task"):
            is_query = rows.column("is_query").to_numpy()
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                here = rows.slice(a, b - a)
                asked = is_query[a:b]
                queries, data = here.filter(pa.array(asked)), here.filter(pa.array(~asked))
                if not queries.num_rows or not data.num_rows:
                    continue
                q_ids = queries.column("id").to_numpy()
                best = search_group(
                    q_ids,
                    _matrix(queries.column("vector")),
                    data.column("id").to_numpy(),
                    _matrix(data.column("vector")),
                    k,
                    queries.column("floor").to_numpy(),
                )
                found = [(int(q), i, -s) for q, hits in zip(q_ids, best.found) for s, i in hits]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"]
                )

    dealt = tasks.repartition("task").sortWithinPartitions("task", "is_query", "id")
    return dealt.mapInArrow(step, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    group_rows: int = GROUP_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows for each query row, ties to smaller keys.

    Scores are integer inner products of the scaled vectors (a product beyond a long counts as the
    nearest long). Rows with a null key, or a vector that is null or holds a null or non-finite
    component, take no part; vectors of different dimension do not meet; a query finds fewer than ``k``
    where fewer rows are there. A repeated row is a candidate as often as it stands there;
    of query rows with the same key one asks (the smallest vector).
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), scaled(F.col(vector), scale).alias("vector"), is_query.alias("asked")
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumns({"dim": F.size("vector"), "norm": norm}).withColumn(
        "class", F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / F.lit(float(np.log(CLASS_RATIO)))).cast("int")).otherwise(-1)
    )
    # One row for each dimension and length class: the range of a double bounds them.
    classes = rows.groupBy("dim", "class").agg(F.count("*").alias("n"), F.count_if("asked").alias("q"), F.max("norm").alias("most")).collect()
    plan, number, blocks = [], 0, {}
    for c in sorted(classes, key=lambda c: (c["dim"], -c["class"])):
        groups = -(-c["n"] // group_rows)
        plan.append((c["dim"], c["class"], number, groups, c["most"]))
        number += groups
        blocks[c["dim"]] = blocks.get(c["dim"], 0) + c["q"]
    if not plan:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
    spark = vectors.sparkSession
    lengths = spark.createDataFrame(plan, "dim int, class int, first long, groups long, most double")
    n_blocks = spark.createDataFrame([(d, max(1, -(-q // block_queries))) for d, q in blocks.items()], "dim int, blocks long")
    spread = F.pmod(F.xxhash64("id", F.lit("group")), F.col("groups"))
    data = rows.join(F.broadcast(lengths), ["dim", "class"]).join(F.broadcast(n_blocks), "dim")
    data = data.select("id", "vector", "dim", "blocks", (F.col("first") + spread).alias("group"))
    one = rows.where("asked").groupBy("id").agg(F.min(F.struct("vector", "dim", "norm")).alias("row")).select("id", "row.*")
    asked = one.join(F.broadcast(n_blocks), "dim").withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    )
    width = 1 + max(-(-q // block_queries) for q in blocks.values())
    task = (F.col("group") * F.lit(width) + F.col("block")).alias("task")

    def run(asked_groups: DataFrame, of_groups: Column) -> DataFrame:
        """asked_groups: query rows with group and floor."""
        candidates = data.where(of_groups).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return _scored(
            candidates.select(task, F.lit(False).alias("is_query"), "id", "vector", F.lit(0.0).alias("floor")).unionByName(
                asked_groups.select(task, F.lit(True).alias("is_query"), "id", "vector", "floor")
            ),
            k,
        )

    # The longest group of each dimension first.
    heads = {}
    for dim, _, first, _, _ in plan:
        heads.setdefault(dim, first)
    head = spark.createDataFrame(list(heads.items()), "dim int, group long")
    first_groups = list(heads.values())
    start = asked.join(F.broadcast(head), "dim").withColumn("floor", F.lit(float("-inf")))
    opening = stored(run(start, F.col("group").isin(first_groups)), "topk")
    kth = opening.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("least").cast("double").alias("floor"))
    # Of the others, each query meets those long enough to reach its k-th best score.
    each = lengths.withColumn("group", F.explode(F.expr("sequence(first, first + groups - 1)"))).where(~F.col("group").isin(first_groups))
    per_dim = each.groupBy("dim").agg(F.collect_list(F.struct("group", "most")).alias("others"))
    later = (
        asked.join(kth, "id", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        .join(F.broadcast(per_dim), "dim")
        .withColumn("other", F.explode("others"))
        .where((F.col("floor") <= 0) | (F.col("norm") * F.col("other.most") * F.lit(1 + 1e-9) >= F.col("floor")))
        .withColumn("group", F.col("other.group"))
    )
    found = opening.unionByName(run(later, ~F.col("group").isin(first_groups)))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
