"""Exact k best inner products of integer vectors, by branch and bound over a ball tree per shard.

All rows are dealt into shards by hash. A shard's points are split in halves, each time along the line through two far
points, down to leaves of ``LEAF``; a node keeps the centre c and radius r of its ball. No point of it can have a product
with a query q above q.c + |q| r, nor above the bound of the node around it. A query takes a shard's leaves by falling
bound and stops where the bound is below its current k-th score, a bound equal to it included, as a tie may have a
smaller id.

The k-th score is shared: among the nodes of a shard, among the shards that a task reads, and among tasks, as every query
searches one shard first and carries its k-th score to all the others. Products are exact, and bounds are widened by more
than their rounding, so results are exact.

Which rows take part is said in ``vector_blocks``: null, non-finite and oversized vectors do not, nor do rows without an
id or of another dimension than most; repeated rows and ids count once. Zero vectors take part and score 0. Extra columns
are not read. A table without rows, or without queries, gives no rows; a query with fewer than k others gives them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structsim.llm.vector_blocks import BLOCK, NOTHING, SCALE, SHARD, Best, integer_vectors, meeting, packed, products, unpacked
from structsim.llm.workspace import new_folder, written

NEAREST, LEAF = 5, 128
_FOUND = "query_id long, vec_id long, score long"
_ROWS = "query_id long, rank int, vec_id long, score long"


def levels(n: int, leaf: int = LEAF) -> int:
    """Halvings of ``n`` points down to leaves of at most ``leaf``."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))


def cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among the points, in order."""
    return np.arange((1 << level) + 1) * n // (1 << level)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points in which every node is a range, and all nodes' centres and radii, level by level."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    centres, radii = [], []
    deepest = levels(len(x), leaf)
    for level in range(deepest + 1):
        at = cuts(len(x), level)
        for a, b in zip(at, at[1:], strict=False):
            own = x[order[a:b]]
            centre = own.mean(axis=0)
            apart = np.linalg.norm(own - centre, axis=1)
            centres.append(centre)
            radii.append(apart.max())
            if level < deepest:
                far = own[apart.argmax()]
                other = own[np.linalg.norm(own - far, axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(own @ (other - far), kind="stable")]
        # the halves of a node are ranges of its sorted points: cuts of the next level lie within those of this one
    return order, np.array(centres).reshape(len(centres), x.shape[1]), np.array(radii)


def leaf_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray, depth: int) -> np.ndarray:
    """For every query and leaf, a number that no product with a point of the leaf exceeds."""
    x = queries.astype(np.float64)
    length = np.linalg.norm(x, axis=1)[:, None]
    reach = np.linalg.norm(centres, axis=1) + radii
    # rounding of a product of d terms stays far below 1e-9 of the lengths' product
    bound = x @ centres.T + length * radii + 1e-9 * length * reach + 1e-6
    above = bound[:, :1]
    for level in range(1, depth + 1):
        own = bound[:, (1 << level) - 1 : (2 << level) - 1]
        above = np.minimum(own, np.repeat(above, 2, axis=1))
    return above


def search_shard(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, centres: np.ndarray,
                 radii: np.ndarray, best: Best, floor: np.ndarray, leaf: int = LEAF) -> int:
    """Takes a shard's points into ``best``; ``floor`` is a score that k others are known to reach. Products worked out."""
    depth = levels(len(ids), leaf)
    at = cuts(len(ids), depth)
    bound = leaf_bounds(queries, centres, radii, depth)
    turn = np.argsort(-bound, axis=1, kind="stable")
    worked = 0
    active = np.arange(len(queries))
    for nth in range(bound.shape[1]):
        least = np.maximum(best.least(), floor)
        active = active[bound[active, turn[active, nth]] >= least[active]]
        if not len(active):
            break
        leaves = turn[active, nth]
        for node in np.unique(leaves):
            seek = active[leaves == node]
            own = slice(at[node], at[node + 1])
            score = products(queries[seek], points[own])
            worked += score.size
            row, place = np.nonzero((score >= least[seek][:, None]) & (query_ids[seek][:, None] != ids[own]))
            best.add(seek[row], ids[own][place], score[row, place])
    return worked


def _tree_columns(leaf: int):
    def extra(points: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        order, centres, radii = ball_tree(points, leaf)
        return order, [centres.tobytes(), radii.tobytes()]

    return extra


def _searching(dimension: int, k: int, leaf: int):
    def work(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        # a query's label column holds the k-th score that it brings along
        query_ids, floor, queries = unpacked(block, dimension)
        best = Best(len(query_ids), k)
        for shard in shards:
            ids, _, points = unpacked(shard, dimension)
            radii = np.frombuffer(shard["radii"], np.float64)
            centres = np.frombuffer(shard["centres"], np.float64).reshape(len(radii), dimension)
            search_shard(queries, query_ids, points, ids, centres, radii, best, floor, leaf)
        row, ids, scores = best.entries()
        yield pa.record_batch([pa.array(query_ids[row]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return work


def top_k(vectors: DataFrame, is_query: Column, k: int = NEAREST, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK,
          leaf: int = LEAF) -> DataFrame:
    """The k rows of highest inner product with each row that ``is_query`` (a condition on vec_id), but for the row itself:
    query_id, rank (from 1), vec_id, score."""
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession, "top-k")
    rows, n, d = integer_vectors(vectors, folder, scale=scale)
    asking = rows.where(is_query)
    n_asking = asking.count()
    if not n_asking:
        return spark.createDataFrame([], _ROWS)
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-n_asking // block))
    index = written(packed(rows, shard, n, _tree_columns(leaf), ("centres", "radii")), folder, "index")

    def searched(floors: Column, asks: DataFrame, pairs: Column) -> DataFrame:
        blocks = packed(asks.select("vec_id", floors.alias("label"), "q"), block, n_asking)
        return meeting(blocks, index, n_blocks, n_shards, _searching(d, k, leaf), _FOUND, pairs)

    home = F.pmod("block", F.lit(n_shards)) == F.col("shard")
    first = written(searched(F.lit(NOTHING), asking, home), folder, "first")
    if n_shards > 1:
        floor = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count("*").alias("held"))
        asks = asking.join(floor, "vec_id", "left")
        known = F.when(F.col("held") == k, F.col("least")).otherwise(F.lit(NOTHING))
        first = first.unionByName(written(searched(known, asks, ~home), folder, "others"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
