"""Nearest neighbours by largest inner product, over randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix and kept as the packed signs of its coordinates with two scalars:
its norm and the inner product of its direction with its code. The code gives an unbiased estimate of its inner product
with a rotated query and a bound on the estimate's error; only vectors whose estimate plus bound reaches the k-th best
exact value found so far are reranked on the original vectors, in double precision.

Query vectors and candidates are dealt into blocks by hash and every pair of blocks is searched in one task, so memory
is bounded and no pair of rows is ever a row of a table. Equal vectors are searched once: of the candidates that share a
vector only the k + 1 smallest ids can be among k nearest, and queries that share one share its answer.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those without an id or of another
dimension than most (ties: the smaller one). An id stands for one vector: of several usable rows with an id, the one with
the smallest vector counts. Ties in nearness go to the smaller vec_id. Extra columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structsim.llm.workspace import new_folder, written

NEAREST, SEED = 20, 11
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16_384
#: Standard deviations that the error bound allows for.
ERROR_WIDTH = 3.0
_STEP = 128


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs of each rotated vector, its norm, and its direction's inner product with the code."""
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def search(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best candidates of each query, best first, ties by id; candidates are in ascending id order."""
    d = vectors.shape[1]
    signs = (2.0 * np.unpackbits(codes, axis=1, count=d) - 1.0).astype(np.float32)
    scale = (norm / own / np.sqrt(d)).astype(np.float32)
    slack = (norm * np.sqrt(np.maximum(1 - own**2, 0)) / own * ERROR_WIDTH / np.sqrt(max(d - 1, 1))).astype(np.float32)
    for at in range(0, len(queries), _STEP):
        q = queries[at : at + _STEP]
        estimate = ((q @ turn.T).astype(np.float32) @ signs.T) * scale
        reach = np.linalg.norm(q, axis=1).astype(np.float32)
        for j in range(len(q)):
            if len(ids) > 3 * k:
                first = np.argpartition(-estimate[j], 3 * k)[: 3 * k]
                known = np.sort(vectors[first] @ q[j])[-k]
                rest = np.flatnonzero(estimate[j] + slack * reach[j] >= known - 1e-5 * abs(known))
                chosen = np.union1d(first, rest)
            else:
                chosen = np.arange(len(ids))
            score = vectors[chosen] @ q[j]
            order = np.lexsort((ids[chosen], -score))[:k]
            yield ids[chosen[order]], score[order]


def _encoded(batches: Iterator[pa.RecordBatch], dimension: int, seed: int) -> Iterator[pa.RecordBatch]:
    turn = rotation(dimension, seed)
    for batch in batches:
        if batch.num_rows:
            vectors = np.stack([np.asarray(v) for v in batch.column(1).to_pylist()]).astype(np.float64)
            codes, norm, own = encode(vectors, turn)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(own)], names=["vec_id", "embedding", "code", "norm", "own"])


def _searched(batches: Iterator[pa.RecordBatch], dimension: int, seed: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, asks, vec_id, embedding, code, norm, own), sorted: the queries of each block pair, then its candidates."""
    turn = rotation(dimension, seed)

    def answers(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(block).combine_chunks()
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dimension)
        seek, give = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(seek) or not len(give):
            return
        rest = table.take(pa.array(give))
        codes = np.frombuffer(b"".join(rest.column("code").to_pylist()), np.uint8).reshape(len(give), -1)
        found = search(vectors[seek], codes, rest.column("norm").to_numpy(), rest.column("own").to_numpy(), vectors[give], ids[give], turn, k)
        near = [(np.full(len(n), q), n, s) for q, (n, s) in zip(ids[seek], found, strict=True)]
        yield pa.record_batch([pa.array(np.concatenate([x[c] for x in near])) for c in range(3)], names=["asker", "vec_id", "score"])

    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and at != tuple(key[a]):
                yield from answers(held)
                held = []
            at = tuple(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from answers(held)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the rows that take part, and their dimension (0 if there are none)."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    good = good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    return good.where(F.size("embedding") == dimension), dimension


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, seed: int = SEED, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k nearest other rows of each row that ``is_query`` (a condition on vec_id): query_id, rank, vec_id, score."""
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession, "vector-search")
    good, d = usable(vectors)
    good = written(good, folder, "rows")
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = Window.partitionBy("embedding").orderBy("vec_id")
    few = good.withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= k + 1).dropDuplicates(["vec_id", "embedding"]).select("vec_id", "embedding")
    index = written(few.mapInArrow(lambda it: _encoded(it, d, seed), f"vec_id long, embedding {few.schema['embedding'].dataType.simpleString()}, code binary, norm double, own double"), folder, "index")

    asking = good.where(is_query).distinct()
    askers = written(asking.groupBy("embedding").agg(F.min("vec_id").alias("asker")), folder, "askers")
    n_index, n_askers = index.count(), askers.count()
    nq, nc = max(1, -(-n_askers // query_block)), max(1, -(-n_index // candidate_block))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    give = index.select(every(nq).alias("i"), block("vec_id", nc).alias("j"), F.lit(False).alias("asks"), "vec_id", "embedding", "code", "norm", "own")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("code", "binary"), ("norm", "double"), ("own", "double"))]
    seek = askers.select(block("asker", nq).alias("i"), every(nc).alias("j"), F.lit(True).alias("asks"), F.col("asker").alias("vec_id"), "embedding", *empty)
    dealt = give.unionByName(seek).repartition(nq * nc, "i", "j").sortWithinPartitions("i", "j", F.col("asks").desc(), "vec_id")
    found = dealt.mapInArrow(lambda it: _searched(it, d, seed, k + 1), "asker long, vec_id long, score double")
    best = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
    found = written(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("asker", "vec_id", "score"), folder, "found")

    who = asking.join(askers, "embedding").select(F.col("vec_id").alias("query_id"), "asker")
    mine = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = who.join(found, "asker").where("vec_id <> query_id").withColumn("rank", F.row_number().over(mine))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
