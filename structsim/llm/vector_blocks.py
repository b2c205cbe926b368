"""Integer vectors in packed blocks, and the meeting of blocks of queries with shards of all rows.

A block is one row of a table: its ids, labels and points as bytes, and columns of the caller's. Every block of queries
meets every shard in some task, shard after shard, so a task holds one block and one shard, no pair of rows is ever a
row of a table, and what a block has learnt from one shard serves the next.

Which rows take part (``integer_vectors``): those with an id, a label, and a vector of finite components. A component x
becomes floor(scale * x). Vectors of another dimension than most (ties: the smaller one) and vectors whose inner product
with themselves does not fit 64 bits take no part; all products of the others fit, by the Cauchy-Schwarz inequality. An
id stands for one vector: of several rows with an id, the one with the smallest (label, vector) counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structsim.llm.workspace import small_batches, written

SCALE = 256
#: Rows of a shard and of a block of queries; shards that one task reads for a block, where there is work for all tasks.
SHARD, BLOCK, RUN = 4096, 1024, 16
#: Squared length from which a product of two vectors might not fit 64 bits, with room for rounding of the sum.
_LONGEST = 9.2e18
#: Squared length up to which every product is exact in double precision.
EXACT = float(1 << 53)
NOTHING = np.iinfo(np.int64).min

_PACKED = "block int, ids binary, labels binary, points binary"


def integer_vectors(vectors: DataFrame, folder: str, label: Column | None = None, scale: int = SCALE) -> tuple[DataFrame, int, int]:
    """(vec_id, label, q) of the rows that take part, stored in ``folder``; their number and their dimension."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select("vec_id", (F.lit(0) if label is None else label).cast("long").alias("label"), "embedding")
    kept = kept.where("vec_id is not null and label is not null and embedding is not null").where(~F.exists("embedding", odd))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    length = F.aggregate("q", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    kept = kept.select(F.col("vec_id").cast("long"), F.struct("label", whole.alias("q")).alias("own"))
    kept = kept.select("vec_id", "own", F.col("own.q").alias("q")).where(length < _LONGEST)
    one = written(kept.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.q"), folder, "rows")
    sizes = one.groupBy(F.size("q").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    if not sizes:
        return one, 0, 0
    return one.where(F.size("q") == sizes[0]["d"]), sizes[0]["count"], sizes[0]["d"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block, which follow one another."""
    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    yield int(key[a]), batch.slice(a, b - a)

    for block, own in groupby(pieces(), key=lambda x: x[0]):
        yield block, pa.Table.from_batches([piece for _, piece in own]).combine_chunks()


def packed(rows: DataFrame, size: int, count: int, extra: Callable[[np.ndarray], tuple[np.ndarray, list[bytes]]] | None = None,
           names: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (vec_id, label, q), dealt by hash into blocks of about ``size``, as one row a block, ids ascending.

    ``extra`` gives an order for the points of a block, and the values of the further binary columns ``names``.
    """
    small_batches(rows.sparkSession)
    blocks = max(1, -(-count // size))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "label", "q")
    dealt = dealt.repartition(min(blocks, _tasks(rows)), "block").sortWithinPartitions("block", "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in _runs(batches):
            ids, labels = (own.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            points = own.column("q").combine_chunks().flatten().to_numpy().astype(np.int64)
            points = points.reshape(len(ids), len(points) // len(ids))
            order, more = extra(points) if extra else (slice(None), [])
            values = [ids[order].tobytes(), labels[order].tobytes(), points[order].tobytes(), *more]
            columns = [pa.array([block], pa.int32()), *(pa.array([v], pa.binary()) for v in values)]
            yield pa.record_batch(columns, names=["block", "ids", "labels", "points", *names])

    return dealt.mapInArrow(pack, ", ".join([_PACKED, *(f"{n} binary" for n in names)]))


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unpacked(row: dict, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and points of a block."""
    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row["points"], np.int64).reshape(len(ids), dimension)


def meeting(blocks: DataFrame, shards: DataFrame, n_blocks: int, n_shards: int, work: Callable, schema: str,
            pairs: Column | None = None) -> DataFrame:
    """Rows that ``work(block, shards)`` yields as record batches for every block and the shards of a run, one by one.

    ``pairs`` (a condition on ``block`` and ``shard``) says which of them meet; all do without it.
    """
    spark = blocks.sparkSession
    small_batches(spark)
    runs = max(-(-n_shards // RUN), min(n_shards, -(-spark.sparkContext.defaultParallelism // n_blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = sorted({*blocks.columns, *shards.columns} - {"block"})
    fill = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("binary").alias(c) for c in columns]
    ask = blocks.select("block", every(runs).alias("run"), F.lit(-1).alias("shard"), *fill(blocks))
    give = shards.select(F.col("block").alias("shard"), *fill(shards)).select(every(n_blocks).alias("block"), "shard", *columns)
    give = give.where(pairs) if pairs is not None else give
    give = give.select("block", F.pmod("shard", F.lit(runs)).alias("run"), "shard", *columns)
    dealt = ask.unionByName(give).repartition(n_blocks * runs, "block", "run").sortWithinPartitions("block", "run", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        for _, own in groupby(rows, key=lambda r: (r["block"], r["run"])):
            first = next(own)
            if first["shard"] < 0:
                yield from work(first, own)

    return dealt.mapInArrow(run, schema)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``, as 64-bit integers."""
    top = [float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for x in (a, b)]
    if top[0] * top[1] < EXACT**2 / 4:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T  # sums wrap around on the way, if at all, and end right


class Best:
    """The k best (score, id) of each of some rows: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NOTHING)
        self.ids = np.full((rows, k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """Each row's k-th best score: what a further one must reach."""
        return self.scores[:, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes in (row, id, score) entries; no entry may come twice."""
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        k = self.k
        row = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, ~scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        first = np.searchsorted(row, np.arange(len(touched)))
        place = first[:, None] + np.arange(k)
        self.scores[touched], self.ids[touched] = scores[place], ids[place]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of all that is held."""
        row, place = np.nonzero(self.scores != NOTHING)
        return row, self.ids[row, place], self.scores[row, place]
