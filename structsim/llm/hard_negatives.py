"""Hard negatives of anchors: rows of another label that score somewhat below a positive.

Blocks of anchors meet shards of all rows twice. The first time each anchor keeps its best rows of its own label, of
which the best of all are its positives. The second time it keeps, for the window below each positive, the best rows of
other labels; what is not among the first few of a window in a run of shards is not among the first few of all, so only
these pairs are shuffled. Each pair is packed into one key of (anchor, falling score, positive before negative, id), and
``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts them. A streaming iterator then opens a window
at each positive and hands a negative to every open window that takes it. It holds the open windows of one anchor, whose
number is a parameter, never an anchor's rows. A positive goes before a negative of equal score, as a positive that
scores 0 takes negatives that score 0.

Which rows take part is said in ``vector_blocks``: those with an id, a label, and a vector of finite components and of
the usual dimension; of repeated ids one row counts. Ties in score go to the smaller id. An anchor without other rows of
its label has no positive and gives no rows, as does a positive below 0, whose window is empty. Extra columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structsim.llm.vector_blocks import BLOCK, NOTHING, SCALE, SHARD, Best, integer_vectors, meeting, packed, products, unpacked
from structsim.llm.workspace import new_folder, written

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
_ROWS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_PAIR = "anchor_id long, other_id long, score long"
_SIGN = 1 << 63


def window(positive, low: int = LOW, high: int = HIGH):
    """The least and the greatest score of a negative of a positive of this score; works on numbers and on arrays."""
    return -(-positive * low // 100), positive * high // 100


def pack_key(anchor: int, score: int, positive: bool, other: int) -> bytes:
    """A key whose order as bytes is by anchor, falling score, positives first, rising id."""
    own = (anchor + _SIGN).to_bytes(8, "big") + (_SIGN - 1 - score).to_bytes(8, "big")
    return own + (b"\0" if positive else b"\1") + (other + _SIGN).to_bytes(8, "big")


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, other = (int.from_bytes(x, "big") for x in (key[:8], key[8:16], key[17:]))
    return anchor - _SIGN, _SIGN - 1 - score, key[16] == 0, other - _SIGN


def mined(keys: Iterator[bytes], positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
          high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the result from sorted keys, in one pass; the open windows of an anchor are all that is held."""
    at, opened, windows = None, 0, []
    for key in keys:
        anchor, score, positive, other = unpack_key(key)
        if anchor != at:
            at, opened, windows = anchor, 0, []
        if positive:
            if opened < positives:
                opened += 1
                windows.append([other, score, *window(score, low, high), 0])
            continue
        for own in windows:
            if own[2] <= score <= own[3]:
                own[4] += 1
                yield anchor, own[0], own[4], other, own[1], score
        # a window closes when it is full, or when all that follow score below it
        windows = [own for own in windows if own[4] < negatives and own[2] <= score]


def _pairs(anchors: np.ndarray, best: Best, per: int = 1) -> pa.RecordBatch:
    row, ids, scores = best.entries()
    anchors = anchors[row // per]
    if per > 1 and len(row):
        # windows of one anchor may share a row
        own = np.unique(np.stack([anchors, ids, scores]), axis=1)
        anchors, ids, scores = own
    return pa.record_batch([pa.array(anchors), pa.array(ids), pa.array(scores)], names=["anchor_id", "other_id", "score"])


def _same_label(dimension: int, k: int):
    def work(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        anchors, labels, own = unpacked(block, dimension)
        best = Best(len(anchors), k)
        for shard in shards:
            ids, others, points = unpacked(shard, dimension)
            for label in np.intersect1d(labels, others):
                seek, give = np.flatnonzero(labels == label), np.flatnonzero(others == label)
                score = products(own[seek], points[give])
                row, place = np.nonzero((score >= best.least()[seek][:, None]) & (anchors[seek][:, None] != ids[give]))
                best.add(seek[row], ids[give][place], score[row, place])
        yield _pairs(anchors, best)

    return work


def _other_label(dimension: int, n: int, k: int, low: int, high: int):
    def work(block: dict, shards: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        anchors, labels, own = unpacked(block, dimension)
        positive = np.frombuffer(block["positives"], np.int64).reshape(len(anchors), n)
        # as Python's numbers: a score times 100 may not fit 64 bits; an absent positive has an empty window
        ends = [window(int(p), low, high) if p != NOTHING else (1, 0) for p in positive.ravel()]
        least, most = (np.array(e, dtype=np.int64).reshape(len(anchors), n) for e in zip(*ends, strict=True))
        best = Best(len(anchors) * n, k)
        for shard in shards:
            ids, others, points = unpacked(shard, dimension)
            score = products(own, points)
            strange = labels[:, None] != others
            for nth in range(n):
                from_here = np.maximum(least[:, nth], best.least()[nth::n])
                row, place = np.nonzero(strange & (score >= from_here[:, None]) & (score <= most[:, nth][:, None]))
                best.add(row * n + nth, ids[place], score[row, place])
        yield _pairs(anchors, best, n)

    return work


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shard: int = SHARD,
                   block: int = BLOCK) -> DataFrame:
    """For each row that ``is_anchor`` (a condition on vec_id) and each of its first ``positives`` other rows of its label,
    the first ``negatives`` rows of other labels that score ``low`` to ``high`` hundredths of the positive."""
    spark, folder = vectors.sparkSession, new_folder(vectors.sparkSession, "hard-negatives")
    rows, n, d = integer_vectors(vectors, folder, F.col("label") if label is None else label, scale)
    asking = rows.where(is_anchor)
    n_asking = asking.count()
    if not n_asking:
        return spark.createDataFrame([], _ROWS)
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-n_asking // block))
    index = written(packed(rows, shard, n), folder, "index")

    near = meeting(packed(asking, block, n_asking), index, n_blocks, n_shards, _same_label(d, positives), _PAIR)
    order = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "other_id")
    near = written(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), folder, "positives")
    scores = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    known = asking.join(scores, "vec_id").withColumn("more", F.array_repeat(F.lit(NOTHING), F.lit(positives) - F.size("scores")))
    known = known.select("vec_id", "label", F.concat("q", "scores", "more").alias("q"))

    def split(points: np.ndarray) -> tuple[slice, list[bytes]]:
        return slice(None), [np.ascontiguousarray(points[:, d:]).tobytes(), np.ascontiguousarray(points[:, :d]).tobytes()]

    asks = packed(known, block, n_asking, split, ("positives", "own")).withColumn("points", F.col("own")).drop("own")
    far = meeting(asks, index, n_blocks, n_shards, _other_label(d, positives, negatives, low, high), _PAIR)
    far = written(far, folder, "negatives")

    pairs = near.select("anchor_id", "score", F.lit(True).alias("positive"), "other_id")
    pairs = pairs.unionByName(far.select("anchor_id", "score", F.lit(False).alias("positive"), "other_id"))
    keys = pairs.rdd.map(lambda r: (pack_key(r[0], r[1], r[2], r[3]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 32)
    found = dealt.mapPartitions(lambda rows: mined((key for key, _ in rows), positives, negatives, low, high))
    return spark.createDataFrame(found, _ROWS, verifySchema=False)
