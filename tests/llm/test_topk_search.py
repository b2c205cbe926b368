import numpy as np
import pytest
from pyspark.sql import functions as F

from structsim.llm import topk_search as T
from structsim.llm import vector_blocks as B

SCHEMA = "vec_id long, embedding array<float>, score int, query_id string"


def rows(n=700, d=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, d))
    out = [(k, (centres[k % 6] + 0.3 * rng.normal(size=d)).astype(np.float32).tolist()) for k in range(n)]
    same = out[50][1]
    out += [(n + k, same) for k in range(150)]
    out += [(2000, None), (2050, [float("nan")] * d), (2100, [None] + [1.0] * (d - 1)), (2150, [1.0] * 3), (None, same)]
    out += [(2200, [0.0] * d), (2250, [float("inf")] + [1.0] * (d - 1)), (2300, [1e30] * d), out[5], (50, [9.0] * d)]
    return out


def brute(table, k, d=8, every=50):
    own = {}
    for i, v in table:
        if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            if sum(x * x for x in q) < B._LONGEST:
                own[i] = min(own.get(i, q), q)
    out = []
    for i, q in own.items():
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in own.items() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "leaf"), [(4096, 1024, 128), (60, 4, 4), (200, 1000, 16)])
def test_top_k_against_brute_force(spark, shard, block, leaf):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows()], SCHEMA)
    got = T.top_k(frame, F.col("vec_id") % 50 == 0, shard=shard, block=block, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows(), 5)


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (1, [1.0, 0.0], 0, ""), (2, [1.0, 0.0], 0, "")], SCHEMA)
    got = T.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 256 * 256), (0, 2, 2, 256 * 256)]
    assert T.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert T.top_k(frame, F.col("vec_id") < 0).count() == 0
    assert T.top_k(frame.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    bare = spark.createDataFrame([(0, [], 0, ""), (1, [], 0, "")], SCHEMA)
    assert [tuple(r) for r in T.top_k(bare, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(40, 12)) * 500).repeat(50, axis=0) + rng.normal(size=(2000, 12)) * 20
    points = np.floor(points).astype(np.int64)
    order, centres, radii = T.ball_tree(points, 32)
    assert sorted(order) == list(range(2000))
    depth, queries = T.levels(2000, 32), points[rng.integers(0, 2000, 30)]
    bound = T.leaf_bounds(queries, centres, radii, depth)
    score = B.products(queries, points[order])
    at = T.cuts(2000, depth)
    for leaf in range(1 << depth):
        assert (score[:, at[leaf] : at[leaf + 1]].max(axis=1) <= bound[:, leaf]).all()
    best = B.Best(30, 5)
    none = np.full(30, B.NOTHING)
    worked = T.search_shard(queries, np.full(30, -1), points[order], order, centres, radii, best, none, 32)
    assert (best.scores == -np.sort(-score, axis=1)[:, :5]).all()
    assert worked < 0.3 * score.size
    fresh = B.Best(30, 5)
    shared = T.search_shard(queries, np.full(30, -1), points[order], order, centres, radii, fresh, best.least(), 32)
    assert shared <= worked and (fresh.scores == best.scores).all()


def test_products_of_long_vectors_are_exact():
    a = np.array([[2**31 - 5, -(2**30), 7], [3, 2, 1]])
    b = np.array([[2**30 + 3, 2**31 - 1, 11]])
    assert B.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, b[0], strict=True))] for r in a]
