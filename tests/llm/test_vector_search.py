import numpy as np
import pytest
from pyspark.sql import functions as F

from structsim.llm import vector_search as V

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = np.array(v, np.float32).astype(float)
    out = []
    for q in own:
        if q % 20 == 0:
            near = sorted(((-float(own[q] @ v), i) for i, v in own.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


def rows(n=600):
    rng = np.random.default_rng(3)
    out = [(k, (rng.normal(size=16) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for k in range(n)]
    same = out[0][1]
    out += [(n + k, same) for k in range(120)]
    out += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [1.0] * 3), (None, same), out[5], (2100, [float("inf")] + [1.0] * 15)]
    return out


@pytest.mark.parametrize("blocks", [(4096, 16_384), (7, 100)])
def test_nearest_against_brute_force(spark, blocks):
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows()], SCHEMA)
    got = V.nearest(frame, F.col("vec_id") % 20 == 0, query_block=blocks[0], candidate_block=blocks[1]).collect()
    want = brute(rows(), 20)
    assert len(got) == len(want)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hits = [(q, i) for q, _, i, _ in want if (q, i) in found]
    assert len(hits) >= 0.97 * len(want)
    assert all(abs(found[q, i] - s) < 1e-9 for q, _, i, s in want if (q, i) in found)
    ranks = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for own in ranks.values():
        own.sort()
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0, 1), (1, [1.0, 0.0], 0, 1), (2, [1.0, 0.0], 0, 1)], SCHEMA)
    got = V.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert V.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_an_id_stands_for_one_vector(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 1.0]), (3, [3.0, 1.0]), (3, [9.0, 9.0]), (4, [2.0, 5.0]), (4, [2.0, 5.0])]
    got = V.nearest(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 4, 6.0), (20, 2, 3, 2.5)]


def test_estimates_stay_within_the_bound():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=64)
    turn = V.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-9)
    codes, norm, own = V.encode(x, turn)
    signs = 2.0 * np.unpackbits(codes, axis=1) - 1
    estimate = signs @ (turn @ q) * norm / own / 8
    bound = norm * np.sqrt(1 - own**2) / own * V.ERROR_WIDTH / np.sqrt(63) * np.linalg.norm(q)
    assert np.mean(np.abs(estimate - x @ q) <= bound) > 0.99
    assert abs(np.mean(estimate - x @ q)) < 0.2
