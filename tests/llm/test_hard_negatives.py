import numpy as np
import pytest
from pyspark.sql import functions as F

from structsim.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def rows(n=400, d=6):
    rng = np.random.default_rng(8)
    out = [(k, (rng.normal(size=d) * 0.2 + 0.3).astype(np.float32).tolist(), int(k % 3)) for k in range(n)]
    same = out[100][1]
    out += [(n + k, same, k % 2) for k in range(200)]
    out += [(1000, None, 1), (1050, [float("nan")] * d, 1), (1100, [None] + [1.0] * (d - 1), 1), (1150, [1.0] * d, None)]
    out += [(None, same, 0), (1200, [0.0] * d, 0), (1250, [-1.0] * d, 1), (1300, [1.0] * d, 9), (1350, [1.0] * 2, 0)]
    out += [out[7], (50, [2.0] * d, 2), (1201, [0.0] * d, 1)]
    return out


def brute(table, d=6):
    own = {}
    for i, v, label in table:
        if i is not None and label is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v):
            row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            own[i] = min(own.get(i, row), row)
    out = []
    for a, (label, q) in own.items():
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, m) for i, (m, v) in own.items() if i != a)
            for p, i, _ in [x for x in scored if x[2] == label][:5]:
                fit = [(s, j) for s, j, m in scored if m != label and 50 * -p <= 100 * -s <= 95 * -p]
                out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit[:3])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(4096, 1024), (50, 3)])
def test_hard_negatives_against_brute_force(spark, shard, block):
    frame = spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA)
    got = H.hard_negatives(frame, F.col("vec_id") % 50 == 0, shard=shard, block=block)
    want = brute(rows())
    assert sorted(tuple(r) for r in got.collect()) == want
    # a positive that scores 0 has negatives that score 0, also ones of smaller id
    assert any(r[0] == 1200 and r[4] == 0 and r[3] < r[1] for r in want)


def test_one_label_no_anchor_no_row(spark):
    frame = spark.createDataFrame([(k, [1.0, float(k)], 1, "") for k in range(60)], SCHEMA)
    assert H.hard_negatives(frame, F.col("vec_id") % 50 == 0).count() == 0
    assert H.hard_negatives(frame, F.col("vec_id") < 0).count() == 0
    assert H.hard_negatives(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, ""), (1, [1.0], 2, "")], SCHEMA)
    assert H.hard_negatives(alone, F.col("vec_id") == 0).count() == 0


def test_keys_sort_as_their_parts():
    rng = np.random.default_rng(1)
    parts = [(int(a), int(s), bool(p), int(o)) for a, s, p, o in rng.integers(-3, 4, size=(300, 4))]
    parts += [(2**62, -(2**62), True, -(2**63)), (-(2**63), 2**63 - 1, False, 2**63 - 1)]
    keys = sorted(H.pack_key(*p) for p in parts)
    assert [H.unpack_key(k) for k in keys] == sorted(((a, s, bool(p), o) for a, s, p, o in parts), key=lambda x: (x[0], -x[1], not x[2], x[3]))


def test_the_iterator_holds_open_windows_only():
    def keys():
        for i in range(3):
            yield H.pack_key(0, 1000, True, i)
        for i in range(200_000):
            yield H.pack_key(0, 950 - i // 500, False, 10 + i)

    assert [(r[1], r[2], r[3]) for r in H.mined(keys())] == [(p, n + 1, 10 + n) for n in range(3) for p in range(3)]


def test_window_ends_are_exact():
    for p in range(-300, 300):
        low, high = H.window(p)
        fit = [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p]
        assert fit == list(range(low, high + 1))
