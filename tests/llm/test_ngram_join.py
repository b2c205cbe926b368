import random
import re
import time

import numpy as np
import pytest

from structsim.llm import ngram_join as J
from structsim.llm.components import connected_components
from structsim.llm.workspace import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, n=3, percent=90):
    """doc_id -> sizes and component; a row without an id is a document of its own, which may link others."""
    sets, none = {}, float("inf")
    for k, (d, text) in enumerate(rows):
        w = WORD.findall((text or "").translate(LOWER))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault((none, k) if d is None else (d, 0), []).append(own)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {d[0]: (sorted(len(s) for s in own), root(d)[0]) for d, own in sets.items() if d[0] != none}


def got(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    return {d: (sorted(n for n, _ in v), v[0][1]) for d, v in out.items() if d is not None}


def near_copies(prose, n=60):
    rng = random.Random(3)
    rows = []
    for group in range(8):
        base = prose(rng.choice([4, 12, 40, 90, 200]), group)
        for k in range(n // 8):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"w{group}x{k}"
            rows.append((100 * group + k, " ".join(words).upper() if k % 3 == 0 else "\n".join(words)))
    return rows


@pytest.mark.parametrize(("n", "percent", "cell"), [(3, 90, 512), (3, 90, 2), (5, 80, 3), (2, 60, 512)])
def test_components_equal_brute_force(table, prose, n, percent, cell):
    rows = near_copies(prose)
    assert got(J.ngram_components(table(rows), n, percent, cell)) == brute(rows, n, percent)


def test_odd_rows(table, odd_rows):
    assert got(J.ngram_components(table(odd_rows))) == brute(odd_rows)
    assert J.ngram_components(table([])).count() == 0


def test_rows_of_one_id_are_one_document(table, prose):
    a, b = " ".join(prose(50, 1)), " ".join(prose(50, 2))
    assert got(J.ngram_components(table([(5, a), (5, b), (3, a + " end"), (4, b + " end")]))) == {5: ([48, 48], 3), 3: ([49], 3), 4: ([49], 3)}


def test_exact_copies_under_shared_ids_are_one_component(table, prose):
    a, b, c = (" ".join(prose(50, k)) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (3, a), (4, b), (5, ""), (9, c), (9, c), (8, c + " end"), (8, "other words here"), (7, "other words here")]
    assert {d: v[1] for d, v in got(J.ngram_components(table([r for r in rows if r[1]]))).items()} == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7}
    kept = J.keep_one_per_group(table(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 7]


@pytest.mark.parametrize("buffer", [1, 300])
def test_small_buffers_lose_no_link(table, prose, monkeypatch, buffer):
    monkeypatch.setattr(J, "BUFFER", buffer)
    rows = near_copies(prose)
    assert got(J.ngram_components(table(rows))) == brute(rows)


def test_more_ids_than_are_broadcast(table, prose, monkeypatch):
    monkeypatch.setattr(J, "SENT", 0)
    rows = near_copies(prose)
    assert got(J.ngram_components(table(rows), cell_size=3)) == brute(rows)
    assert {r["doc_id"] for r in J.keep_one_per_group(table(rows)).collect()} == {d for d, (_, c) in brute(rows).items() if d == c}


@pytest.mark.parametrize("cell", [512, 3])
def test_rows_without_an_id_link_others(table, prose, cell):
    rows = [(None if k % 3 == 0 else d, t) for k, (d, t) in enumerate(near_copies(prose))]
    assert got(J.ngram_components(table(rows), cell_size=cell)) == brute(rows)
    words = prose(60, 9)
    near = [" ".join([*words, *extra]) for extra in ([], list("pqrst"), list("pqrstuvwxy"))]
    ends = [(1, near[0]), (None, near[1]), (2, near[2])]
    assert brute([ends[0], ends[2]])[2] != brute(ends)[2]
    found = J.ngram_components(table([*ends, (None, near[1]), (None, "of no id at all"), (None, None)]), cell_size=cell).collect()
    assert sorted(str(r["component_id"]) for r in found) == ["1", "1", "1", "1", "None", "None"]


def test_rows_without_an_id_stay_once(table, prose):
    words = prose(60, 9)
    near = [" ".join([*words, *extra]) for extra in ([], list("pqrst"), list("pqrstuvwxy"))]
    other = " ".join(prose(60, 10))
    rows = [(1, near[0]), (None, near[1]), (2, near[2]), *[(None, other)] * 3, (None, other + " end"), (None, "x y"), (None, None), (None, " ")]
    kept = J.keep_one_per_group(table(rows))
    docs = kept.collect()
    assert kept.columns == table(rows).columns
    assert [r["doc_id"] for r in docs if r["doc_id"] is not None] == [1]
    texts = sorted(r["text"] or "" for r in docs if r["doc_id"] is None)
    assert sorted(t[:20] for t in texts) == sorted(["", " ", "x y", other[:20]])


def test_one_row_per_group_stays(table, prose):
    rows = near_copies(prose)
    docs = table([*rows, rows[0], (None, "x y z")])
    kept = J.keep_one_per_group(docs)
    want = brute([*rows, rows[0]])
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("percent", [50, 70, 80, 90, 95, 100])
def test_linked_sets_share_a_part(percent):
    """Without false negatives: any linked pair of unequal sets has a common key."""
    rng = np.random.default_rng(percent)
    classes = J.size_classes(5000, percent)
    highs = np.array([c.high for c in classes])
    frequent = np.sort(rng.integers(0, 2**64, 40, dtype=np.uint64))
    keys = lambda own: {int(x) for x in J.meeting_keys(own, frequent, classes, highs, percent)}
    for _ in range(300):
        size = int(rng.integers(1, 120))
        base = np.unique(np.concatenate([rng.integers(0, 2**64, size, dtype=np.uint64), rng.permutation(frequent)[: rng.integers(0, 20)]]))
        gone, new = rng.integers(0, len(base) // 3 + 1), rng.integers(0, len(base) // 3 + 1)
        other = np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        both = len(np.intersect1d(base, other))
        if len(other) and J.linked(len(base), len(other), both, percent) and not np.array_equal(base, other):
            assert keys(base) & keys(other)


def test_frequent_shingles(table):
    rows = [(k, f"one two three four five w{k} x{k}") for k in range(400)]
    scanned = table(rows).select("doc_id", "text").mapInArrow(lambda it: J._set_batches(it, 3), J.SETS)
    found = J.frequent_shingles(scanned.where("shingle is not null").select("shingle", "times"), seen=400)
    assert len(found) == 3
    assert got(J.ngram_components(table(rows), 3, 40)) == brute(rows, 3, 40)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), new_folder(spark, "t"), "c")
    assert {r["node"]: r["root"] for r in found.collect()} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_near_copies_below_the_threshold_are_searched_in_bulk():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(400):
        own = base.copy()
        own[rng.choice(300, 24, replace=False)] = rng.integers(0, 2**63, 24, dtype=np.uint64)
        sets.append(np.unique(own))
    union = J.Union(len(sets))
    begin = time.process_time()
    J.connect(sets, 90, range(len(sets)), union)
    assert time.process_time() - begin < 1.5
    assert [union.root(k) for k in range(len(sets))] == list(range(len(sets)))


def test_small_sets_do_not_all_meet():
    """Sets of 13 to 81 shingles that share nothing have no common key at a similarity of 0.8, where all parts say little."""
    rng = np.random.default_rng(3)
    classes = J.size_classes(5000, 80)
    highs = np.array([c.high for c in classes])
    none = np.zeros(0, np.uint64)
    sets = [np.unique(rng.integers(0, 2**64, int(rng.integers(5, 82)), dtype=np.uint64)) for _ in range(3000)]
    keys = np.concatenate([J.meeting_keys(own, none, classes, highs, 80) for own in sets])
    assert len(np.unique(keys)) == len(keys) < 0.35 * sum(map(len, sets)) + len(sets)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_small_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent + 1)
    classes = J.size_classes(5000, percent)
    highs = np.array([c.high for c in classes])
    frequent = np.sort(rng.integers(0, 2**64, 60, dtype=np.uint64))
    many = 0
    for size in [*range(1, 180)] * 3:
        base = np.unique(np.concatenate([rng.integers(0, 2**64, size, dtype=np.uint64), rng.permutation(frequent)[: rng.integers(0, 9)]]))
        for gone in range(min(len(base), 1 + size * (100 - percent) // 100)):
            other = rng.permutation(base)[gone:]
            new = rng.integers(0, 2**64, int(rng.integers(0, 1 + size // 8)), dtype=np.uint64)
            other = np.unique(np.concatenate([other, new]))
            both = len(np.intersect1d(base, other))
            if not np.array_equal(base, other) and J.linked(len(base), len(other), both, percent):
                many += 1
                assert np.isin(J.meeting_keys(base, frequent, classes, highs, percent), J.meeting_keys(other, frequent, classes, highs, percent)).any()
    assert many > 300


def test_cells_of_chains_are_compared_by_key(table, monkeypatch):
    """Texts of eight words, each five times, hang together by words they share; only near copies of them are linked."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        words = [f"w{w}" for w in rng.integers(0, 90, 8)] if k % 4 else [f"w{w}" for w in rng.integers(0, 90, 8)][:7] + ["end"]
        rows.append((len(rows), " ".join(w for w in words for _ in range(5))))
        if k % 5 == 0:
            rows.append((len(rows), rows[-1][1] + " more"))
    sent = []
    real = J.written
    monkeypatch.setattr(J, "written", lambda df, folder, name: sent.append((name, real(df, folder, name))) or sent[-1][1])
    assert got(J.ngram_components(table(rows), 5, 80, 8)) == brute(rows, 5, 80)
    ways = [f for name, f in sent if name == "ways"]
    assert ways and ways[0].where("keys").count()
