import re
from itertools import permutations

import numpy as np
import pytest

from structsim.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, row string, part int"
LABELS = "doc_id long, quality int, toxic int, part string"


def documents():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)] + ["Ab", "CD", "x#y", "50%"]
    out = []
    for k in range(260):
        n = int(rng.choice([0, 3, 150, 199, 200, 201, 500]))
        pool = words if k % 3 else words[:60]
        chosen = rng.choice(pool[:400] if k % 4 else pool, size=n)
        sep = "  \t\n\x0b\r"[k % 6]
        out.append((k * 3, sep.join(chosen) + (" " if k % 2 else ""), ["en", "de", "", None][k % 4]))
    out += [(5000 + k, out[8][1], "en") for k in range(50)]
    out += [(10_000, None, "fr"), (10_001, None, "fr"), (10_002, "", None), (None, out[8][1], "en"), (None, "a", "de")]
    out += [(24, out[8][1], "en"), (24, out[8][1], "en"), (6, "Z" * 40 + " é漢", "de"), (20_000, "word " * 30_000, "de")]
    return out


def labels():
    out = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 700, 2)]
    return [*out, (5003, 1, None), (5003, None, 1), (None, 1, 1), (24, 0, 1), (24, 1, 0), (77_777, 1, 1)]


def brute(docs, marks):
    good = {i for i, q, _ in marks if q == 1 and i is not None}
    toxic = {i for i, _, t in marks if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    facts = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        fails += ("D" if re.search("[#$%&*|]", text) else "") + ("E" if i is not None and i > first[text] else "")
        facts.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                alone = sum(x[1] == f for x in own)
                redundant = sum(f in x[1] for x in own) - len(gone)
                lost = (sum(x[2] for x in gone), sum(x[3] for x in gone))
                rows.append(("".join(order), step + 1, len(left), len(gone), redundant, alone, *lost, f))
        out += [(part, *r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("size", [65_536, 7])
def test_audit_against_brute_force(spark, size):
    frame = spark.createDataFrame([(*d, "s", "x", 1) for d in documents()], DOCS)
    marks = spark.createDataFrame([(*m, "y") for m in labels()], LABELS)
    got = A.audit_filters(frame, marks, size)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(documents(), labels())


def test_empty_tables(spark):
    none, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert A.audit_filters(none, marks).count() == 0
    one = spark.createDataFrame([(1, "a b", None, "s", "x", 1)], DOCS)
    assert sorted(tuple(r) for r in A.audit_filters(one, marks).collect()) == brute([(1, "a b", None)], [])


def test_ranges_are_bounded_and_sorted(spark, tmp_path):
    frame = spark.createDataFrame([(3, "same", "en", "s", "x", 1)] * 90 + [(k, f"t{k}", "en", "s", "x", 1) for k in range(40)], DOCS)
    failed = A.failures(frame, spark.createDataFrame([], LABELS), f"file://{tmp_path}")
    rows = A.posting_lists(failed, 16).collect()
    assert max(r["n"] for r in rows) <= 16 and sum(r["n"] for r in rows) == 130
    assert all(list(r["ids"]) == sorted(r["ids"]) and list(r["A"]) == sorted(set(r["A"])) for r in rows)


def test_merges_of_sorted_lists():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lists = [np.unique(rng.integers(0, rng.integers(1, 3000), rng.integers(0, 900))).astype(np.int32) for _ in range(4)]
        step = int(rng.choice([1, 3, 64, 4096]))
        sets = [set(x.tolist()) for x in lists]
        assert A.union(lists, step).tolist() == sorted(set().union(*sets))
        assert A.difference(lists[0], lists[1], step).tolist() == sorted(sets[0] - sets[1])
        assert A.shared(lists[0], lists[1], step) == len(sets[0] & sets[1])
    assert A.union([]).tolist() == []
