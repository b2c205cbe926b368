"""Golden cases of the operators on hand-made rows, and properties against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from structsim.functions import names as N
from structsim.operators import bags as B
from structsim.operators import baseline as L
from structsim.operators import evaluate as E
from structsim.operators import explain as X
from structsim.operators import features as Y
from structsim.operators import focus as C
from structsim.operators import groups as G
from structsim.operators import simjoin as J
from structsim.options import Options, preset, scoped

FRAGMENT = "fragment_id long, path string, language string, family string, domain string, kind string, name string, start_line int, end_line int, start_byte int, end_byte int"


def make(spark, items):
    """(fragments, bags) from (fragment_id, bag, changes of the other columns)."""
    base = {"path": "a.x", "language": "go", "family": "go", "domain": "code", "kind": "function", "name": "f", "start_line": 1, "end_line": 2, "start_byte": 0, "end_byte": 1}
    rows = [(i, *({**base, "path": f"d{i}/f.x", **more}).values()) for i, _, more in items]
    bags = spark.createDataFrame([(i, f, c) for i, bag, _ in items for f, c in bag.items()], "fragment_id long, feature string, cnt int")
    return spark.createDataFrame(rows, FRAGMENT).join(B.fingerprints(bags), "fragment_id"), bags


def score(a, b):
    keys = {*a, *b}
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_fingerprint_golden(spark):
    row = spark.range(1).select(B.fingerprint_of_map(F.create_map(F.lit("node:return"), F.lit(1), F.lit("semantic:trim"), F.lit(2))).alias("f"), N.pair_id(F.lit("b" * 16), F.lit("a" * 16)).alias("p")).first()
    assert row["f"] == "15b9cd8711e89676" and row["p"] == "a" * 16 + ":" + "b" * 16


def test_jaccard_golden(spark):
    items = [(1, {"oak": 4, "elm": 1}, {}), (2, {"oak": 3, "ash": 1}, {})]
    row = J.similar_pairs(*make(spark, items), 0.5).first()
    assert (row["intersection"], row["union_size"], row["score"]) == (3, 6, 0.5)
    assert J.similar_pairs(*make(spark, items), 0.51).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9, 1.0])
def test_prefix_join_equals_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    items = []
    for i in range(60):
        bag = {f"f{int(rng.paretovariate(0.7)) % 25}": rng.randint(1, 4) for _ in range(rng.randint(1, 9))} if i % 5 or not items else dict(items[-1][1])
        items.append((i, bag, {"family": rng.choice("xyz"), "language": rng.choice("pqr")}))
    fragments, bags = make(spark, items)
    for mode, allowed in (("all", lambda a, b: True), ("same_family", lambda a, b: a["family"] == b["family"]), ("cross_family", lambda a, b: a["family"] != b["family"]), ("language_pairs", lambda a, b: {a["language"], b["language"]} in ({"p", "q"}, {"r"}))):
        pairs = (("q", "p"), ("r", "r")) if mode == "language_pairs" else ()
        want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and allowed(a[2], b[2]) and score(a[1], b[1]) >= threshold}
        got = J.similar_pairs(fragments, bags, threshold, mode, pairs)
        assert {(r["left_id"], r["right_id"]) for r in got.collect()} == want
        size = lambda b: sum(b.values())
        near = sum(1 for a in items for b in items if a[0] < b[0] and allowed(a[2], b[2]) and min(size(a[1]), size(b[1])) / max(size(a[1]), size(b[1])) >= threshold)
        assert J.candidate_pairs(fragments, threshold, mode, pairs).first()[0] == near


@pytest.mark.parametrize("cell", [8, 256])
def test_near_copies_are_sent_once_a_cell(spark, monkeypatch, cell):
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "BUNDLE", 5)
    rng = random.Random(7)
    left_out = [set(rng.sample(range(40), 3)) for _ in range(30)]
    items = [(i, {f"c{k}": 1 + (k == i) for k in range(40) if k not in left_out[i]}, {}) for i in range(30)]
    fragments, bags = make(spark, items)
    profs = J.profiles(fragments)
    packed = J.packed_bags(profs, J.ranked_bags(bags), 0.8)
    met = J.met_profiles(packed, 0.8)
    sent = J.in_cells(met).selectExpr("cell", "explode(array(l_id, r_id)) id").distinct().count()
    assert met.count() > 200 and sent <= 30 * (1 if cell == 256 else 2 * 4)
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and score(a[1], b[1]) >= 0.8}
    assert {(r["left_id"], r["right_id"]) for r in J.similar_pairs(fragments, bags, 0.8).collect()} == want


def test_words_are_counted_row_by_row(spark, tmp_path):
    from structsim.sources import adapters as A

    texts = [(1, "Oak elm\n oak"), (2, None), (3, " \t"), (4, "ash"), (4, "ash oak"), (5, ""), (6, "\u0130x ß oak=1\r\nOAK=1"), (None, "elm")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    fragments, bags = A.document_bags(spark, str(tmp_path))
    want = B.word_bags(A.document_files(spark, str(tmp_path))).where("fragment_id is not null")
    assert sorted(map(tuple, bags.collect())) == sorted(map(tuple, want.collect()))
    prints = {r["fragment_id"]: tuple(r) for r in B.fingerprints(want).collect()}
    got = fragments.select("fragment_id", "feature_count", "n_features", "fingerprint").collect()
    assert sorted(r["fragment_id"] for r in got) == [1, 4, 4, 6] and all(prints[r["fragment_id"]] == tuple(r) for r in got)


def test_groups_count_without_listing(spark):
    items = [(i, {"a": 3, "b": 1}, {}) for i in range(3)] + [(9, {"a": 3, "b": 2}, {})]
    fragments, bags = make(spark, items)
    counted = {r["group_id"]: r["location_pairs"] for r in G.group_counts(J.similar_profiles(fragments, bags, 0.7), J.profiles(fragments)).collect()}
    listed = {r["group_id"]: r["location_pairs"] for r in G.match_groups(J.similar_pairs(fragments, bags, 0.7)).collect()}
    assert counted == listed and sorted(counted.values()) == [3, 3]


def test_overlapping_blocks_are_no_pair(spark):
    items = [(k, {"a": 2}, {"path": "one", "kind": "block", "start_byte": s, "end_byte": e}) for k, (s, e) in enumerate([(10, 40), (30, 60), (70, 100)])]
    fragments, bags = make(spark, items)
    assert J.similar_pairs(fragments, bags, 0.9).count() == 2
    assert J.candidate_pairs(fragments, 0.9).first()[0] == 2


def test_domains_and_focus_and_limit(spark):
    fragments, bags = make(spark, [(1, {"a": 1}, {}), (2, {"a": 1}, {"domain": "sql-query"})])
    assert J.candidate_pairs(fragments, 0.5).first()[0] == 0
    fragments, bags = make(spark, [(k, {"a": 1}, {}) for k in (1, 2, 3)])
    focused = fragments.withColumn("focused", F.col("fragment_id") < 3)
    assert J.candidate_pairs(focused, 0.5, focused_only=True).first()[0] == 3 == J.similar_pairs(focused, bags, 0.5, focused_only=True).count()
    with pytest.raises(J.TooManyPairs):
        J.check_pair_limit(fragments, 0.5, 2)
    assert J.check_pair_limit(fragments, 0.5, 0) == 3


def test_evidence_golden(spark):
    bags = spark.createDataFrame([(1, "oak", 6), (1, "elm", 7), (1, "fir", 2), (2, "oak", 9), (2, "ash", 8), (2, "yew", 2)], "fragment_id long, feature string, cnt int")
    pairs = spark.createDataFrame([("p", 1, 2)], "pair_id string, left_id long, right_id long")
    row = X.structural_evidence(pairs, bags, 1).first()
    assert (row["intersection"], row["union_size"], row["left_total"], row["right_total"]) == (6, 28, 9, 13)
    assert (row["shared"], row["left_only"], row["right_only"]) == (["oak=6"], ["elm=7"], ["ash=8"])


def test_shape_golden(spark):
    bags = spark.createDataFrame([(1, "node:expression:call", 3), (2, "node:expression:call", 4), (1, "node:flow:if", 2), (2, "node:flow:if", 1), (1, "node:flow:return", 1), (2, "node:flow:return", 1)], "fragment_id long, feature string, cnt int")
    pairs = spark.createDataFrame([("p", 1, 2), ("q", 8, 9)], "pair_id string, left_id long, right_id long")
    got = {r["pair_id"]: r["shape"] for r in X.shape_summary(pairs, bags).collect()}
    assert got == {"p": ["3 calls", "1 conditional branch", "1 return"], "q": []}


def priority(spark, names, rules=()):
    items = [(k, {"a": 1}, {"path": f"d{k % 2}/auth/f{k}.x", "name": n}) for k, n in enumerate(names)]
    fragments, bags = make(spark, items)
    pairs = J.similar_pairs(fragments, bags, 0.9)
    row = G.review_priority(G.match_groups(pairs), G.place_flags(G.path_pairs(pairs, fragments), rules), rules).first()
    profs = J.profiles(fragments)
    similar = J.similar_profiles(fragments, bags, 0.9)
    counted = G.review_priority(G.group_counts(similar, profs), G.profile_flags(similar, J.members(fragments, profs, "all"), rules), rules).first()
    assert (counted["priority"], counted["signals"]) == (row["priority"], row["signals"])
    return row["priority"], row["signals"]


def test_review_priority(spark):
    assert priority(spark, ["load", "load", "load"]) == (10, ["same-name-cross-directory", "cross-directory", "same-name-cross-file", "cross-file", "repeated-location-pairs"])
    assert priority(spark, ["main", "main"]) == (3, ["cross-directory", "cross-file"])
    assert priority(spark, ["load"] * 3, [("**/auth/**", 25)])[0] == 35


def test_literals_golden(spark):
    fragments, bags = make(spark, [(1, {"a": 1}, {}), (2, {"a": 1}, {})])
    lits = spark.createDataFrame([(1, ["10", "20", "30"]), (2, ["10", "21"])], "fragment_id long, literal_digests array<string>")
    row = G.literal_evidence(J.similar_pairs(fragments, bags, 0.9), lits).first()
    assert (row["compared_pairs"], row["pairs_with_differences"], row["max_differing"], row["count_mismatch_pairs"]) == (1, 1, 2, 1)


def test_diff_hunks(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,0 +5,3 @@\n+++ b/fake\n--- q\n@@ -9,2 +0,0 @@\n-z\n@@ -20 +30 @@\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,2 +0,0 @@\n"
    got = C.parse_diff_hunks(spark.createDataFrame([("s", text)], "source string, text string")).collect()
    assert sorted((r["path"], r["start_line"], r["end_line"]) for r in got) == [("x", 1, 2), ("x", 5, 7), ("x", 30, 30)]


def test_name_status_and_index(spark):
    frame = lambda t: spark.createDataFrame([("s", t)], "source string, text string")
    got = C.parse_name_status(frame("M\0a\0R100\0old\0new\0D\0gone\0")).collect()
    assert sorted((r["path"], r["deleted"]) for r in got) == [("a", False), ("gone", True), ("new", False)]
    oid = "0123456789abcdef0123456789abcdef01234567"
    assert [tuple(r) for r in C.parse_index(frame(f"100644 {oid} 0\ta b\0")).collect()] == [("100644", oid, "a b")]
    for bad in ("M\0", "M\0../x\0"):
        with pytest.raises(C.MalformedText):
            C.parse_name_status(frame(bad))
    for bad in (f"100644 {oid} 2\ta\0", f"100644 {oid[:9]} 0\ta\0", f"100644 {oid} 0\t/a\0", "x\0"):
        with pytest.raises(C.MalformedText):
            C.parse_index(frame(bad))


def test_focus_intervals(spark):
    fragments, _ = make(spark, [(1, {"a": 1}, {"path": "p", "start_line": 12, "end_line": 18}), (2, {"a": 1}, {"path": "p", "start_line": 13, "end_line": 18}), (3, {"a": 1}, {"path": "q"})])
    spans = spark.createDataFrame([("p", 10, 12), ("p", 5, 0), ("p", 0, 99)], "path string, start_line int, end_line int")
    paths = spark.createDataFrame([("q",)], "path string")
    assert {r["fragment_id"]: r["focused"] for r in C.mark_focused(fragments, paths, spans).collect()} == {1: True, 2: False, 3: True}


def test_resolve_focus(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    whole, lines, state = C.resolve_focus(t([("a",), ("b",), ("c",)], "path string"), t([("a", False), ("b", True), ("x", False)], "path string, whole_file boolean"), t([("a", 1, 2), ("a", 3, 4)], "path string, start_line int, end_line int"), t([("c",)], "path string"))
    assert sorted(r["path"] for r in whole.collect()) == ["b", "c"]
    assert [tuple(r) for r in lines.collect()] == [("a", 1, 4)]
    assert tuple(state.first()) == (3, 1, "git-and-explicit")


def entries(spark, *rows):
    return spark.createDataFrame([(i, 0.9, lp, lp + ":1", rp, rp + ":1", c, n) for i, lp, rp, c, n in rows], L.ENTRY)


def test_baseline_changes(spark, tmp_path):
    old = entries(spark, ("x", "a", "b", "intentional", "n"), ("gone", "a", "b", "", ""))
    now = entries(spark, ("x", "a", "b", "", ""), ("x", "a", "c", "", ""), ("y", "a", "b", "", ""))
    got, new, known = L.added(old, now, "path", "x", note="seen")
    assert (new, known) == (1, 1) and sorted((r["right_path"], r["classification"], r["note"]) for r in got.where("id = 'x'").collect()) == [("b", "intentional", "seen"), ("c", "", "seen")]
    assert L.removed(old, "gone")[1] == 1 and L.edited(old, "x", note="z")[0].where("note = 'z'").count() == 1
    for bad in (lambda: L.removed(old, "q"), lambda: L.added(old, now, "path", "q"), lambda: L.edited(old, "x", classification="bad"), lambda: L.edited(old, "x")):
        with pytest.raises(L.BaselineError):
            bad()
    meta = {"schema_version": 4, "normalization_version": 12, "profile_digest": "d", "threshold": 0.7}
    path = f"file://{tmp_path}/b"
    L.write_baseline(old, path, meta, "content")
    assert sorted(r["id"] for r in L.load_baseline(spark, path, meta, "content").collect()) == ["gone", "x"]
    with pytest.raises(L.BaselineError):
        L.load_baseline(spark, path, {**meta, "threshold": 0.8}, "content")


def test_path_scope_suppresses_only_its_paths(spark):
    pairs = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "a", "c")], "group_id string, left_path string, right_path string")
    rest, gone = L.suppress(pairs, entries(spark, ("g", "b", "a", "", "")), "path")
    assert tuple(gone.first()) == (2, 1) and rest.count() == 1
    rest, gone = L.suppress(pairs, entries(spark, ("g", "q", "r", "", "")), "content")
    assert tuple(gone.first()) == (3, 1) and rest.count() == 0


def test_receipts(spark):
    groups = spark.createDataFrame([("a" * 16 + ":" + "b" * 16,)], "group_id string")
    proof = dict.fromkeys(L.RECEIPT_FIELDS, "v")
    mine = L.make_receipt(groups, proof)
    assert L.receipt_drift(mine, L.make_receipt(groups, proof)).first()[0] is None
    assert L.receipt_drift(mine, L.make_receipt(groups, {**proof, "head_commit": "w"})).first()[0] == "head_commit"
    with pytest.raises(L.BaselineError):
        L.make_receipt(groups.limit(0), proof)


def test_explain_and_findings_of_a_path(spark):
    groups = spark.createDataFrame([("g1", 0.9), ("g2", 0.8)], "group_id string, score double")
    assert X.explain(groups, "g2").first()["score"] == 0.8
    with pytest.raises(LookupError):
        X.explain(groups, "g3")
    places = spark.createDataFrame([("g1", "p", "p:1"), ("g1", "q", "q:1"), ("g1", "p", "p:9"), ("g2", "r", "r:1")], "group_id string, path string, location_key string")
    said = spark.createDataFrame([("p", "w1"), (None, "w2"), ("q", "w3")], "path string, message string")
    got = [(r["group_id"], r["location_key"], r["related"], r["message"]) for r in X.findings_for_path(places, "p", said).collect()]
    assert sorted(got, key=str) == sorted([("g1", "p:1", ["p:9", "q:1"], None), ("g1", "p:9", ["p:1", "q:1"], None), (None, "p", [], "w1"), (None, None, [], "w2")], key=str)


def test_orders_and_refusals(spark):
    frags = spark.createDataFrame([("b", 1, 2, "go", "f"), ("a", 10, 11, "go", "f"), ("a", 9, 9, "go", "f")], "path string, start_line int, end_line int, language string, name string")
    assert [(r["path"], r["start_line"]) for r in frags.orderBy(*G.fragment_order()).collect()] == [("a", 9), ("a", 10), ("b", 1)]
    said = spark.createDataFrame([("b", "x"), ("a", "y"), ("a", "x")], "path string, message string")
    assert [tuple(r) for r in said.orderBy(*G.warning_order()).collect()] == [("a", "x"), ("a", "y"), ("b", "x")]
    L.refuse_truncated(False)
    with pytest.raises(L.BaselineError):
        L.refuse_truncated(True)
    kinds = spark.createDataFrame([("parse",), ("",), (None,), ("size",)], "kind string")
    assert {r["kind"]: r["n"] for r in L.warnings_by_kind(kinds, ["size"]).collect()} == {"parse": 1, "other": 2}


def test_resolved_cases(spark):
    frags = spark.createDataFrame([(1, "a", "f", 3), (2, "a", "g", 9), (3, "b", "f", 1), (4, "b", "f", 7)], "fragment_id long, path string, name string, start_line int")
    side = "struct<path:string,name:string,start_line:int>"
    cases = lambda *rows: spark.createDataFrame(list(rows), f"id string, left {side}, right {side}")
    got = E.resolve_cases(cases(("c", ("a", "g", None), ("b", None, 7)), ("d", ("a", "f", 3), ("b", "f", 1))), frags).collect()
    assert {r["id"]: (r["left_id"], r["right_id"]) for r in got} == {"c": (2, 4), "d": (1, 3)}
    for bad in (("c", ("a", None, None), ("b", None, 7)), ("c", ("z", "f", None), ("b", None, 7))):
        with pytest.raises(LookupError):
            E.resolve_cases(cases(bad), frags)


def test_focus_totals(spark):
    asked = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d.q", False), ("a", False)], "path string, deleted boolean")
    here = spark.createDataFrame([("a",)], "path string")
    out = spark.createDataFrame([("c", "skipped_resource", "resource_limit")], "path string, status string, reason string")
    evidence = C.focus_evidence(asked, here, out, ~F.col("path").endswith(".q"))
    assert C.focus_totals(evidence).first().asDict() == {"requested": 4, "required": 2, "covered": 1}


def test_literal_digests_golden(spark):
    rows = spark.createDataFrame([(1, "a 7 b 42"), (2, None)], "i long, t string")
    got = {r["fragment_id"]: r["literal_digests"] for r in Y.literal_digests(rows, "i", "t", "[0-9]+").collect()}
    assert got == {1: [hashlib.sha256(b"number\0" + x).hexdigest() for x in (b"7", b"42")], 2: []}


def test_ordered_features_golden(spark):
    rows = [(1, 0, 0, "flow:if"), (1, 0, 1, None), (1, 0, 2, "expression:call"), (2, 0, 0, None), (3, 0, 0, "x"), (3, 1, 0, "x"), (3, 1, 1, ""), (3, 1, 2, "y")]
    got = Y.ordered_statements(spark.createDataFrame(rows, "fragment_id long, container long, pos int, shape string")).collect()
    assert sorted((r["fragment_id"], r["feature"], r["cnt"]) for r in got) == [
        (1, "ordered:statement:first:flow:if", 1), (1, "ordered:statement:last:expression:call", 1), (3, "ordered:statement:first:x", 1), (3, "ordered:statement:last:y", 1), (3, "ordered:statement:only:x", 1),
    ]
    calls = [(1, 0, "b", "linear"), (1, 1, "a", "branch"), (2, 0, "a", "linear"), *((3, k, f"c{k:02}", "linear") for k in range(9)), *((4, k, "ab"[k % 2], "linear") for k in range(10))]
    got = Y.call_slots(spark.createDataFrame(calls, "fragment_id long, pos int, callee string, context string")).collect()
    assert sorted((r["fragment_id"], r["feature"], r["cnt"]) for r in got) == [
        (1, "ordered:call:branch:callee-slot-0", 1), (1, "ordered:call:linear:callee-slot-1", 1), (4, "ordered:call:linear:callee-slot-0", 4), (4, "ordered:call:linear:callee-slot-1", 4),
    ]


@pytest.mark.parametrize("fan", [1, 3, 4096])
def test_index_digest(spark, monkeypatch, fan):
    monkeypatch.setattr(L, "DIGEST_FAN", fan)
    rows = [("100644", f"{k:040x}", f"p{k}") for k in range(60)]
    digest = lambda r: L.index_digest(spark.createDataFrame(r, "mode string, oid string, path string")).first()["index_digest"]
    whole = digest(rows)
    assert len(whole) == 64 and digest(rows[::-1]) == whole != digest([*rows[:-1], ("100755", *rows[-1][1:])]) and digest(rows[:0])
    if fan == 4096:
        parts = sorted(hashlib.sha256("".join(f"{x}\0" for x in r).encode()).hexdigest() for r in rows)
        assert whole == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_migrate_keeps_entries(spark):
    entries = spark.createDataFrame([("a" * 16 + ":" + "b" * 16, 0.9, "p", "k", "q", "l", "other", "why")], L.ENTRY)
    old = {"schema_version": 1, "normalization_version": 2, "profile_digest": "x", "threshold": 0.7}
    kept, meta = L.migrated(entries, old, {"mode": "all"}, 0.8, "content")
    assert kept.collect() == entries.collect() and meta == {**old, "profile_digest": L.profile_digest({"mode": "all"}), "threshold": 0.8}


def test_evaluation_and_manifest(spark, tmp_path):
    rows = [("b", "accepted-positive", 0.9, 0.8, 1.0, 1), ("a", "false-positive", 0.9, 0.0, 0.5, 2)]
    res = spark.createDataFrame(rows, "id string, classification string, score double, min_score double, max_score double, rank int").withColumn("reference_score", F.lit(None).cast("double")).withColumn("reference_rank", F.lit(None).cast("int"))
    got = {r["id"]: (r["actual_rank"], r["score_violation"], r["rank_violation"], r["score_movement"]) for r in E.ranked(res).collect()}
    assert got == {"a": (1, True, True, None), "b": (2, False, True, None)}
    assert E.precision_at(res).first()["precision"] == 0.0 and E.metrics(res).first()["actionability"] == 0.5
    case = '{"id":"%s","classification":"false-positive","threshold":0.5,"min_score":0,"max_score":1,"rank":1,"left":{"path":"l"},"right":{"path":"%s"}}'
    good = tmp_path / "m.json"
    good.write_text('{"cases":[' + case % ("a", "r") + "]}")
    assert E.read_manifest(spark, f"file://{good}").count() == 1
    for bad in (case % ("a", "/r"), case % ("a", "r") + "," + case % ("a", "r")):
        good.write_text('{"cases":[' + bad + "]}")
        with pytest.raises(ValueError):
            E.read_manifest(spark, f"file://{good}")


def test_options():
    assert (preset("review").mode, preset("review").domains, preset("sql").ranking, preset("explore").require_coverage) == ("same_family", ("code",), "review", False)
    assert preset("review").max_groups == 250 and scoped(Options(), {"s": {"roots": ("a",)}}, "s").roots == ("a",)
    for bad in ({"threshold": float("nan")}, {"threshold": 0}, {"min_tokens": 0}, {"max_pairs": -1}, {"focused_only": True}, {"mode": "x"}, {"mode": "language_pairs"}, {"priority_paths": (("a", 101),)}, {"statement_blocks": True, "block_statements": 1}):
        with pytest.raises(ValueError):
            Options(**bad)


@pytest.mark.parametrize(("pattern", "path", "hit"), [("**/auth/**", "a/auth/x", True), ("**/auth/**", "auth", True), ("*.py", "a/b.py", False), ("**/*.py", "b.py", True), ("a/{b,c}/?.x", "a/c/d.x", True), ("[a-c].x", "d.x", False), ("a/**", "a", True), ("a.b", "axb", False)])
def test_globs(spark, pattern, path, hit):
    assert spark.range(1).select(N.glob_match(pattern, F.lit(path)).alias("h")).first()["h"] == hit


def test_names(spark):
    row = spark.range(1).select(
        N.clean_name(F.lit("a \n b" + "x" * 90)).alias("long"), N.fallback_name(F.lit(None).cast("string"), F.lit(4), F.lit("query")).alias("q"), N.query_label(F.lit("-- name: GetIt :one")).alias("l"),
        N.terminal_safe(F.lit("a\x1bb")).alias("t"), N.terminal_safe(F.lit("q\u200e\U000e0001é")).alias("w"), N.short_digest(F.lit("0123456789abcdef:0")).alias("s"), N.short_digest(F.lit("ab")).alias("s2"), N.path_uri(F.lit("a b/é")).alias("u"), N.parent_dir(F.lit("x")).alias("d"), N.location_key(F.lit("p"), F.lit(3), F.lit(12), F.lit("go"), F.lit("f")).alias("k"),
    ).first()
    assert (len(row["long"]), row["q"], row["l"], row["t"], row["u"], row["d"], row["k"]) == (80, "query@4", "GetIt", "a\\u001Bb", "a%20b/%C3%A9", ".", "p:000000003:000000012:go:f")
    assert (row["w"], row["s"], row["s2"]) == ("q\\u200E\\U000E0001é", "0123456789ab", "ab")
    for a, b, want in ((8, 10, 0.8), (0, 3, 0.0), (5, 5, 1.0)):
        assert spark.range(1).select(N.size_upper_bound(F.lit(a), F.lit(b)).alias("x")).first()["x"] == want


def _copies(spark, n, seed=2):
    """Profiles with copies in few files, some places twice: (similar, profiles, members, listed pairs)."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        fp = rng.choice("abc") * 16
        path, line = f"d{rng.randrange(2)}/f{rng.randrange(4)}.py", rng.randrange(5)
        rows.append((k, path, "py", "c", "code", "function", f"n{rng.randrange(2)}", line, line + 2, fp, 10))
    fragments = spark.createDataFrame(rows, "fragment_id long, path string, language string, family string, domain string, kind string, name string, start_line int, end_line int, fingerprint string, feature_count long")
    profs = J.profiles(fragments).cache()
    ids = {r["fingerprint"][0]: r["profile_id"] for r in profs.collect()}
    pairs = [("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", 0.9), ("b", "c", 0.8)]
    found = [(*sorted((ids[x], ids[y])), 10, 10, 9, 11, s) for x, y, s in pairs if x in ids and y in ids]
    similar = spark.createDataFrame(found, "l_id long, r_id long, l_fc long, r_fc long, intersection long, union_size long, score double")
    return similar, profs, J.members(fragments, profs, "all"), J.listed_pairs(fragments, profs, similar), fragments


def test_entries_and_counts_without_listed_pairs(spark):
    for n, seed in ((60, 2), (9, 5)):
        similar, profs, members, listed, fragments = _copies(spark, n, seed)
        places = G.path_pairs(listed, fragments)
        for scope in L.SCOPES:
            want = sorted(map(tuple, L.entries_from_groups(G.match_groups(listed), places, scope).collect()))
            entries = L.entries_from_profiles(similar, profs, members, scope)
            assert sorted(map(tuple, entries.collect())) == want and want
            some = entries.where("hash(left_key, right_key) % 2 = 0")
            known = {(r["id"], *(sorted((r["left_path"], r["right_path"])) if scope == "path" else ())) for r in some.collect()}
            keyed = listed.join(fragments.selectExpr("fragment_id as left_id", "path as p"), "left_id").join(fragments.selectExpr("fragment_id as right_id", "path as q"), "right_id").collect()
            key = lambda r: (":".join(sorted((r["left_fingerprint"], r["right_fingerprint"]))), *(sorted((r["p"], r["q"])) if scope == "path" else ()))
            gone = [key(r) for r in keyed if key(r) in known]
            row = L.suppressed_counts(similar, profs, members, some, scope).first()
            assert tuple(row) == (len(gone), len({k[0] for k in gone}), len(keyed) - len(gone))


def test_literals_are_compared_once_a_list(spark):
    similar, _, members, listed, fragments = _copies(spark, 70)
    values = spark.createDataFrame([(k, [["x"], ["x", "y"], [], ["z", "y"], None][k % 5]) for k in range(66)], "fragment_id long, literal_digests array<string>")
    want = sorted(map(tuple, G.literal_evidence(listed, values).collect()))
    assert sorted(map(tuple, G.profile_literal_evidence(similar, members, values).collect())) == want and len(want) == 4


def test_a_hundred_thousand_copies(spark):
    """5 billion pairs of copies, none of them listed."""
    ids = spark.range(100_000)
    fragments = ids.select(F.col("id").alias("fragment_id"), F.format_string("d/f%06d.py", "id").alias("path"), *[F.lit(x).alias(c) for c, x in (("language", "py"), ("family", "c"), ("domain", "code"), ("kind", "function"), ("name", "f"), ("fingerprint", "a" * 16))], F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(10).cast("long").alias("feature_count"))
    profs = J.profiles(fragments)
    similar = profs.selectExpr("profile_id as l_id", "profile_id as r_id", "fc as l_fc", "fc as r_fc", "fc as intersection", "fc as union_size", "1.0d as score")
    members = J.members(fragments, profs, "all")
    entry = L.entries_from_profiles(similar, profs, members, "content").collect()
    assert [(e["left_path"], e["right_path"]) for e in entry] == [("d/f000000.py", "d/f000001.py")]
    pairs = 100_000 * 99_999 // 2
    assert tuple(L.suppressed_counts(similar, profs, members, spark.createDataFrame(entry), "content").first()) == (pairs, 1, 0)
    literals = ids.select(F.col("id").alias("fragment_id"), F.array(F.lit("x")).alias("literal_digests"))
    assert tuple(G.profile_literal_evidence(similar, members, literals).first())[1:] == (pairs, 0, 0, 0)


def test_receipts_have_a_digest_and_waive_the_focused_gate(spark):
    groups = spark.createDataFrame([("a" * 16 + ":" + "b" * 16,)], "group_id string")
    evidence = dict.fromkeys(L.RECEIPT_FIELDS, "x")
    receipt, other = L.make_receipt(groups, evidence), L.make_receipt(groups, evidence | {"head_commit": "y"})
    digest = lambda r: L.receipt_digest(r).first()["digest"]
    assert digest(receipt) == digest(L.make_receipt(groups, evidence)) != digest(other) and len(digest(receipt)) == 64
    totals = spark.createDataFrame([(3, 2)], "total_groups long, focused_groups long")
    gates = lambda **o: [r["gate"] for r in L.match_gates(totals, **o).collect()]
    both = {"fail_on_match": True, "fail_on_focused_match": True}
    assert gates() == [] and gates(**both) == ["matches", "focused_matches"]
    assert gates(**both, drift=L.receipt_drift(receipt, receipt)) == ["matches"]
    assert gates(fail_on_focused_match=True, drift=L.receipt_drift(receipt, other)) == ["focused_matches"]


@pytest.mark.parametrize("sizes", [(1_024, 4_096, 64), (3, 2, 5), (2, 9, 0)])
def test_only_pairs_that_may_be_similar_leave_a_list(spark, monkeypatch, sizes):
    monkeypatch.setattr(J, "LIST", sizes[0])
    monkeypatch.setattr(J, "BUNDLED", sizes[1])
    monkeypatch.setattr(J, "SMALL", sizes[2])
    monkeypatch.setattr(J, "SKETCHES", (64, 512))
    monkeypatch.setattr(J, "PAIRS", 7)
    rng = random.Random(3)
    items = []
    for i in range(60):
        # all share a rare word, most of them nothing else; every sixth is nearly the one before
        bag = {"rare": 1} | {f"w{rng.randrange(900)}": rng.randint(1, 3) for _ in range(rng.choice((6, 30, 90)))} if i % 6 else dict(items[-1][1] if items else {"rare": 1, "a": 9}) | {"own": 1}
        items.append((i, bag, {"family": rng.choice("xy"), "language": rng.choice("pq")}))
    fragments, bags = make(spark, items)
    fragments = fragments.withColumn("focused", F.col("fragment_id") % 4 == 0)
    profs = J.profiles(fragments)
    met = {(r["l_id"], r["r_id"]) for r in J.met_profiles(J.packed_bags(profs, J.ranked_bags(bags), 0.7), 0.7).collect()}
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and score(a[1], b[1]) >= 0.7}
    assert want <= met and len(want) >= 8 and len(met) <= 2 * len(want)
    assert {(r["left_id"], r["right_id"]) for r in J.similar_pairs(fragments, bags, 0.7).collect()} == want
    near = J.similar_pairs(fragments, bags, 0.7, focused_only=True).collect()
    assert sorted((r["left_id"], r["right_id"]) for r in near) == sorted(p for p in want if p[0] % 4 == 0 or p[1] % 4 == 0)


def test_rows_merge_as_their_bags_do(spark):
    rows = spark.createDataFrame([("a", "Oak elm oak"), ("a", "oak"), ("b", None), ("b", "node:root x")], "whole_id string, text string")
    rows = rows.withColumn("fragment_id", F.monotonically_increasing_id())
    merged = B.merge_rows(B.with_words(rows.drop("fragment_id")))
    want = B.merge_bags(B.word_bags(rows), rows.select("fragment_id", "whole_id"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, want.collect())) and merged.count() == 6
    # words are counted and added up before anything is shuffled
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_source_is_no_single_group(spark):
    from structsim.jobs import source_queries as S

    docs = spark.range(0, 5000, 1, 2).select(F.format_string("s/doc_%d.txt", "id").alias("path"), F.when(F.col("id") > 9, "s").alias("source"))
    rows = S._sources_as_groups(docs).select("name", F.size("occurrences").alias("n")).collect()
    assert max(r["n"] for r in rows) <= S.GROUP_PLACES and sum(r["n"] for r in rows) == 5000
    assert sum(r["n"] for r in rows if r["name"] is None) == 10


def test_path_findings_list_no_pairs(spark, monkeypatch):
    from structsim.jobs import registry

    monkeypatch.setattr(J, "listed_pairs", lambda *_: pytest.fail("pairs of places were listed"))
    assert registry.QUERIES["path_findings"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("bundle", [1, 500])
def test_evidence_is_made_in_cells(spark, monkeypatch, bundle):
    """Equal to brute force for each pair, ties by name, with and without a partner's bag; features are not joined to pairs."""
    rng = random.Random(8)
    bags = {k: Counter(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 40))) for k in range(12)}
    pairs = [(f"{a}-{b}", a, b) for a in range(14) for b in range(a, 14)]
    monkeypatch.setattr(X, "EVIDENCE_BUNDLE", bundle)
    monkeypatch.setattr(X, "aligned", None)
    rows = spark.createDataFrame([(k, f, n) for k, bag in bags.items() for f, n in bag.items()], "fragment_id long, feature string, cnt int")
    got = X.structural_evidence(spark.createDataFrame(pairs, "pair_id string, left_id long, right_id long"), rows, 4).collect()
    top = lambda c: [f"{f}={n}" for f, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:4]]
    want = {}
    for p, a, b in pairs:
        l, r = bags.get(a, Counter()), bags.get(b, Counter())
        if l or r:
            want[p] = (sum((l & r).values()), sum((l | r).values()), sum((l - r).values()), sum((r - l).values()), top(l & r), top(l - r), top(r - l))
    assert {r["pair_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sizes", [(8, 1), (16, 0), (8_192, 1), (8_192, 10_000)])
def test_lists_are_dealt_by_size_and_met_in_tiles(spark, monkeypatch, sizes):
    """All profiles have the same few features: equal to brute force in blocks of near sizes, in tiles and pair by pair."""
    monkeypatch.setattr(J, "LIST", sizes[0])
    monkeypatch.setattr(J, "THICK", sizes[1])
    monkeypatch.setattr(J, "TILE", (5, 7))
    rng = random.Random(5)
    items = []
    for i in range(90):
        scale = rng.choice((6, 12, 13, 40, 9_000))
        bag = {f"b{k}": max(1, round(scale * rng.uniform(0.7, 1.3))) for k in range(6)}
        items.append((i, bag, {"family": rng.choice("xy"), "language": rng.choice("pq")}))
    fragments, bags = make(spark, items)
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and score(a[1], b[1]) >= 0.8}
    assert {(r["left_id"], r["right_id"]) for r in J.similar_pairs(fragments, bags, 0.8).collect()} == want and len(want) > 50
    cross = {p for p in want if items[p[0]][2]["family"] != items[p[1]][2]["family"]}
    assert {(r["left_id"], r["right_id"]) for r in J.similar_pairs(fragments, bags, 0.8, "cross_family").collect()} == cross
    some = fragments.withColumn("focused", F.col("fragment_id") % 4 == 0)
    assert {(r["left_id"], r["right_id"]) for r in J.similar_pairs(some, bags, 0.8, focused_only=True).collect()} == {p for p in want if p[0] % 4 == 0 or p[1] % 4 == 0}


def test_prints_are_made_where_words_are_counted(spark, tmp_path):
    texts = [(1, "b a é a zz z\U0001f600 z B"), (2, None), (3, ""), (4, "x " * 1000 + "y"), (5, "İ a\x1f b\x1e")]
    rows = spark.createDataFrame(texts, "fragment_id long, text string")
    made = B.with_words(rows, prints=True)
    want = sorted(map(tuple, B.fingerprints(B.word_bags(rows)).collect()))
    got = made.where("n_features > 0").select("fragment_id", "feature_count", "n_features", "fingerprint")
    assert sorted(map(tuple, got.collect())) == want and made.where("n_features = 0").count() == 2
    # no interpreted sort and no text of a bag per row in the plan
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan and "sha2" not in plan


def test_a_report_lists_places_of_its_groups_only(spark, monkeypatch):
    from structsim.jobs import review_queries as Q

    asked = []
    listed = G.counted_members
    monkeypatch.setattr(G, "counted_members", lambda similar, members, lonely=None: asked.append(similar) or listed(similar, members, lonely))
    monkeypatch.setattr(G, "top_groups", lambda groups, n, top=G.top_groups: top(groups, 2))
    lines = Q.report_text(spark, "/root/testdata/sf0.001").collect()
    assert [r["rank"] for r in sorted(lines)] == [1, 2] and asked[0].count() == 2


def test_path_pairs_are_made_where_their_sides_meet(spark, monkeypatch):
    from structsim.jobs import queries as Q

    for n, seed in ((60, 2), (9, 5)):
        similar, _, members, listed, fragments = _copies(spark, n, seed)
        want = sorted(map(tuple, G.path_pairs(listed, fragments).collect()))
        made = G.profile_path_pairs(similar, members)
        assert made.columns == G.path_pairs(listed, fragments).columns
        assert sorted(map(tuple, made.collect())) == want and want
    # fragments of one place give its pairs once
    again = members.unionByName(members.withColumn("fragment_id", F.col("fragment_id") + 1000))
    assert G.profile_path_pairs(similar, again).count() == G.profile_path_pairs(similar, again).distinct().count()
    monkeypatch.delattr(J, "listed_pairs")
    found = Q.group_path_pairs(spark, "/root/testdata/sf0.001")
    assert found.count() and "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_entries_are_made_without_a_shuffle_of_groups(spark):
    similar, profs, members, _, _ = _copies(spark, 60, 2)
    plan = L.entries_from_profiles(similar, profs, members, "content")._jdf.queryExecution().executedPlan().toString()
    assert "max(score" not in plan and "min(pair" not in plan
    plan = L.entries_from_profiles(similar, profs, members, "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max(similarity") == 2 and "max(score" not in plan


def test_groups_of_windows_of_long_texts(spark, tmp_path):
    """Texts of more than 66 lines have all their windows."""
    import duckdb

    from structsim.jobs import registry as R
    from structsim.jobs import source_queries as Q

    long = "\n".join(f"line {k} of a text with its own word w{k} and v{k}" for k in range(80))
    rows = [(1, long, "en", "s"), (2, long + "\nand one more", "en", "s"), (3, "line 70 of a text\nwith its own word w70\nand v70", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(R.ORACLE_SQL["block_groups"]).fetchall())
    got = sorted(map(tuple, Q.block_groups(spark, str(tmp_path)).select("group_id", "score", "location_pairs").collect()))
    assert got == want and sum(n for _, score, n in got if score == 1.0) >= 78
    windows, over = Y.statement_windows(Q._statements(spark, str(tmp_path)), 3)
    assert (windows.count(), over.count()) == (78 + 79 + 1, 0)


def _texts(rng, n):
    """(id, bag, columns): bags of 20 to 700 words of a long-tailed vocabulary, many of them near copies of earlier ones."""
    items = []
    for i in range(n):
        if i % 3 and items:
            bag = dict(rng.choice(items)[1])
            for _ in range(int(sum(bag.values()) * rng.choice((0.0, 0.02, 0.08, 0.12, 0.3)))):
                bag[rng.choice(list(bag))] += rng.choice((0, 1))
                bag[f"w{rng.randrange(5000)}"] = 1
        else:
            bag = dict(Counter(f"w{min(int(rng.paretovariate(0.4)), 5000)}" for _ in range(rng.choice((20, 70, 130, 260, 700)))))
        items.append((i, bag, {"family": rng.choice("xy"), "language": rng.choice("pq")}))
    return items


@pytest.mark.parametrize(("threshold", "longest"), [(0.8, 8_192), (0.5, 8_192), (0.8, 4)])
def test_large_bags_meet_in_parts(spark, monkeypatch, threshold, longest):
    monkeypatch.setattr(J, "LIST", longest)
    items = _texts(random.Random(longest + int(10 * threshold)), 90)
    fragments, bags = make(spark, items)
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and score(a[1], b[1]) >= threshold}
    pairs = lambda found: sorted((r["left_id"], r["right_id"]) for r in found.collect())
    assert pairs(J.similar_pairs(fragments, bags, threshold)) == sorted(want) and len(want) > 20
    at = {i: more for i, _, more in items}
    focused = fragments.withColumn("focused", F.col("fragment_id") % 4 == 0)
    assert pairs(J.similar_pairs(focused, bags, threshold, focused_only=True)) == sorted(p for p in want if p[0] % 4 == 0 or p[1] % 4 == 0)
    assert pairs(J.similar_pairs(fragments, bags, threshold, "cross_family")) == sorted(p for p in want if at[p[0]]["family"] != at[p[1]]["family"])
    # rows that hold their bag give the same, and only ids of copies are shuffled to number their features
    held = bags.groupBy("fragment_id").agg(F.collect_list(F.struct("feature", "cnt")).alias("entries"))
    rows = fragments.join(held, "fragment_id").localCheckpoint()
    assert pairs(J.similar_pairs(fragments, rows, threshold)) == sorted(want)
    plan = J.packed_rows(J.profiles(fragments), rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_what_is_sent_for_a_place_does_not_grow_with_the_bag():
    import numpy as np

    from structsim.operators import parts as P

    rng = np.random.default_rng(5)
    for n in (40, 300, 5000):
        features, cnts = np.arange(n), rng.integers(1, 4, n)
        total = int(cnts.sum())
        level = P.levels(np.array([total]))
        at = P.dealt(features, cnts, np.zeros(n, np.int64), level, 0.8)
        assert at["sketch"].shape[1] * 64 == P.BITS and len(at["row"]) <= 0.25 * total + (1 << int(level[0]))
        assert at["size"].max() <= 4 * P.WORDS and (at["before"] <= at["size"] - np.ceil(0.8 * at["size"])).all()
    assert P.levels(np.array([1, 63, 64, 127, 128, 255, 256, 64 << 20])).tolist() == [0, 0, 0, 0, 1, 1, 2, 20]


def test_features_that_share_a_hash_are_told_apart(spark, monkeypatch):
    hashed = J._hashed
    monkeypatch.setattr(J, "_hashed", lambda feature, seed: hashed(feature, seed) % 5 if seed < 2 else hashed(feature, seed))
    bags = spark.createDataFrame([(i, f"f{k}", 1) for i in range(40) for k in range(i % 20 + 1)], "fragment_id long, feature string, cnt int")
    rows = J.ranked_bags(bags).collect()
    assert len({r["feature"] for r in rows}) == 20 and len(rows) == bags.count()
    assert min(r["feature"] for r in rows) >= 0
    # f0, which all 40 bags have, comes after all others
    top = max(r["feature"] for r in rows)
    assert sum(r["feature"] == top for r in rows) >= 38


def test_windows_of_texts_equal_those_of_their_lines(spark):
    from structsim.jobs import source_queries as Q

    texts = [("a", "Oak elm\noak\n\n ash\r\nELM x\n"), ("b", "one\ntwo"), ("c", None), ("d", "\n\n"), ("e", "\n".join(f"w{k} w{k % 3}" for k in range(70)))]
    docs = spark.createDataFrame(texts, "path string, text string")
    made = B.with_words(Y.text_windows(docs, 3), prints=True, root="node:block")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    lines = docs.where("text is not null").select("path", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Q.Window.partitionBy("path").orderBy("k").rowsBetween(Q.Window.unboundedPreceding, -1)), F.lit(0))
    at = [(F.col("k") + 1).alias(c) for c in ("pos", "start_line", "end_line")]
    lines = lines.select("path", F.lit("f").alias("function"), F.lit(0).alias("container"), *at, before.alias("start_byte"), (before + F.length("line")).alias("end_byte"), "line")
    blocks, _ = Y.statement_windows(lines, 3)
    columns = ["path", "first", "start_byte", "end_byte", "start_line", "end_line", "name", "kind"]
    assert sorted(map(tuple, made.select(columns).collect())) == sorted(map(tuple, blocks.select(columns).collect())) and made.count() == 4 + 1 + 68
    key = F.struct("path", "function", "container", "pos")
    words = B.word_bags(lines.withColumn("line_id", key), "line_id", "line").select("fragment_id.*", "feature", "cnt")
    blocks = blocks.withColumn("fragment_id", F.concat_ws("#", "path", "first"))
    want = B.fingerprints(Y.window_bags(blocks, lines, words, 3, "node:block"))
    got = made.select(F.concat_ws("#", "path", "first"), "feature_count", "n_features", "fingerprint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
