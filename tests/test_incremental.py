import random
from collections import Counter

from structsim.operators import report as R
from structsim.streaming import incremental as I

CHANGE = "path string, version long, text string, deleted boolean"


def bag(text):
    return Counter(text.lower().split())


def rescan(state, threshold):
    """All pairs of what is there."""
    score = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    paths, out = sorted(state), {}
    for k, a in enumerate(paths):
        for b in paths[k + 1 :]:
            s = score(bag(state[a][1]), bag(state[b][1]))
            if s >= threshold and bag(state[a][1]):
                out[a, state[a][0], b, state[b][0]] = s
    return out


def found(log, batch):
    rows = log.current_findings(batch).collect()
    out = {(r["left_path"], r["left_version"], r["right_path"], r["right_version"]): r["score"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_log_equals_a_rescan_after_each_batch(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
    state = {f"p{k}": (0, text()) for k in range(24)}
    log = I.CorpusLog(spark, f"file://{tmp_path}/log", 0.6, every=2)
    log.build(spark.createDataFrame([(p, t) for p, (_, t) in state.items()], "path string, text string"))
    assert found(log, -1) == rescan(state, 0.6) and len(rescan(state, 0.6)) > 3
    tombs, batches = {}, []
    for k in range(5):
        rows = []
        for _ in range(9):
            path = f"p{rng.randrange(30)}"
            seen = max(state.get(path, (-1,))[0], tombs.get(path, -1))
            version = seen + rng.choice((-1, 0, 1, 2)) if seen >= 0 else 0
            rows.append((path, version, text() + rng.choice(("", " new", f" only{k}")), rng.random() < 0.25))
        rows += [(None, 1, "a", False), ("nul", None, "a", False)] if k == 1 else []
        batches.append(rows)
        fresh = {}
        for path, version, t, gone in rows:
            if path is not None and version is not None:
                fresh[path] = max(fresh.get(path, (version, gone, t)), (version, gone, t))
        for path, (version, gone, t) in fresh.items():
            if version > max(state.get(path, (-1,))[0], tombs.get(path, -1)):
                state.pop(path, None)
                if gone:
                    tombs[path] = version
                else:
                    state[path] = (version, t)
        frame = spark.createDataFrame(rows, CHANGE).repartition(3)
        log.apply(frame, k)
        want = rescan(state, 0.6)
        assert found(log, k) == want
        assert {(r["path"], r["version"]) for r in log.current_heads(k).collect()} == {(p, v) for p, (v, _) in state.items()}
        if k in (2, 4):  # batches that merge; they run again after a failure
            log.apply(frame, k)
            assert found(log, k) == want
    assert tombs


def test_findings_go_with_their_version(spark, tmp_path):
    """c becomes equal to the new a and e to the old one; a later e has no findings; an old e comes late."""
    log = I.CorpusLog(spark, f"file://{tmp_path}/log", 0.75)
    log.build(spark.createDataFrame([("a", "x y z w"), ("b", "k l m n")], "path string, text string"))
    step = lambda k, *rows: log.apply(spark.createDataFrame(rows, "path string, version long, text string"), k)
    step(0, ("a", 1, "q r s t"))
    step(1, ("c", 1, "q r s t"), ("e", 1, "x y z w"))
    assert found(log, 1) == {("a", 1, "c", 1): 1.0}
    step(2, ("e", 2, "q r s t"))
    assert set(found(log, 2)) == {("a", 1, "c", 1), ("a", 1, "e", 2), ("c", 1, "e", 2)}
    step(3, ("e", 3, "nothing like it"), ("a", 0, "k l m n"))
    assert set(found(log, 3)) == {("a", 1, "c", 1)}
    step(4, ("e", 2, "q r s t"))
    assert set(found(log, 4)) == {("a", 1, "c", 1)} and set(found(log, 2)) == {("a", 1, "c", 1), ("a", 1, "e", 2), ("c", 1, "e", 2)}


def test_stream_follows_its_changes(spark, tmp_path):
    schema = "path string, version long, text string"
    corpus = spark.createDataFrame([("a", "x y z w"), ("b", "x y z w v"), ("c", "q r s t")], "path string, text string")
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/log"

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        q = I.incremental_scan(stream, corpus, 0.75, folder, f"file://{tmp_path}/ck")
        q.processAllAvailable()
        q.stop()

    log = I.CorpusLog(spark, folder, 0.75)
    spark.createDataFrame([("c", 1, "x x x x"), ("c", 2, "x y z w"), ("d", 1, "q r s t")], schema).coalesce(1).write.parquet(source)
    run()
    assert found(log, 0) == {("a", 0, "b", 0): 0.8, ("a", 0, "c", 2): 1.0, ("b", 0, "c", 2): 0.8}
    spark.createDataFrame([("a", 5, "q r s t")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert found(log, 1) == {("b", 0, "c", 2): 0.8, ("a", 5, "d", 1): 1.0}


def test_reports(spark):
    groups = spark.createDataFrame([(1, "g1", 0.9, 2), (2, "g2", 0.8, 1)], "rank int, group_id string, score double, location_pairs long")
    places = spark.createDataFrame([("g1", f"k{n}", f"p {n}", n, n + 1) for n in range(4)] + [("g2", "k9", "p", 1, 2)], "group_id string, location_key string, path string, start_line int, end_line int")
    warnings = spark.createDataFrame([("p", "odd")], "path string, message string")
    rows = R.sarif_results(groups, places, warnings).collect()
    assert sorted(r["level"] for r in rows) == ["note", "note", "warning"]
    note = next(r["result"] for r in rows if r["id"] == "g1")
    assert note.count('"uri":"p%20') == 4 and note.index("p%200") < note.index("relatedLocations") < note.index("p%201")
    assert '"ruleId":"SIM001"' in note and all('"ruleId":"SIM002"' in r["result"] for r in rows if r["level"] == "warning")
    odd = spark.createDataFrame([("/a b/c.py",), ("C:\\\\x y\\\\z.py",), ("d/é.py",)], "path string")
    assert [r[0] for r in odd.select(R.artifact_uri("path")).collect()] == ["file:///a%20b/c.py", "file:///C:/x%20y/z.py", "d/%C3%A9.py"]
    assert [r["id"] for r in R.sarif_rules(spark).collect()] == ["SIM001", "SIM002"]
    lines = {r["rank"]: r["line"] for r in R.report_lines(groups, places).collect()}
    assert lines[1].startswith("1. 90.00% ") and lines[1].endswith("2 pairs: k0, k1, k2")
    assert {r["kind"]: r["line"] for r in R.agent_summary(groups, warnings).collect()}["groups left out"] == "0"
    assert R.report_json(warnings.limit(1), groups, 20).count() == 3


def test_nested_paths_are_redacted_alike(spark):
    groups = spark.createDataFrame([("g", [(("b.py", 1),), (("a.py", 2),)], None), ("h", None, ["a.py", "", "c"])], "id string, places array<struct<location:struct<path:string,n:int>>>, changed_paths array<string>")
    warnings = spark.createDataFrame([("c", "odd"), (None, "none"), ("", "empty")], "path string, message string")
    out = R.redact_report({"groups": groups, "warnings": warnings, "totals": spark.range(1)})
    got = {r["id"]: r for r in out["groups"].collect()}
    assert [p["location"]["path"] for p in got["g"]["places"]] == ["<path-002>.py", "<path-001>.py"] and got["g"]["places"][0]["location"]["n"] == 1
    assert got["h"]["changed_paths"] == ["<path-001>.py", "", "<path-003>"] and got["h"]["places"] is None and got["g"]["changed_paths"] is None
    assert {r["message"]: r["path"] for r in out["warnings"].collect()} == {"odd": "<path-003>", "none": None, "empty": ""}
    assert out["groups"].schema.simpleString() == groups.schema.simpleString() and out["totals"].count() == 1


def test_copies_are_met_once(spark, tmp_path, monkeypatch):
    """300 equal files, 150 of which change to other equal bags with new words: the join meets few profiles, the log has all pairs."""
    sizes = []
    real = I.J.met_profiles
    monkeypatch.setattr(I.J, "met_profiles", lambda packed, *a, **b: sizes.append(packed.count()) or real(packed, *a, **b))
    log = I.CorpusLog(spark, f"file://{tmp_path}/log", 0.75, every=2)
    log.build(spark.createDataFrame([(f"p{k}", "a b c d e f g h") for k in range(300)], "path string, text string"))
    state = {f"p{k}": (0, "a b c d e f g h") for k in range(300)}
    for batch, word in enumerate(("new", "newer", "newest")):
        rows = [(f"p{k}", batch + 1, f"a b c d e f g h {word}") for k in range(0, 300, 2)]
        state |= {p: (v, t) for p, v, t in rows}
        log.apply(spark.createDataFrame(rows, "path string, version long, text string"), batch)
        got = log.current_findings(batch)
        assert got.count() == 300 * 299 // 2
    assert found(log, 2) == rescan(state, 0.75)
    assert max(sizes) == 2
