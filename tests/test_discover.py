"""Discovery on small made-up trees."""

import hashlib

import pytest
from pyspark.sql import functions as F

from structsim.options import Options
from structsim.sources import discover as D
from structsim.sources import registry as R


def files(spark, *rows):
    return spark.createDataFrame([(p, c, len(c)) for p, c in rows], "path string, content string, size long")


def paths(frame):
    return sorted(r["path"] for r in frame.collect())


def test_languages(spark):
    rows = [("a.PY", ""), ("b/run", "#!/usr/bin/env -S -i python3 -x\n"), ("c", "#!/bin/zsh"), ("d", "#!/usr/bin/env A=1 node"), ("e.sql", ""), ("f.php", "#!/x\n<?hh // strict\n"), ("g.php", "<?php"), ("h.txt", "#!/bin/sh"), ("i", "no")]
    got = {r["path"]: (r["language"], r["family"], r["kind"]) for r in R.detect_language(files(spark, *rows), "postgresql").collect()}
    assert got == {"a.PY": ("python", "python", "function"), "b/run": ("python", "python", "function"), "c": ("zsh", "shell", "function"), "d": (None, None, None), "e.sql": ("postgresql", "sql", "query"), "f.php": ("hack", "php-hack", "function"), "g.php": ("php", "php-hack", "function"), "h.txt": (None, None, None), "i": (None, None, None)}
    found = R.detect_language(files(spark, *rows))
    assert [tuple(r) for r in D.unsupported_extensions(found).collect()] == [(".txt", 1)]
    assert {r["language"]: r["n"] for r in D.language_inventory(found).collect()} == {"python": 2, "zsh": 1, "sql": 1, "hack": 1, "php": 1}


def test_excludes(spark):
    frame = files(spark, ("a/node_modules/x.py", ""), ("a/Build/x.py", ""), ("build", ""), ("gen/a.py", ""), ("b/a_test.py", ""), ("ok/a.py", ""))
    assert paths(frame.where(~D.in_excluded_directory())) == ["b/a_test.py", "build", "gen/a.py", "ok/a.py"]
    assert paths(frame.where(~D.excluded_by(["gen/**", "*_test.py", "**/node_modules"]))) == ["a/Build/x.py", "build", "ok/a.py"]


@pytest.mark.parametrize(("rules", "left"), [
    ("*.log", ["a/keep/x.txt", "a/x.txt", "b.txt"]), ("*.log\n!keep.log", ["a/keep.log", "a/keep/x.txt", "a/x.txt", "b.txt"]), ("a/", ["b.log", "b.txt"]), ("a/\n!x.txt", ["b.log", "b.txt"]),
    ("a/\n!a/keep/**", ["a/keep/x.txt", "b.log", "b.txt"]), ("/b.*  \n# no\n\\#x", ["a/keep.log", "a/keep/x.txt", "a/x.txt"]), ("b.txt/", ["a/keep.log", "a/keep/x.txt", "a/x.txt", "b.log", "b.txt"]),
])
def test_ignore_rules(spark, rules, left):
    frame = files(spark, *((p, "") for p in ("a/keep.log", "a/keep/x.txt", "a/x.txt", "b.log", "b.txt")))
    parsed = D.parse_ignore_rules(spark.createDataFrame([("", rules)], "base string, content string"))
    assert paths(D.apply_ignore_rules(frame, parsed)) == left


def test_nested_ignore_files_bind_below(spark):
    frame = files(spark, ("a/x.log", ""), ("b/x.log", ""))
    parsed = D.parse_ignore_rules(spark.createDataFrame([("", "*.log"), ("a", "!x.log")], "base string, content string"))
    assert paths(D.apply_ignore_rules(frame, parsed)) == ["a/x.log"]


@pytest.mark.parametrize(("content", "marker"), [
    ("// Code generated by x. DO NOT EDIT.\n", "code-generated-do-not-edit"), ("/*\n * @generated\n */", "at-generated"), ("x = '@generated'", None), ("# this file was automatically generated\n", "automatically-generated"),
    ("int x; /* @generated */", None), ("<!-- auto-generated, do not edit -->", "auto-generated-do-not-edit"), ("x\n" * 5000 + "# @generated", None), ("/* Generated by typeshare 1 */\n// @generated", "typeshare-generated"), ("", None),
])
def test_generated(spark, content, marker):
    assert spark.createDataFrame([(content,)], "c string").select(D.generated_marker("c").alias("m")).first()["m"] == marker


def test_overlay_merge_snapshot_size(spark, tmp_path):
    frame = files(spark, ("a", "old"), ("b", "bb"))
    new = spark.createDataFrame([("a", "newer")], "path string, content string")
    assert {r["path"]: (r["content"], r["size"]) for r in D.overlay_content(frame, new).collect()} == {"a": ("newer", 5), "b": ("bb", 2)}
    with pytest.raises(LookupError):
        D.overlay_content(frame, spark.createDataFrame([("q", "")], "path string, content string"))
    known = R.detect_language(files(spark, ("run", "#!/bin/zsh"), ("x.py", "")))
    again = D.overlay_content(known, spark.createDataFrame([("run", "#!/usr/bin/ruby\n")], "path string, content string"))
    assert {r["path"]: r["language"] for r in again.collect()} == {"run": "ruby", "x.py": "python"} and again.columns == known.columns
    assert {r["path"]: r["content"] for r in D.merge_discovery(frame, files(spark, ("b", "later"))).collect()} == {"a": "old", "b": "later"}
    kept, out = D.split_by_size(frame, 2)
    assert paths(kept) == ["b"] and out.first()["reason"] == "resource_limit"
    assert paths(D.read_snapshot(frame.withColumn("mode", F.when(F.col("path") == "a", "120000").otherwise("100644")))) == ["b"]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.py").write_text("pass")
    assert [(r["path"], r["content"], r["size"]) for r in D.read_source_tree(spark, [f"file://{tmp_path}"], f"{tmp_path}/").collect()] == [("x/f.py", "pass", 4)]


def test_coverage(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    files_ = t([(p, "skipped_resource" if p == "c" else "excluded_generated" if p == "i" else "analyzed") for p in "abcdefghi"], "path string, status string")
    made = t([("a", "function"), ("a", "block")], "path string, kind string")
    dropped = t([("b", 2, 0), ("d", 0, 1), ("h", 1, 1)], "path string, below_floor int, skipped int")
    said = t([("a", "parse", 2, 0), ("f", "parse", 3, 0), ("g", "", 0, 0), ("", "other", 0, 0)], "path string, kind string, total_diagnostics int, skipped_fragments int")
    cov = D.file_coverage(files_, made, dropped, said)
    assert {r["path"]: (r["fragment_count"], r["candidate_count"], r["zero_reason"]) for r in cov.collect()} == {
        "a": (2, 1, None), "b": (0, 2, "below_token_floor"), "c": (0, 0, "resource_limit"), "d": (0, 1, "invalid_fragments"), "e": (0, 0, "no_boundaries"),
        "f": (0, 0, "invalid_fragments"), "g": (0, 0, "resource_limit"), "h": (0, 2, "invalid_fragments"), "i": (0, 0, "no_boundaries"),
    }
    total = D.coverage_summary(cov, said)
    assert total.first().asDict() == {"supported": 9, "analyzed": 7, "generated": 1, "fragments": 2, "fragment_files": 1, "zero_files": 6, "warnings": 4, "warning_files": 3, "diagnostic_files": 2, "diagnostics": 5}
    gates = lambda groups=0, focus=None, **o: [r["gate"] for r in D.coverage_gates(total, Options(**o), focus, groups).collect()]
    assert gates(5, min_file_coverage=0.2, max_zero_files=5, fail_on_warning=True, fail_on_diagnostic=True) == ["file_coverage", "zero_files", "warnings", "diagnostics"]
    assert gates(min_file_coverage=1 / 7, max_zero_files=6, require_coverage=True) == [] and gates(5) == ["matches"]
    assert gates(require_focus=True) == ["required_focus"] == gates(1, t([(1, 2)], "covered int, required int"), require_focus=True)
    assert gates(require_focus=True, focus=t([(2, 2)], "covered int, required int")) == []
    none = D.coverage_summary(cov.limit(0), said.limit(0))
    assert [r["gate"] for r in D.coverage_gates(none, Options(require_coverage=True, min_file_coverage=0.1)).collect()] == ["required_coverage", "file_coverage"]


def test_health_and_ignore_evidence(spark):
    frame = files(spark, ("b", "x"), ("a", "y"))
    none = frame.limit(0)
    assert {r["check"]: (r["healthy"], r["n"]) for r in D.health_checks(frame, none).collect()} == {"discovery": (True, 2), "warnings": (True, 0)}
    assert {r["check"]: (r["healthy"], r["n"]) for r in D.health_checks(none, frame).collect()} == {"discovery": (False, 0), "warnings": (False, 2)}
    assert [tuple(r) for r in D.ignore_evidence(frame).collect()] == [("a", hashlib.sha256(b"y").hexdigest()), ("b", hashlib.sha256(b"x").hexdigest())]


def test_domains_roots_and_selectors(spark):
    frame = spark.createDataFrame([("a/x", "code"), ("ab/x", "sql-query"), ("a", "code")], "path string, domain string")
    assert paths(frame.where(D.in_domains(("code",)))) == ["a", "a/x"] and paths(frame.where(D.in_domains(()))) == ["a", "a/x", "ab/x"]
    assert paths(frame.where(D.below_roots(("a/",)))) == ["a", "a/x"] and paths(frame.where(D.below_roots((".",)))) == ["a", "a/x", "ab/x"]
    assert R.resolve_selector(" Shell ") == ["bash", "zsh"] and R.resolve_selector("go") == ["go"]
    assert R.language_pairs([("shell", "go"), ("go", "bash"), ("sql", "sql")]) == (("bash", "go"), ("go", "zsh"), ("postgresql", "postgresql"), ("postgresql", "sql"), ("sql", "sql"))
    with pytest.raises(ValueError):
        R.resolve_selector("cobol")


def test_a_tree_is_decided_by_paths_before_it_is_read(spark, tmp_path):
    tree = {
        ".gitignore": "*.log\nold/\n!old/keep/**\ngone/\n", "a.py": "a", "x.log": "", "vendor/v.py": "v", "gen/g.py": "g", "sub/.gitignore": "!x.log\nb.py\n", "sub/x.log": "kept",
        "sub/b.py": "b", "sub/c.py": "c" * 50, "gone/.gitignore": "!*.py\n", "gone/d.py": "d", "old/keep/e.py": "e", "old/f.py": "f",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    base = f"{tmp_path}/"
    listed = D.list_source_tree(spark, [f"file://{tmp_path}"], base)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    found = D.discover_tree(spark, [f"file://{tmp_path}"], base, excludes=["gen/**"], limit=40)
    assert {r["path"]: r["content"] for r in found.files(base).collect()} == {"a.py": "a", "sub/x.log": "kept", "old/keep/e.py": "e"}
    assert [(r["path"], r["reason"]) for r in found.large.collect()] == [("sub/c.py", "resource_limit")]
    want = [(p, hashlib.sha256(tree[p].encode()).hexdigest()) for p in (".gitignore", "sub/.gitignore")]
    assert [tuple(r) for r in found.evidence.collect()] == want
    assert D.discover_tree(spark, [f"file://{tmp_path}"], base, excludes=["**"]).files(base).count() == 0


def test_indexed_rules_equal_patterns(spark):
    """All kinds of rules against a matcher that tries every rule on every place."""
    import random
    from fnmatch import fnmatchcase

    rng = random.Random(6)
    names = ["a", "b", "x.log", "y.tar.gz", "k.log", "build.d"]
    places = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    places = [p for p in places if not any(q != p and q.startswith(p + "/") for q in places)]
    patterns = ["a", "x.log", "*.log", "*.gz", "a/b", "/b", "b/", "*.tar.gz", "k.*", "[ab]", "a/x.log", "y?tar.gz", "build.d/"]
    for _ in range(4):
        lines = [("!" if rng.random() < 0.3 else "") + rng.choice(patterns) for _ in range(8)]
        lines = [line for line in lines if not (line.startswith("!") and "/" in line.rstrip("/")[1:])]
        rules = D.parse_ignore_rules(spark.createDataFrame([("", "\n".join(lines)), ("a", "!x.log\nk.log")], "base string, content string"))

        def verdict(place, is_dir):
            out = False
            for base, text in (("", lines), ("a", ["!x.log", "k.log"])):
                if base and not place.startswith(base + "/"):
                    continue
                parts = (place[len(base) + 1 :] if base else place).split("/")
                for line in text:
                    body = line.removeprefix("!")
                    bare = body.rstrip("/")
                    anchored, bare = "/" in bare, bare.removeprefix("/")
                    for k in range(len(parts)):
                        if body.endswith("/") and k == len(parts) - 1 and not is_dir:
                            continue
                        value = "/".join(parts[: k + 1]) if anchored else parts[k]
                        if value.count("/") == bare.count("/") and fnmatchcase(value, bare):
                            out = not line.startswith("!")
                            break
            return out

        want = [p for p in places if not verdict(p, False) and not any(verdict("/".join(p.split("/")[:n]), True) for n in range(1, p.count("/") + 1))]
        assert paths(D.apply_ignore_rules(files(spark, *((p, "") for p in places)), rules)) == want
