"""A scan of small Python files from end to end, worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from structsim.jobs import scan as C
from structsim.operators import bags as B
from structsim.operators import treebags as T
from structsim.operators.simjoin import TooManyPairs
from structsim.options import Options
from structsim.sources import extract as X
from structsim.sources import registry as R

ADD = "# é\ndef add(xs):\n    s = 0\n    for x in xs:\n        s = s + len(x)\n    return s\n\ndef other(ys):\n    t = 0\n    for y in ys:\n        t = t + len(y)\n    return t\n"
OUTER = "def outer(a):\n    def inner(b):\n        if b > 1:\n            return load(b)\n        return save(b)\n    return inner(a)\n"
OPTIONS = Options(threshold=0.7, min_tokens=6)


def files(spark, *rows):
    frame = spark.createDataFrame([(p, c, len(c.encode())) for p, c in rows], "path string, content string, size long")
    return R.detect_language(frame)


@pytest.fixture(scope="module")
def done(spark):
    rows = [("a/x.py", ADD), ("b/y.py", ADD.split("\n\n")[0]), ("b/z.py", OUTER), ("b/bad.py", "def f(:"), ("b/tiny.py", "def f(): pass\n"), ("b/none.py", "x = 1\n"), ("n.txt", "")]
    return C.scan(files(spark, *rows), OPTIONS)


def test_spans_are_bytes_of_the_file(spark):
    nodes = X.extract_nodes(files(spark, ("a.py", ADD))).where("kind = 'function_definition'").orderBy("node_id").collect()
    raw = ADD.encode()
    assert [raw[n["start_byte"] : n["end_byte"]].split(b"(")[0] for n in nodes] == [b"def add", b"def other"]
    assert [(n["start_line"], n["end_line"]) for n in nodes] == [(2, 6), (8, 12)] and nodes[0]["end_byte"] < nodes[1]["start_byte"]
    lines = list(X.line_nodes("p", "é\nb"))
    assert [(r[8], r[9]) for r in lines] == [(0, 4), (0, 2), (3, 4)]


def test_fragments_and_groups(done):
    got = {r["path"] + ":" + r["name"]: r for r in done.fragments.collect()}
    assert set(got) == {"a/x.py:add", "a/x.py:other", "b/y.py:add", "b/z.py:outer", "b/z.py:inner"}
    add, outer, inner = got["a/x.py:add"], got["b/z.py:outer"], got["b/z.py:inner"]
    assert (add["nested_count"], outer["nested_count"], outer["nesting_depth"], inner["nesting_depth"]) == (0, 1, 0, 1)
    assert (inner["parent_id"], inner["parent_fingerprint"]) == (outer["fragment_id"], outer["fingerprint"])
    assert add["literal_digests"] == [hashlib.sha256(b"literal:number" + bytes(1) + b"0").hexdigest()]
    # function, name, parameters, parameter, two blocks, two assignments, three names there, number, loop, two names, binary, plus, call, two names, return, name
    assert add["token_count"] == 1 + 1 + 1 + 1 + 2 + 2 + 3 + 1 + 1 + 2 + 1 + 1 + 1 + 2 + 1 + 1
    groups = done.groups.collect()
    assert [(g["score"], g["location_pairs"], g["priority"]) for g in groups] == [(1.0, 3, 10)]
    assert done.ranked(OPTIONS).first()["rank"] == 1 and done.places(OPTIONS).count() == 3
    assert done.totals.select("files", "fragments", "location_pairs", "total_groups").first() == (6, 5, 3, 1)


def test_coverage_of_a_scan(done):
    got = {r["path"]: (r["fragment_count"], r["candidate_count"], r["zero_reason"]) for r in done.coverage.collect()}
    assert got == {
        "a/x.py": (2, 2, None), "b/y.py": (1, 1, None), "b/z.py": (2, 2, None), "b/bad.py": (0, 0, "invalid_fragments"),
        "b/tiny.py": (0, 1, "below_token_floor"), "b/none.py": (0, 0, "no_boundaries"),
    }


def test_ordered_features_come_from_nodes(done):
    have = lambda name: {r["feature"]: r["cnt"] for r in done.bags.where(F.col("fragment_id").startswith("b/z.py")).collect() if r["fragment_id"] == name}
    inner = next(r["fragment_id"] for r in done.fragments.where("name = 'inner'").collect())
    calls = {k: v for k, v in have(inner).items() if k.startswith("ordered:call")}
    assert calls == {"ordered:call:branch:callee-slot-0": 1, "ordered:call:linear:callee-slot-1": 1}


NODE = "path string, node_id long, parent_id long, child_idx int, kind string, is_named boolean, field string, text string, start_byte int, end_byte int, start_line int, end_line int, is_error boolean, is_missing boolean, is_extra boolean"


def node(k, up, kind, field=None, text="", named=True, extra=False):
    return ("f", k, up, 0, kind, named, field, text, k, k + 1, 1, 1, False, False, extra)


def test_hand_made_nodes(spark):
    tree = [
        node(0, None, "program"), node(1, 0, "method_declaration"), node(2, 1, "block", "body"), node(3, 2, "statement_list"), node(4, 3, "comment", extra=True),
        node(5, 3, "method_invocation", text="o.Trim()"), node(6, 5, "identifier", "object", "o"), node(7, 5, "identifier", "name", "Trim"), node(8, 3, "method_declaration"),
        node(9, 3, "if_statement"), node(10, 9, "method_invocation", "condition"), node(11, 10, "identifier", "name", "go"), node(12, 9, "integer", "consequence", "7"), node(13, 0, "integer", text="8"),
    ]
    bags, facts = T.fragment_bags(spark.createDataFrame(tree, NODE), ("method_declaration", "program"))
    have = {}
    for r in bags.collect():
        have.setdefault(r["fragment_id"], {})[r["feature"]] = r["cnt"]
    assert have["f#8"] == {"node:function": 1, "class:function": 1}
    one = have["f#1"]
    # The receiver adds a member layer; of four statements the first is a comment and the third a boundary.
    assert (one["node:expression:member"], one["role:callee>expression:member"], one["node:function:nested"], one["semantic:trim"]) == (1, 1, 1, 2)
    assert {k: v for k, v in one.items() if k.startswith("ordered:")} == {
        "ordered:statement:middle:expression:call": 1, "ordered:statement:last:flow:if": 1, "ordered:call:linear:callee-slot-1": 1, "ordered:call:condition:callee-slot-0": 1,
    }
    assert have["f#0"]["node:function:nested"] == 1 and have["f#0"]["node:literal:number"] == 1
    got = {r["fragment_id"]: (r["token_count"], r["nested_count"], len(r["literal_digests"])) for r in facts.collect()}
    assert got == {"f#0": (3, 1, 1), "f#1": (1 + 1 + 3 + 1 + 1 + 1 + 2 + 1, 1, 1), "f#8": (1, 0, 0)}


def test_options_of_a_scan(spark):
    rows = [("a/x.py", ADD), ("b/y.py", ADD), ("vendor/x.py", ADD), ("b/g.py", "# @generated\n" + ADD), ("b/q.sql", "select 1")]
    chosen = lambda **o: {r["path"]: r["status"] for r in C.selected_files(files(spark, *rows), Options(**o)).collect()}
    assert chosen() == dict.fromkeys(["a/x.py", "b/y.py", "b/g.py", "b/q.sql"], "analyzed")
    assert chosen(roots=("b",), domains=("code",), exclude_generated=True, max_file_bytes=10_000) == {"b/y.py": "analyzed", "b/g.py": "excluded_generated"}
    assert set(chosen(max_file_bytes=10).values()) == {"skipped_resource", "analyzed"}
    with pytest.raises(TooManyPairs):
        C.scan(files(spark, *rows[:2]), Options(min_tokens=5, max_pairs=2))


BLOCKS = """def one(xs):
    a = load(xs)
    b = save(a)
    if b > 1:
        c = load(b)
        d = save(c)
        e = keep(d)
    return e

def two(ys):
    p = load(ys)
    q = save(p)
    if q > 1:
        r = load(q)
        s = save(r)
        t = keep(s)
    return t
"""


def test_statement_blocks_of_a_scan(spark):
    options = Options(threshold=0.6, min_tokens=6, statement_blocks=True, block_statements=3, max_pairs=0)
    done = C.scan(files(spark, ("a.py", BLOCKS), ("b.py", BLOCKS.split("\n\n")[0])), options)
    rows = {(r["path"], r["name"]): r for r in done.fragments.where("kind = 'block'").collect()}
    spans = [(2, 7), (3, 8), (5, 7)]
    assert set(rows) == {(p, f"block@{a + off}-{b + off}") for p, off in (("a.py", 0), ("a.py", 9), ("b.py", 0)) for a, b in spans}
    raw, first = BLOCKS.encode(), rows["a.py", "block@2-7"]
    assert raw[first["start_byte"] : first["end_byte"]].startswith(b"a = load") and raw[: first["end_byte"]].endswith(b"e = keep(d)")
    one = {r["feature"]: r["cnt"] for r in done.bags.where(F.col("fragment_id") == first["fragment_id"]).collect()}
    # The window's own node, then what each statement has; each statement is a root of its own.
    assert (one["node:block"], one["node:flow:if"], one["node:expression:assignment"]) == (2, 1, 5)
    assert (one["ordered:statement:first:expression:assignment"], one["ordered:statement:last:flow:if"]) == (2, 1)
    assert "edge:block>flow:if" not in one and one["edge:flow:if>block"] == 1
    assert one["ordered:call:branch:callee-slot-1"] == 1 and "ordered:call:linear:callee-slot-0" not in one
    assert first["feature_count"] == sum(one.values()) and first["nesting_depth"] == 1
    parent = done.fragments.where("name = 'one' and path = 'a.py'").first()
    assert (first["parent_id"], first["parent_fingerprint"]) == (parent["fragment_id"], parent["fingerprint"])

    own = [r for r in done.fragments.where("kind = 'block'").collect()]
    bags = {}
    for r in done.bags.collect():
        bags.setdefault(r["fragment_id"], {})[r["feature"]] = r["cnt"]
    want, touched = {}, {}
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if a["path"] == b["path"] and a["start_byte"] < b["end_byte"] and b["start_byte"] < a["end_byte"]:
                continue
            x, y = bags[a["fragment_id"]], bags[b["fragment_id"]]
            both = sum(min(x[f], y[f]) for f in x.keys() & y.keys())
            if both / (sum(x.values()) + sum(y.values()) - both) >= 0.6:
                group = ":".join(sorted((a["fingerprint"], b["fingerprint"])))
                want[group] = want.get(group, 0) + 1
                touched.setdefault(group, set()).update((a["fragment_id"], b["fragment_id"]))
    prints = {r["fingerprint"] for r in own}
    got = {g["group_id"]: g["location_pairs"] for g in done.groups.collect() if g["group_id"][:16] in prints}
    assert got == want and len(want) > 3
    places = done.places(options).where(F.col("fingerprint").isin(*prints)).groupBy("group_id").count().collect()
    assert {r["group_id"]: r["count"] for r in places} == {g: len(t) for g, t in touched.items()}
    assert done.coverage.where("path = 'a.py'").select("fragment_count", "candidate_count").first() == (8, 2)


def test_blocks_that_overlap_every_partner_are_no_places(spark):
    """Five equal statements: windows 1-3, 2-4 and 3-5 are one profile; only the pairs of two files are left."""
    same = "def f(x):\n" + "    go(x)\n" * 5
    options = Options(threshold=0.9, min_tokens=3, statement_blocks=True, block_statements=3, max_pairs=0)
    alone = C.scan(files(spark, ("a.py", same)), options)
    assert alone.fragments.where("kind = 'block'").count() == 3 and alone.groups.count() == 0
    assert alone.totals.select("candidate_pairs", "location_pairs").first() == (0, 0)
    both = C.scan(files(spark, ("a.py", same), ("b.py", same)), options)
    assert sorted(r["location_pairs"] for r in both.groups.collect()) == [1, 9]
    six = C.scan(files(spark, ("a.py", same + "    go(x)\n")), options)
    assert [g["location_pairs"] for g in six.groups.collect()] == [1] and six.places(options).count() == 2


def test_functions_with_too_many_windows(spark):
    many = "def f(x):\n" + "".join(f"    go(x, {k})\n" for k in range(9))
    options = Options(threshold=0.9, min_tokens=3, statement_blocks=True, block_statements=2, max_blocks_per_function=7, max_pairs=0)
    done = C.scan(files(spark, ("a.py", many)), options)
    assert done.fragments.where("kind = 'block'").count() == 0
    told = done.warnings.collect()
    assert [(r["kind"], r["message"]) for r in told] == [("coverage", "f at line 1 has more than 7 windows of statements")]
    enough = C.scan(files(spark, ("a.py", many)), Options(threshold=0.9, min_tokens=3, statement_blocks=True, block_statements=2, max_blocks_per_function=8, max_pairs=0))
    assert enough.fragments.where("kind = 'block'").count() == 8 and enough.warnings.count() == 0


def test_labels_of_queries(spark):
    def statements(path, source):
        """Statements of a text, each a boundary with its words."""
        yield path, 0, None, 0, "source", True, None, "", 0, len(source), 1, 1, False, False, False, None
        k, at = 1, 0
        for piece in source.split(";"):
            body = "\n".join(x for x in piece.split("\n") if not x.strip().startswith("--")).strip()
            if body:
                start = source.index(body, at)
                at = start + len(body)
                line = source[:start].count("\n") + 1
                top = k
                yield path, top, 0, 0, "function_definition", True, None, "", start, at, line, line, False, False, False, None
                for word in body.split():
                    k += 1
                    yield path, k, top, 0, "identifier", True, None, word, start, at, line, line, False, False, False, None
                k += 1

    text = (
        "-- name: First :one\nselect a from b;\n-- name: Crlf :many2\r\n  select c from d;\n-- name: Blank :one\n\nselect e from f;\n"
        "--  name: Two :one\nselect g from h;\n-- name: Late :one\n select i from j; select k from l;\n-- name: Odd :1\nselect m from n"
    )
    done = C.scan(files(spark, ("q.sql", text), ("p.py", "-- name: X :one\nf x y z")), Options(threshold=0.9, min_tokens=2, max_pairs=0), statements)
    got = [r["name"] for r in done.fragments.where("path = 'q.sql'").orderBy("start_byte").collect()]
    assert got == ["First", "Crlf", "query@7", "query@9", "Late", "query@11", "query@13"]
    assert [r["name"] for r in done.fragments.where("path = 'p.py'").collect()] == ["anonymous@2"]


def test_copies_are_parsed_and_walked_once_a_task(spark, monkeypatch):
    monkeypatch.setattr(X, "KEPT", 2)
    monkeypatch.setattr(T, "KEPT", 2)
    monkeypatch.setattr(X, "KEPT_CHARACTERS", 1000)
    long = ADD + "# " + "x" * 1000 + "\n"
    texts = [ADD, ADD, OUTER, "def f(:", ADD, ADD, "def f(:", "def f(:", long, long, "", "", OUTER, OUTER]
    rows = files(spark, *[(f"d/{k:02d}.py", t) for k, t in enumerate(texts)]).coalesce(1).sortWithinPartitions("path")
    units = lambda copies: T.streamed_units(X.extract_nodes(rows, copies=copies), C.BOUNDARIES, C.SCRIPTS, 2, 64)
    plain = lambda made: sorted(map(str, made.toPandas().itertuples(index=False)))
    assert plain(units(True)) == plain(units(False)) and len({r["path"] for r in units(True).collect()}) == 12
    nodes = X.extract_nodes(rows, copies=True)
    told = [r["path"] for r in nodes.where("node_id is null and warning is null").collect()]
    # of the last two distinct contents copies are told, in order of when they were read first
    assert told == ["d/01.py", "d/05.py", "d/06.py", "d/07.py", "d/11.py", "d/13.py"]
    # a function may look at paths
    own = X.extract_nodes(rows, lambda path, text: X.line_nodes(path, text), copies=True)
    assert own.where("node_id is null").count() == 0
    prints = {r["fingerprint"] for r in units(True).where("features is not null").collect()}
    want = units(True).where("features is not null").select(B.fingerprint_of_map("features")).distinct().collect()
    assert prints == {r[0] for r in want}


def test_lines_are_handed_on_without_their_text():
    rows = list(X.line_nodes("p", "é\nb" + "x" * 1000))
    assert [r[7] for r in rows] == ["", "", ""] and [(r[8], r[9]) for r in rows] == [(0, 1004), (0, 2), (3, 1004)]
