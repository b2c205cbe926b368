from pyspark.sql import functions as F

from structsim.operators import bags as B
from structsim.operators import simjoin as J
from structsim.operators import spans as P
from structsim.operators import syntax as S
from structsim.operators import treebags as T
from structsim.sources import extract as X

CODE = "def total(xs):\n    out = 0\n    for x in xs:\n        if x > 1:\n            out += len(x)\n    return out\n"


def bags(spark, *sources):
    files = spark.createDataFrame([(f"f{k}", s) for k, s in enumerate(sources)], "path string, content string")
    units = T.with_id(T.streamed_units(X.extract_nodes(files), ("function_definition",)))
    return units, T.unit_bags(units).withColumn("path", F.substring_index("fragment_id", "#", 1))


def test_names_do_not_count_and_logic_does(spark):
    units, made = bags(spark, CODE, CODE.replace("total", "t").replace("xs", "ys").replace("out", "acc"), CODE.replace("x > 1", "x > 1 and x < 9"), "def broken(:")
    assert [r["path"] for r in units.where("warning is not null").collect()] == ["f3"]
    own = made.select(F.col("path").alias("fragment_id"), "feature", "cnt")
    print_ = {r["fragment_id"]: r["fingerprint"] for r in B.fingerprints(own).collect()}
    again = units.where("features is not null").select("path", B.fingerprint_of_map("features").alias("f")).collect()
    assert print_ == {r["path"]: r["f"] for r in again}
    assert print_["f0"] == print_["f1"] != print_["f2"]
    have = {r["feature"]: r["cnt"] for r in made.where("path = 'f0'").collect()}
    assert have["node:function"] == 1 and have["node:flow:loop"] == 1 and have["semantic:length"] == 2 and have["class:control"] == 3
    assert have["edge:function>parameters"] == 1 and have["role:callee>symbol"] == 1
    # A root has no role; a function's statements are a block in order, and operators count.
    assert "role:body>function" not in have and have["edge:function>block"] == 1 and have["node:operator:ordered"] == 1
    assert have["ordered:statement:first:expression:assignment"] == 1 and have["ordered:statement:middle:flow:loop"] == 1


def test_nested_functions_are_one_node(spark):
    _, made = bags(spark, "def outer():\n    def inner(a):\n        return a\n    return inner\n")
    rows = made.collect()
    assert len({r["fragment_id"] for r in rows}) == 2
    outer = min(r["fragment_id"] for r in rows)
    have = {r["feature"]: r["cnt"] for r in rows if r["fragment_id"] == outer}
    assert have["node:function:nested"] == 1 and have["edge:block>function:nested"] == 1 and "node:parameter" not in have


def test_canonical_names(spark):
    cases = [("parenthesized_expression", "", None), ("opt_x", "", None), ("keyword_in", "", None), ("integer", "1", "literal:number"), ("literal", "'a'", "literal:string"), ("literal", "?", "parameter"), ("literal", "-1.5", "literal:number"), ("literal", "NULL", "literal:null"), ("control_transfer_statement", "return x", "flow:return"), ("foo_statement", "", "statement:foo"), ("x_literal", "", "literal:x"), ("zzz", "", "syntax:zzz")]
    frame = spark.createDataFrame([(k, t, w) for k, t, w in cases], "kind string, text string, want string")
    assert all(r["got"] == r["want"] for r in frame.select("want", S.canonical_named(F.col("kind"), F.col("text")).alias("got")).collect())
    ops = spark.createDataFrame([("strings.TrimSpace", "trim"), ("a.b(", None), ("x.len()", "length")], "c string, want string")
    assert all(r["got"] == r["want"] for r in ops.select("want", S.semantic_operation(F.col("c")).alias("got")).collect())


def test_nesting_diagnostics_and_floor(spark):
    f = spark.createDataFrame([(1, "p", "function", 0, 100, 50), (2, "p", "function", 10, 60, 20), (3, "p", "block", 20, 40, 5), (4, "p", "block", 20, 50, 30), (5, "q", "function", 0, 9, 40)], "fragment_id long, path string, kind string, start_byte int, end_byte int, token_count int")
    assert {r["fragment_id"]: (r["parent_id"], r["nesting_depth"]) for r in P.annotate_nesting(f).collect()} == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (2, 2), 5: (None, 0)}
    bad = spark.createDataFrame([("q", k, "ERROR", k, k + 1, 1, True, False) for k in range(7)], "path string, node_id long, kind string, start_byte int, end_byte int, start_line int, is_error boolean, is_missing boolean")
    row = S.parse_diagnostics(bad).first()
    assert (row["path"], row["total"], [x["node_id"] for x in row["first"]]) == ("q", 7, [0, 1, 2, 3, 4])
    flagged = spark.createDataFrame([("r", 0, "program", 0, 9), ("r", 1, "call", 2, 5), ("r", 2, "name", 6, 9)], "path string, node_id long, kind string, start_byte int, end_byte int")
    flagged = flagged.selectExpr("*", "1 as start_line", "false as is_error", "false as is_missing", "true as has_error")
    row = S.parse_diagnostics(flagged).first()
    assert (row["path"], row["total"], [x["node_kind"] for x in row["first"]]) == ("r", 1, ["call"])
    assert J.MODES[0] == "all"


def test_invalid_fragments_by_the_tree(spark):
    """p: 1 holds 2 and 5; 4 is a zero-wide missing node at the end of 2. q: an error node 1 above fragment 2, not above 4."""
    tree = [("p", 0, None, False, False), ("p", 1, 0, False, False), ("p", 2, 1, False, False), ("p", 3, 2, False, False), ("p", 4, 2, False, True), ("p", 5, 1, False, False)]
    tree += [("q", 0, None, False, False), ("q", 1, 0, True, False), ("q", 2, 1, False, False), ("q", 3, 2, False, False), ("q", 4, 0, False, False), ("q", 5, 4, False, False)]
    nodes = spark.createDataFrame(tree, "path string, node_id long, parent_id long, is_error boolean, is_missing boolean")
    ends = T.tree_ends(nodes)
    assert {(r["path"], r["node_id"]): r["last_id"] for r in ends.collect()} == {
        ("p", 0): 5, ("p", 1): 5, ("p", 2): 4, ("p", 3): 3, ("p", 4): 4, ("p", 5): 5, ("q", 0): 5, ("q", 1): 3, ("q", 2): 3, ("q", 3): 3, ("q", 4): 5, ("q", 5): 5,
    }
    nodes = nodes.join(ends, ["path", "node_id"])
    picked = nodes.where("path = 'p' and node_id in (1, 2, 5) or path = 'q' and node_id in (2, 4, 5)")
    some = picked.select(F.concat_ws("#", "path", "node_id").alias("fragment_id"), "path", "node_id", "last_id", F.when(F.col("node_id") == 5, 3).otherwise(20).alias("token_count"))
    kept, counts = S.drop_invalid(some, nodes, 10)
    assert sorted(r["fragment_id"] for r in kept.collect()) == ["q#4"]
    assert {r["path"]: (r["below_floor"], r["skipped"]) for r in counts.collect()} == {"p": (1, 2), "q": (1, 1)}


def test_nesting_of_many_fragments(spark):
    """A sweep against all pairs; blocks are not parents of blocks, but a function in one may be its child."""
    import random

    rng = random.Random(3)
    rows = [("p", "function", 0, 1000), ("p", "block", 10, 300), ("p", "block", 100, 400), ("p", "block", 110, 200), ("p", "function", 120, 180), ("p", "block", 130, 170), ("p", "block", 130, 170)]
    for _ in range(150):
        a = rng.randrange(0, 900)
        rows.append(("q", rng.choice(("block", "function")), a, a + rng.choice((3, 10, 60, 99))))
    rows = [(k, *r, f"f{k}") for k, r in enumerate(rows)]
    frame = spark.createDataFrame(rows, "fragment_id long, path string, kind string, start_byte int, end_byte int, fingerprint string")
    parents = {}
    for k, p, kind, a, b, _ in rows:
        held = [(e - s, j) for j, q, other, s, e, _ in rows if q == p and s <= a and e >= b and (s, e) != (a, b) and not kind == other == "block"]
        parents[k] = min(held)[1] if held else None
    depth = lambda k: 0 if parents[k] is None else 1 + depth(parents[k])
    got = {r["fragment_id"]: (r["parent_id"], r["parent_fingerprint"], r["nesting_depth"]) for r in P.annotate_nesting(frame).collect()}
    assert got == {k: (p, None if p is None else f"f{p}", depth(k)) for k, p in parents.items()}
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] == b[2] == "block" and a[3] < b[4] and b[3] < a[4])
    assert sorted(tuple(r) for r in P.overlapping_blocks(frame).collect()) == want


def test_nesting_of_one_large_file(spark):
    ids = spark.range(50_000)
    frame = ids.select(F.col("id").alias("fragment_id"), F.lit("p").alias("path"), F.lit("function").alias("kind"), (F.col("id") * 10).alias("start_byte"), (F.col("id") * 10 + F.when(F.col("id") % 2 == 0, 20).otherwise(5)).alias("end_byte"))
    assert P.annotate_nesting(frame).where("nesting_depth = 1 and parent_id = fragment_id - 1").count() == 25_000
