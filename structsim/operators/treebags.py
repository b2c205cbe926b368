"""Bags and facts of fragments and statement windows, in one pass over each file's syntax nodes.

The nodes of a file follow one another in document order, as an extractor yields them, so a file is walked as it streams
by: no node table is stored, shuffled or joined. Names and classes of nodes are column expressions (``syntax``); the walk
numbers the tree by intervals (a subtree is the run of nodes from its root to its last node), and everything else is
sums over such runs. A file's nodes are held at a time; files are bounded by the size limit of discovery.

Units, one row each:

* ``fragment``: a boundary node, or a whole file of a script kind. Nested boundaries are one node in it.
* ``block``: ``size`` statements of a container that follow one another. Its bag is the sum of its statements' bags,
  which are made once a statement, with the order of the statements.
* ``left_out``: a function with more than ``most`` windows, which then has none.
* ``file``: a file's diagnostics, or why it could not be read (``warning``).

A fragment is invalid if a node in its tree, or one above it, is an error or missing; its blocks are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.operators import syntax as S
from structsim.sources.extract import KEPT

_ARROW = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
    "map<string,int>": pa.map_(pa.string(), pa.int32()), "array<string>": pa.list_(pa.string()),
}
_UNIT = {
    "path": "string", "unit": "string", "node_id": "long", "last_id": "long", "node_kind": "string", "said": "string",
    "start_byte": "long", "end_byte": "long", "start_line": "int", "end_line": "int", "token_count": "int",
    "nested_count": "int", "features": "map<string,int>", "feature_count": "long",
    "fingerprint": "string", "literal_digests": "array<string>", "invalid": "boolean",
    "total": "long", "warning": "string",
}
UNITS = ", ".join(f"{name} {kind}" for name, kind in _UNIT.items())
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in _UNIT.items()])
_NODE = (
    "node_id", "parent_id", "kind", "is_named", "field", "text", "start_byte", "end_byte", "start_line", "end_line",
    "is_error", "is_missing", "is_extra", "canonical", "class", "warning",
)
# Kinds of nodes whose children are statements, and those that are so in shells only.
CONTAINERS = (
    "block", "compound_statement", "do_group", "function_body", "compound_statement_no_always", "statement_block",
    "statement_list", "statements",
)
SHELL_CONTAINERS = ("case_item", "elif_clause", "else_clause", "if_statement", "list")
# What a method call with a receiver has besides, as other grammars have a node for the access.
RECEIVER_LAYER = (
    "node:expression:member", "class:operation", "edge:expression:call>expression:member",
    "role:callee>expression:member",
)
MOST_CALLS, MOST_CALLEES = 8, 8
#: Rows that are handed on at a time.
_ROWS = 256


def last_word(text: str) -> str:
    """The last word of a text in small letters, empty for none."""
    is_word = lambda c: c.isalpha() or c.isdecimal() or c == "_"
    end = len(text)
    while end and not is_word(text[end - 1]):
        end -= 1
    start = end
    while start and is_word(text[start - 1]):
        start -= 1
    return text[start:end].lower()


class Tree:
    """A file's nodes by place in document order, with intervals: node k's tree is the places k to ``last[k]``."""

    def __init__(self, rows: Sequence[tuple], boundaries: frozenset[str], shell: bool = False):
        columns = dict(zip(_NODE, zip(*rows, strict=True), strict=True))
        self.kind, self.field, self.text, self.named = (columns[c] for c in ("kind", "field", "text", "is_named"))
        self.canonical, self.coarse, self.node_id = columns["canonical"], columns["class"], columns["node_id"]
        self.span = list(zip(*(columns[c] for c in ("start_byte", "end_byte", "start_line", "end_line")), strict=True))
        self.boundaries, self.containers = boundaries, {*CONTAINERS, *(SHELL_CONTAINERS if shell else ())}
        place = {node: k for k, node in enumerate(self.node_id)}
        self.up = [place.get(u, -1) for u in columns["parent_id"]]
        self.below: list[list[int]] = [[] for _ in rows]
        self.last = list(range(len(rows)))
        bad = [bool(e or m) for e, m in zip(columns["is_error"], columns["is_missing"], strict=True)]
        self.void = [b or bool(x) for b, x in zip(bad, columns["is_extra"], strict=True)]
        self.bad_before = [0, *accumulate(bad)]
        self.under_bad = [False] * len(rows)
        for k, u in enumerate(self.up):
            if u >= 0:
                self.below[u].append(k)
                self.under_bad[k] = self.under_bad[u] or bad[u]
        for k in range(len(rows) - 1, -1, -1):
            if self.up[k] >= 0:
                self.last[self.up[k]] = max(self.last[self.up[k]], self.last[k])

    def child(self, k: int, field: str) -> int | None:
        return next((c for c in self.below[k] if self.field[c] == field), None)

    def named_below(self, k: int) -> list[int]:
        return [c for c in self.below[k] if self.named[c]]

    def invalid(self, k: int) -> bool:
        """Whether a node of k's tree or above it is an error or missing."""
        return self.under_bad[k] or self.bad_before[self.last[k] + 1] > self.bad_before[k]

    def callee(self, k: int) -> str:
        kind, found = self.kind[k], self.child(k, "function")
        found = self.child(k, "callee") if found is None else found
        if found is None and kind == "method_invocation":
            found = self.child(k, "name")
        if found is None and kind == "invocation":
            found = next(iter(self.named_below(k)), None)
        return "" if found is None else last_word(self.text[found] or "")

    def statement_order(self, features: Counter, statements: Sequence[int]) -> None:
        """All statements take a position; invalid ones, boundaries and transparent ones have no shape."""
        n = len(statements)
        for nth, k in enumerate(statements):
            shape = self.canonical[k] if self.named[k] else None
            if not self.void[k] and self.kind[k] not in self.boundaries and shape:
                place = "only" if n == 1 else "first" if nth == 0 else "last" if nth == n - 1 else "middle"
                features[f"ordered:statement:{place}:{shape}"] += 1

    def bag(self, root: int) -> tuple[Counter, int, list[str]]:
        """Features, number of visible nodes and digests of literals of the tree of ``root``."""
        features: Counter = Counter()
        tokens, digests, calls = 0, [], []
        work = [(root, None, None, "linear")]
        while work:
            k, parent, field, context = work.pop()
            kind = self.kind[k]
            if self.void[k]:
                continue
            if k != root and kind in self.boundaries:
                tokens += 1
                features["node:function:nested"] += 1
                if parent:
                    features[f"edge:{parent}>function:nested"] += 1
                continue
            if kind in S.SKIPPED:
                continue
            name = self.canonical[k]
            if name:
                tokens += 1
                features[f"node:{name}"] += 1
                if self.coarse[k]:
                    features[f"class:{self.coarse[k]}"] += 1
                if parent:
                    features[f"edge:{parent}>{name}"] += 1
                if field in S.ROLE:
                    features[f"role:{S.ROLE[field]}>{name}"] += 1
                elif parent == "expression:call" and name == "arguments":
                    features["role:arguments>arguments"] += 1
                if name.startswith("literal:"):
                    digests.append(hashlib.sha256(f"{name}\0{self.text[k] or ''}".encode()).hexdigest())
                if self.named[k] and name == "block":
                    own = self.named_below(k)
                    lone = len(own) == 1 and self.kind[own[0]] in ("statement_list", "statements")
                    self.statement_order(features, self.named_below(own[0]) if lone else own)
                if name == "operator:membership" and (not self.named[k] or kind == "keyword_in"):
                    features["semantic:membership"] += 2
            receives = kind == "method_invocation" and self.child(k, "object") is not None
            if receives:
                tokens += 1
                features.update(RECEIVER_LAYER)
            if kind in S.CALLS or name == "expression:call":
                callee = self.callee(k)
                if name == "expression:call" and callee:
                    calls.append((callee, context))
                if kind in S.CALLS and callee in S.OPERATION:
                    features[f"semantic:{S.OPERATION[callee]}"] += 2
            for c in reversed(self.below[k]):
                above, said = name or parent, self.field[c]
                if kind == "method_invocation" and said == "name" and not receives:
                    said = "function"
                elif receives and said in ("object", "name"):
                    above = "expression:member"
                inside = S.context_of(name if self.named[k] else None, self.field[c], context)
                work.append((c, above, said, inside))
        names = sorted({callee for callee, _ in calls})
        if 2 <= len(names) <= MOST_CALLEES:
            for callee, context in calls[:MOST_CALLS]:
                features[f"ordered:call:{context}:callee-slot-{names.index(callee)}"] += 1
        return features, tokens, digests

    def windows(self, function: int, size: int) -> Iterator[list[int]]:
        """Every ``size`` statements that follow one another in a container of a function, each span once."""
        body = self.child(function, "body")
        if body is None:
            body = next((c for c in reversed(self.named_below(function)) if self.kind[c] in CONTAINERS), None)
        if body is None:
            return
        seen: set[int] = set()
        spans: set[tuple[int, int]] = set()
        k = body
        while k <= self.last[body]:
            if k != body and self.kind[k] in self.boundaries:
                k = self.last[k] + 1
                continue
            if self.kind[k] in self.containers and self.named[k]:
                inner = k
                while len(own := self.named_below(inner)) == 1 and self.kind[own[0]] in self.containers:
                    inner = own[0]
                if inner not in seen:
                    seen.add(inner)
                    statements = [c for c in own if not self.void[c]]
                    for a in range(len(statements) - size + 1):
                        chosen = statements[a : a + size]
                        span = (self.span[chosen[0]][0], self.span[chosen[-1]][1])
                        if span not in spans:
                            spans.add(span)
                            yield chosen
            k += 1


def _unit(path: str, unit: str, **values) -> dict:
    return dict.fromkeys(_SCHEMA.names) | {"path": path, "unit": unit} | values


def file_units(path: str, rows: Sequence[tuple], boundaries: frozenset[str], scripts: frozenset[str], size: int = 0,
               most: int = 0, shell: bool = False) -> Iterator[dict]:
    """The units of one file; ``size`` 0: no blocks."""
    if rows[0][-1] is not None:
        yield _unit(path, "file", warning=rows[0][-1], total=1)
        return
    tree = Tree(rows, boundaries | scripts, shell)
    if tree.bad_before[-1]:
        yield _unit(path, "file", total=tree.bad_before[-1])
    made: dict[int, tuple[Counter, int, list[str]]] = {}

    def placed(unit: str, first: int, last: int, **values) -> dict:
        span = dict(zip(("start_byte", "end_byte", "start_line", "end_line"), tree.span[first], strict=True))
        span |= {"end_byte": tree.span[last][1], "end_line": tree.span[last][3]}
        ids = {"node_id": tree.node_id[first], "last_id": tree.node_id[tree.last[last]]}
        return _unit(path, unit, **ids, **span, node_kind=tree.kind[first], **values)

    def counted(features: Counter, tokens: int, digests: list[str]) -> dict:
        facts = {"token_count": tokens, "nested_count": features.get("node:function:nested", 0)}
        entries = sorted(features.items())
        own = hashlib.sha256("".join(f"{f}\x1f{n}\x1e" for f, n in entries).encode()).hexdigest()[:16]
        facts |= {"features": entries, "feature_count": sum(features.values()), "fingerprint": own}
        return facts | {"literal_digests": digests}

    for k, kind in enumerate(tree.kind):
        if kind not in tree.boundaries:
            continue
        name = tree.child(k, "name")
        said = {"said": tree.text[name] if name is not None else None}
        if tree.invalid(k):
            yield placed("fragment", k, k, invalid=True, **said)
            continue
        yield placed("fragment", k, k, invalid=False, **said, **counted(*tree.bag(k)))
        if not size or kind not in boundaries:
            continue
        chosen = []
        for window in tree.windows(k, size):
            chosen.append(window)
            if len(chosen) > most:
                break
        if len(chosen) > most:
            yield placed("left_out", k, k, **said)
            continue
        for window in chosen:
            features = Counter({"node:block": 1})
            tree.statement_order(features, window)
            tokens, digests = 1, []
            for s in window:
                if s not in made:
                    made[s] = tree.bag(s)
                features.update(made[s][0])
                tokens += made[s][1]
                digests += made[s][2]
            yield placed("block", window[0], window[-1], invalid=False, **counted(features, tokens, digests))
        made.clear()


def named_nodes(nodes: DataFrame, vocabulary: Mapping[str, str] | None = None) -> DataFrame:
    """Adds canonical name and coarse class to nodes, row by row."""
    named = S.canonical_named(F.col("kind"), F.col("text"), vocabulary)
    named = F.when(F.col("is_named"), named).otherwise(S.canonical_operator(F.col("kind")))
    return nodes.withColumn("canonical", named).withColumn("class", S.coarse_class(F.col("canonical")))


def streamed_units(nodes: DataFrame, boundaries: Sequence[str], scripts: Sequence[str] = (), size: int = 0, most: int = 0,
                   vocabulary: Mapping[str, str] | None = None, shell: bool = False) -> DataFrame:
    """``UNITS`` of nodes that come file after file in document order, as ``extract.extract_nodes`` gives them.

    With a column ``content_no`` a row without a node stands for a copy of the file with that number, which came before.
    """
    own, whole = frozenset(boundaries), frozenset(scripts)
    if "warning" not in nodes.columns:
        nodes = nodes.withColumn("warning", F.lit(None).cast("string"))
    named = named_nodes(nodes, vocabulary)
    number = F.col("content_no") if "content_no" in nodes.columns else F.lit(None).cast("long")

    def made(path: str, nth: int | None, file: list[tuple], kept: dict[int, list[dict]]) -> Iterator[dict]:
        if nth is not None and file[0][0] is None and file[0][-1] is None:
            for _ in file:
                yield from ({**unit, "path": path} for unit in kept[nth])
            return
        units = file_units(path, file, own, whole, size, most, shell)
        if nth is not None:
            units = kept[nth] = list(units)
            # No copy is told of a content that KEPT others came after.
            if len(kept) > KEPT:
                del kept[next(iter(kept))]
        yield from units

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[dict] = []
        kept: dict[int, list[dict]] = {}
        for (path, nth, _), file in groupby(rows, key=lambda r: (r[0], r[1], r[2] is None)):
            for unit in made(path, nth, [r[2:] for r in file], kept):
                held.append(unit)
                if len(held) == _ROWS:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    return named.select("path", number.alias("content_no"), *_NODE).mapInArrow(walk, UNITS)


def dealt_units(nodes: DataFrame, boundaries: Sequence[str], **options) -> DataFrame:
    """The same of any table of nodes, which is dealt by file and sorted first."""
    return streamed_units(nodes.repartition("path").sortWithinPartitions("path", "node_id"), boundaries, **options)


def unit_bags(units: DataFrame) -> DataFrame:
    """(fragment_id, feature, cnt) of units with an id."""
    return units.where("features is not null").select("fragment_id", F.explode("features").alias("feature", "cnt"))


def with_id(units: DataFrame) -> DataFrame:
    """Adds fragment_id: the path and the first node's id, of blocks the last one's too."""
    ends = [F.col("node_id").cast("string"), F.when(F.col("unit") == "block", F.col("last_id").cast("string"))]
    return units.withColumn("fragment_id", F.concat_ws("#", "path", F.concat_ws("-", *ends)))


def fragment_bags(nodes: DataFrame, boundaries: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """(bags, facts) of the valid fragments and blocks of any table of nodes: fragment_id, feature, cnt; and ``UNITS``."""
    units = with_id(dealt_units(nodes, boundaries, **options))
    return unit_bags(units), units.where("features is not null").drop("features")


def tree_ends(nodes: DataFrame) -> DataFrame:
    """(path, node_id, last_id) of every node: its tree are the nodes from itself to last_id in document order."""
    dealt = nodes.select("path", "node_id", "parent_id").repartition("path").sortWithinPartitions("path", "node_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for path, file in groupby(rows, key=lambda r: r[0]):
            held = [(node, up) for _, node, up in file]
            last = {node: node for node, _ in held}
            for node, up in reversed(held):
                if up in last:
                    last[up] = max(last[up], last[node])
            columns = [pa.array([path] * len(last), pa.string()), *(pa.array(list(x), pa.int64()) for x in (last, last.values()))]
            yield pa.record_batch(columns, names=["path", "node_id", "last_id"])

    return dealt.mapInArrow(number, "path string, node_id long, last_id long")
