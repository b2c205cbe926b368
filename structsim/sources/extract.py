"""Files parsed into nodes, file after file in document order; a file that cannot be parsed gives a warning row.

Spans are byte offsets in the UTF-8 file. A file is one record, bounded by the size limit of discovery; its nodes are
handed on in slices, and files come in batches that are bounded by bytes.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NODES = (
    "path string, node_id long, parent_id long, child_idx int, kind string, is_named boolean, field string, text string, "
    "start_byte int, end_byte int, start_line int, end_line int, is_error boolean, is_missing boolean, is_extra boolean, "
    "warning string"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in NODES.split(", "))])
#: Distinct contents that a task keeps to tell copies by, the last ones, and characters of a content that is kept.
KEPT, KEPT_CHARACTERS = 256, 1 << 16
#: Bytes of files in a batch, but for a single larger one, and nodes that are handed on at a time.
BATCH_BYTES, SLICE = 4 << 20, 4096
# Kinds of Python's own syntax classes.
PYTHON_KINDS = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "Lambda": "lambda",
    "If": "if_statement", "IfExp": "conditional_expression", "For": "for_statement", "While": "while_statement",
    "Call": "call", "Return": "return_statement", "Raise": "raise_statement", "Try": "try_statement",
    "Break": "break_statement", "Continue": "continue_statement", "Assign": "assignment",
    "AugAssign": "augmented_assignment", "Name": "identifier", "Attribute": "member_expression",
    "Subscript": "subscript", "BinOp": "binary_operator", "BoolOp": "boolean_operator",
    "Compare": "comparison_operator", "UnaryOp": "unary_operator", "List": "list", "Tuple": "tuple",
    "Dict": "dictionary", "Set": "set", "arguments": "parameters", "arg": "parameter", "Match": "match_statement",
    "Await": "await",
}
# Fields of Python's syntax classes, and lists of statements, which are a block each but in a module.
_FIELDS = {
    "func": "function", "args": "arguments", "test": "condition", "body": "body", "orelse": "alternative", "left": "left",
    "right": "right", "value": "value", "slice": "index",
}
_BLOCKS = {"body": "body", "orelse": "alternative", "finalbody": "finalbody"}
_TOKENS = {
    "Add": "+", "Sub": "-", "Mult": "*", "Div": "/", "FloorDiv": "//", "Mod": "%", "Pow": "**", "BitAnd": "&",
    "BitOr": "|", "BitXor": "^", "LShift": "<<", "RShift": ">>", "And": "and", "Or": "or", "Not": "not", "Eq": "==",
    "NotEq": "!=", "Lt": "<", "LtE": "<=", "Gt": ">", "GtE": ">=", "In": "in", "NotIn": "not in", "Is": "is",
    "IsNot": "is not", "UAdd": "+", "USub": "-", "Invert": "~",
}
_UNSEEN = (ast.expr_context,)
_OPERATORS = (ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
_WITH_TEXT = ("identifier", "member_expression", "number", "string", "boolean", "none")


def _constant(node: ast.Constant) -> str:
    return "none" if node.value is None else "boolean" if isinstance(node.value, bool) else "string" if isinstance(node.value, (str, bytes)) else "number"


def _line_starts(source: bytes) -> list[int]:
    """Where each line begins, and the end."""
    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    return starts


class _Block:
    """A list of statements."""

    def __init__(self, statements: list[ast.stmt]):
        self.statements = statements


def _below(node: ast.AST | _Block | str) -> list[tuple]:
    """What a node holds, in order, with fields: nodes, blocks, names, and operators as tokens."""
    if isinstance(node, _Block):
        return [(s, None) for s in node.statements]
    if isinstance(node, str) or isinstance(node, _OPERATORS):
        return []
    out: list[tuple] = [(node.name, "name")] if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else []
    for name, value in ast.iter_fields(node):
        found = value if isinstance(value, list) else [value]
        if name in _BLOCKS and not isinstance(node, ast.Module) and found and all(isinstance(c, ast.stmt) for c in found):
            branch = "consequence" if isinstance(node, ast.If) and name == "body" else _BLOCKS[name]
            out.append((_Block(found), branch))
        else:
            out += [(c, _FIELDS.get(name)) for c in found if isinstance(c, ast.AST) and not isinstance(c, _UNSEEN)]
    return out


def python_nodes(path: str, source: str) -> Iterator[tuple]:
    """Node rows of one Python source, parents before children."""
    raw = source.encode()
    starts = _line_starts(raw)
    whole = (0, len(raw), 1, max(1, len(starts) - 1))

    def span_of(first: ast.AST, last: ast.AST) -> tuple[int, int, int, int]:
        begin = starts[first.lineno - 1] + first.col_offset
        return begin, starts[last.end_lineno - 1] + last.end_col_offset, first.lineno, last.end_lineno

    here = 0
    work: list[tuple] = [(ast.parse(source), None, 0, None, whole)]
    while work:
        node, up, k, field, span = work.pop()
        named, text = True, ""
        if isinstance(node, str):
            kind, text = "identifier", node
        elif isinstance(node, _Block):
            kind, span = "block", span_of(node.statements[0], node.statements[-1])
        elif isinstance(node, _OPERATORS):
            kind, named = _TOKENS.get(type(node).__name__, type(node).__name__.lower()), False
        else:
            own = type(node).__name__
            kind = _constant(node) if isinstance(node, ast.Constant) else PYTHON_KINDS.get(own, own.lower())
            span = span_of(node, node) if hasattr(node, "lineno") else span
            text = raw[span[0] : span[1]].decode(errors="replace") if kind in _WITH_TEXT else ""
        yield path, here, up, k, kind, named, field, text, *span, False, False, False, None
        work += [(child, here, n, name, span) for n, (child, name) in enumerate(_below(node))][::-1]
        here += 1


def line_nodes(path: str, source: str) -> Iterator[tuple]:
    """A plain text as a document with a node per line. A line is neither a name nor a literal, so its text is told by its span."""
    lines = source.split("\n")
    sizes = [len(line.encode()) for line in lines]
    end = sum(sizes) + len(lines) - 1
    yield path, 0, None, 0, "document", True, None, "", 0, end, 1, len(lines), False, False, False, None
    at = 0
    for k, size in enumerate(sizes):
        yield path, k + 1, 0, k, "line", True, None, "", at, at + size, k + 1, k + 1, False, False, False, None
        at += size + 1


Reader = Callable[[str, str], Iterator[tuple]]
EXTRACTORS: dict[str, Reader] = {"python": python_nodes, "text": line_nodes}


def extract_nodes(files: DataFrame, extractor: str | Reader = "python", copies: bool = False) -> DataFrame:
    """The nodes of files (path, content); rows with a ``warning`` stand for files that could not be parsed.

    ``extractor``: a name, or a function from path and text to node rows. With ``copies`` there is a column ``content_no``,
    the number of a file's content among its task's distinct ones, and a file whose content is one of the last ``KEPT``
    gives one row without a node instead. Long contents have no number, nor do those of a function, which may look at paths.
    """
    read = EXTRACTORS[extractor] if isinstance(extractor, str) else extractor
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    told = copies and isinstance(extractor, str)
    schema = _SCHEMA.append(pa.field("content_no", pa.int64())) if copies else _SCHEMA

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        known: dict[bytes, int] = {}
        number = 0
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = content or ""
                key = hashlib.sha256(content.encode()).digest() if told and len(content) <= KEPT_CHARACTERS else None
                own = known.get(key)
                if own is not None:
                    rows = [(path, *[None] * (len(_SCHEMA) - 1))]
                else:
                    if key is not None:
                        known[key] = own = number
                        number += 1
                        if len(known) > KEPT:
                            del known[next(iter(known))]
                    try:
                        # a file that fails half way gives none of its nodes
                        rows = list(read(path, content))
                    except (SyntaxError, ValueError, RecursionError) as e:
                        rows = [(path, *[None] * (len(_SCHEMA) - 2), f"{type(e).__name__}: {e}")]
                for row in rows:
                    held.append((*row, own) if copies else row)
                    if len(held) == SLICE:
                        yield _batch(held, schema)
                        held = []
        if held:
            yield _batch(held, schema)

    return files.select("path", "content").mapInArrow(parse, f"{NODES}, content_no long" if copies else NODES)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
