"""Chat formatting of records in mixed layouts.

A record is a JSON object. Its nested field paths (array items as ``[]``) are sorted and hashed; the hash selects a
declarative mapping that says where the turns are: a list of messages with a role field and a text field, or single
fields that stand for one turn each. Layouts are data: ``LAYOUTS`` lists the known ones and callers can add their own.
Paths that a layout calls optional do not count for its fingerprint. Records of an unknown layout give no turns;
``unknown_records`` lists them with their fingerprint for review.

Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<``, any number of backslashes
and ``|`` get one backslash more, so no text can hold a control string and unescaping takes that one away again; a
role's line breaks and backslashes are escaped as well. The loss mask is the list of spans (code points of the formatted
text, ends exclusive) of the assistant's texts.

Null roles and texts count as empty, and a role of null is not the assistant. A conversation's turns go by turn number,
nulls first, ties by role, then text; repeated rows stay repeated turns. Rows with null conv_id are one conversation.
Extra columns are not read. A conversation is one record of the output, so its turns meet in one row.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are. ``messages``: path of a list; ``role`` and ``text``: its fields (or the record's own
    if there is no list); ``single``: (role, path) of fields that are turns, in order; ``roles``: other names of roles."""

    name: str
    messages: str = ""
    role: str = ""
    text: str = ""
    single: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        own = {path for _, path in self.single} - set(self.optional)
        if self.role:
            own |= {f"{self.messages}[].{f}" for f in (self.role, self.text)} if self.messages else {self.role, self.text}
        return own


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn row", role="role", text="text", optional=("conv_id", "turn")),
    Layout("messages", messages="messages", role="role", text="content", optional=("conv_id", "id"), roles=_NAMES),
    Layout("conversations", messages="conversations", role="from", text="value", optional=("conv_id", "id"), roles=_NAMES),
    Layout("dialogue", messages="data.turns", role="speaker", text="text", optional=("conv_id", "id"), roles=_NAMES),
    Layout("instruction", single=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("conv_id", "id", "system", "input")),
    Layout("prompt", single=(("user", "prompt"), ("assistant", "completion")), optional=("conv_id", "id")),
    Layout("question", single=(("user", "question"), ("assistant", "answer")), optional=("conv_id", "id")),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def record_paths(value: object, at: str = "") -> set[str]:
    """The paths of a record's scalar fields; an empty list or object counts as a path of its own."""
    if isinstance(value, dict) and value:
        return set().union(*(record_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(record_paths(v, f"{at}[]") for v in value))
    return {at}


def by_fingerprint(layouts: Iterable[Layout]) -> tuple[dict[str, Layout], set[str]]:
    """Layouts by fingerprint, and the paths that are optional in any of them."""
    layouts = tuple(layouts)
    return {fingerprint(x.paths()): x for x in layouts}, {p for x in layouts for p in x.optional}


def _at(value: object, path: str) -> object:
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def mapped(record: object, layout: Layout) -> list[tuple[str, str]]:
    """The turns of a record of this layout."""
    if layout.single:
        return [(role, _text(_at(record, path))) for role, path in layout.single if path not in layout.optional or _at(record, path)]
    items = _at(record, layout.messages) if layout.messages else [record]
    return [(layout.roles.get(_text(m.get(layout.role)), _text(m.get(layout.role))), _text(m.get(layout.text))) for m in items]


def canonical(record: str | None, known: dict[str, Layout], optional: set[str]) -> tuple[str | None, list[tuple[str, str]]]:
    """(fingerprint, turns) of a JSON record; broken JSON has neither."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None, []
    if not isinstance(value, dict):
        return None, []
    paths = record_paths(value)
    for kept in (paths - optional, paths):
        key = fingerprint(kept)
        if key in known:
            return key, mapped(value, known[key])
    return fingerprint(paths - optional), []


def canonical_turns(records: DataFrame, column: str = "record", layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint`` and ``turns`` (array of role, text) of the JSON objects in ``column``."""
    known, optional = by_fingerprint(layouts)

    def read(column: pd.Series) -> pd.DataFrame:
        got = [canonical(r, known, optional) for r in column]
        return pd.DataFrame({"fingerprint": [k for k, _ in got], "turns": [[{"role": r, "text": t} for r, t in turns] for _, turns in got]})

    made = F.pandas_udf(read, f"struct<fingerprint:string,turns:{TURNS}>")(column)
    return records.withColumn("_made", made).select(*records.columns, "_made.fingerprint", "_made.turns")


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, STOP, "\n"]
        at += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        out.append((_unescape_role(role), unescape(rest[: -len(STOP) - 1])))
    return out


def format_conversations(rows: DataFrame, layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """Formats records (conv_id, turn, record): conv_id, formatted, loss_spans (array of start, end).

    A record may hold one turn or a whole conversation; a conversation's records go by ``turn``. Records of an unknown layout
    are no part of it; ``unknown_records`` has them.
    """
    turns = canonical_turns(rows.select("conv_id", "turn", "record"), "record", layouts)
    one = turns.select("conv_id", "turn", F.posexplode("turns").alias("pos", "t")).select("conv_id", F.struct("turn", "pos", "t.role", "t.text").alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def write(conversations: pd.Series) -> pd.DataFrame:
        made = [format_turns((t["role"], t["text"]) for t in turns) for turns in conversations]
        return pd.DataFrame({"formatted": [text for text, _ in made], "loss_spans": [[{"start": s, "end": e} for s, e in spans] for _, spans in made]})

    out = F.pandas_udf(write, "struct<formatted:string,loss_spans:array<struct<start:long,end:long>>>")("turns")
    return whole.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def unknown_records(rows: DataFrame, layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, record, fingerprint) of the records whose layout is not known, for review; they have no turns."""
    known, _ = by_fingerprint(layouts)
    turns = canonical_turns(rows.select("conv_id", "turn", "record"), "record", layouts)
    return turns.where(~F.coalesce(F.col("fingerprint").isin(*known), F.lit(False))).drop("turns")


def turn_records(conversations: DataFrame) -> DataFrame:
    """A table with a row per turn (conv_id, turn, role, text) as records."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return conversations.select("conv_id", "turn", F.to_json(F.struct(empty("role"), empty("text"))).alias("record"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What reads back from formatted conversations; see the query of this operator."""

    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, loss in zip(texts, spans, strict=True):
            turns = read_turns(text)
            said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = F.pandas_udf(read, "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>")("formatted", "loss_spans")
    return formatted.select("conv_id", made.alias("d")).select("conv_id", "d.*")
