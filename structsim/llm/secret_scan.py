"""Secrets in texts, also below nested encodings.

Three kinds, leftmost and non-overlapping per kind: ``assign`` (a credential word, a sign and a value of at least 8
characters), ``access`` (an access key id of at least 16 characters) and ``hex`` (at least 32 lower-case hex digits).

A worklist then unwraps layers until nothing new comes out: URL and Unicode escapes, base64 (either alphabet, with or
without padding) and, below any of them, gzip, zlib and bzip2 data with all their members. Base64 is read across line breaks
and at all four alignments, so that it is found behind path segments, prefixes and other words that share its alphabet. Of
the bytes that come out, every stretch of ASCII text is a layer, also as UTF-16 or UTF-32, whatever bytes stand beside it;
all patterns are ASCII, so none reaches beyond one. Each layer is scanned again, and its spans are mapped to the original
text: to the character for escapes, to the base64 characters for encoded text, to all of its base64 characters for
compressed data. A layer carries the places of its characters as arrays, so nesting costs no stack. Layers seen before are
not unwrapped again, which ends cycles, as of archives that inflate to themselves. Every layer is scanned, however deep
escapes are nested.

Compressed data is inflated in pieces of ``PIECE`` bytes that overlap by ``OVERLAP``, however long it gets. Only two kinds
of bombs are not unwrapped layer by layer to the end: a text whose layers inflate to more than ``MOST_INFLATED`` bytes in
all, and one whose layers of nested escapes come to more than ``MOST_ESCAPED`` characters in all and to more than
``MOST_NESTED`` times its own (so that nests up to that depth are told whole in any text). The rest of such a nest is
resolved in one pass, in linear time, and what comes out is scanned. Its ``complete`` is false, and the characters of what
is left count as a span when it is redacted.

Spans count code points, ends exclusive. Null text counts as empty and has no spans. Rows are independent, so repeated
rows, ties and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.wordhash import give_back
from structsim.llm.workspace import small_batches

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, MOST_INFLATED, MOST_ESCAPED, MOST_NESTED = 16_000_000, 1_000_000, 1_000_000_000, 4_000_000, 64
# The patterns of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

_URL, _UNICODE = r"%[0-9A-Fa-f]{2}", r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"
_ESCAPES = re.compile(rf"(?:{_URL})+|(?:{_UNICODE})+")
_LAST_ESCAPE = re.compile(rf"(?:{_URL}|{_UNICODE})\Z")
LEAST_RUN, LEAST_TEXT = 16, 14
_BREAK = re.compile(r"(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*")
_BASE64_RUN = re.compile(r"(?<![B])(?=[B]{16}|[B]++K[B])[B]++(?:K[B]++)*+={0,2}".replace("B", "A-Za-z0-9+/_-").replace("K", _BREAK.pattern))
#: What a text without any encoding lacks.
_ENCODED = re.compile(rf"{_URL}|{_UNICODE}|{_BASE64_RUN.pattern}")
_STANDARD = str.maketrans("-_", "+/")
_ASCII = rb"[\t-\r\x20-\x7e]"
#: Stretches of ``LEAST_TEXT`` characters or more (no secret is shorter), by the bytes of a character.
_STRETCHES = {width: re.compile(rb"(?:%s\x00{%d}){%d,}%s" % (_ASCII, width - 1, LEAST_TEXT - 1, _ASCII)) for width in (1, 2, 4)}
_PACKED = re.compile(rb"\x1f\x8b|x[\x01\x5e\x9c\xda]|BZh")

Span = tuple[str, int, int]


@dataclass
class Layer:
    """Text or bytes, and where each of its characters begins and ends in the original text; ``fixed``: all stand for one span."""

    content: str | bytes
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None
    fixed: tuple[int, int] | None = None

    def place(self, start: int, end: int) -> tuple[int, int]:
        return self.fixed or (int(self.begins[start]), int(self.ends[end - 1]))

    def below(self, content: str | bytes, begins: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer whose character k stands for the characters begins[k] to ends[k] of this one."""
        return Layer(content, fixed=self.fixed) if self.fixed else Layer(content, self.begins[begins], self.ends[ends - 1])

    def key(self) -> tuple:
        raw = self.content if isinstance(self.content, bytes) else self.content.encode("utf-8", "surrogatepass")
        return type(self.content), hashlib.blake2b(raw, digest_size=16).digest(), *self.place(0, len(self.content))


def direct_spans(text: str) -> list[Span]:
    """Spans of the three kinds as they stand in ``text``, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return _sorted(found)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _url_chars(escapes: str) -> list[tuple[str, int]]:
    raw = bytes.fromhex(escapes.replace("%", ""))
    return [(c, 3 * len(c.encode("utf-8", "surrogateescape"))) for c in raw.decode("utf-8", "surrogateescape")]


def _unicode_chars(escapes: str) -> list[tuple[str, int]]:
    units = [(int(m[1:], 16), len(m) + 1) for m in re.findall(r"[ux][0-9A-Fa-f]+", escapes)]
    out: list[tuple[str, int]] = []
    k = 0
    while k < len(units):
        code, width = units[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            code, width = 0x10000 + ((code - 0xD800) << 10) + units[k + 1][0] - 0xDC00, width + units[k + 1][1]
            k += 1
        out.append((chr(code), width))
        k += 1
    return out


def _chars(escapes: str) -> list[tuple[str, int]]:
    """The characters of a run of escapes of one kind, each with the length of its escapes."""
    return _url_chars(escapes) if escapes[0] == "%" else _unicode_chars(escapes)


def unescaped(layer: Layer) -> Layer | None:
    """The layer with all its escapes resolved once; None if it has none."""
    text, parts, begins, done = layer.content, [], [], 0
    for m in _ESCAPES.finditer(text):
        chars = _chars(m[0])
        parts += [text[done : m.start()], "".join(c for c, _ in chars)]
        begins += [np.arange(done, m.start()), m.start() + np.cumsum([0, *(w for _, w in chars)])[:-1]]
        done = m.end()
    if not done:
        return None
    start = np.concatenate([*begins, np.arange(done, len(text) + 1)])
    return layer.below("".join([*parts, text[done:]]), start[:-1], start[1:])


def escaped_bytes(layer: Layer) -> Layer | None:
    """The layer as bytes, its escapes of bytes resolved once, where compressed data begins in it; None elsewhere.

    Unicode escapes below 256 are a byte each; other characters are their UTF-8.
    """
    text, parts, begins, ends, done = layer.content, [], [], [], 0

    def plain(start: int, end: int) -> None:
        piece = text[start:end]
        parts.append(piece.encode("utf-8", "surrogatepass"))
        sizes = np.ones(len(piece), np.int64) if piece.isascii() else np.array([len(c.encode("utf-8", "surrogatepass")) for c in piece], np.int64)
        own = np.repeat(np.arange(start, end), sizes)
        begins.append(own)
        ends.append(own + 1)

    for m in _ESCAPES.finditer(text):
        plain(done, m.start())
        if m[0][0] == "%":
            raw = bytes.fromhex(m[0].replace("%", ""))
            own, width = m.start() + 3 * np.arange(len(raw)), np.full(len(raw), 3)
        else:
            codes = [(int(u[2:], 16), len(u)) for u in re.findall(r"\\[ux][0-9A-Fa-f]+", m[0])]
            chars = [bytes([c]) if c < 256 else chr(c).encode("utf-8", "surrogatepass") for c, _ in codes]
            raw, sizes = b"".join(chars), [len(c) for c in chars]
            starts = m.start() + np.cumsum([0, *(w for _, w in codes)])[:-1]
            own, width = np.repeat(starts, sizes), np.repeat([w for _, w in codes], sizes)
        parts.append(raw)
        begins.append(own)
        ends.append(own + width)
        done = m.end()
    plain(done, len(text))
    raw = b"".join(parts)
    return layer.below(raw, np.concatenate(begins), np.concatenate(ends)) if _PACKED.search(raw) else None


def fully_unescaped(layer: Layer) -> Layer:
    """The layer with its escapes, and those that come out of them, resolved until none is left.

    Characters go to a stack; when its end is an escape, that is replaced by its character. Bytes above ASCII, which no
    pattern has, stand for themselves.
    """
    text, out, begins, ends = layer.content, [], [], []
    at = 0
    while at < len(text):
        out.append(text[at])
        begins.append(at)
        at += 1
        ends.append(at)
        while out[-1] in "0123456789abcdefABCDEF" and (m := _LAST_ESCAPE.search("".join(out[-6:]))):
            n = len(m[0])
            out[-n:], begins[-n:], ends[-n:] = [chr(int(m[0].lstrip("%\\ux"), 16))], [begins[-n]], [at]
    return layer.below("".join(out), np.array(begins, np.int64), np.array(ends, np.int64))


def unpacked(raw: memoryview) -> Iterator[tuple[bytes, int]]:
    """What compressed data holds, in pieces, each with the number of bytes of ``raw`` read for it or, at an end, up to there.

    gzip and bzip2 members follow each other. Of data cut off, what comes before the cut is given; damage ends it.
    """
    at = 0
    while at < len(raw):
        head = bytes(raw[at : at + 3])
        if head[:2] == b"\x1f\x8b":
            packer = zlib.decompressobj(31)
        elif head == b"BZh":
            packer = bz2.BZ2Decompressor()
        elif head[:1] == b"x" and not at:
            packer = zlib.decompressobj()
        else:
            return
        feed: bytes | memoryview = raw[at:]
        try:
            while not packer.eof:
                piece = packer.decompress(feed, PIECE)
                feed = getattr(packer, "unconsumed_tail", b"")
                if piece:
                    yield piece, len(raw) - len(packer.unused_data)
                elif not packer.eof:
                    return
        except (zlib.error, OSError, ValueError, EOFError):
            return
        at = len(raw) - len(packer.unused_data)


def _stretches(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, its first byte, bytes of a character) of the stretches of text in ``raw``."""
    for width, pattern in _STRETCHES.items():
        if width == 1 or b"\x00" in raw:
            for m in pattern.finditer(raw):
                yield m[0][::width].decode("ascii"), m.start(), width


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """The bytes of each base64 run at each alignment."""
    for m in _BASE64_RUN.finditer(layer.content):
        run = m[0]
        breaks = [b.span() for b in _BREAK.finditer(run)]
        body = (_BREAK.sub("", run) if breaks else run).rstrip("=").translate(_STANDARD)
        if len(body) < LEAST_RUN:
            continue
        # Where lines begin in the body, and what the breaks before them take.
        begins, taken = [], [0]
        for start, end in breaks:
            begins.append(start - taken[-1])
            taken.append(taken[-1] + end - start)
        place = np.arange(len(body))
        place += m.start() + np.array(taken)[np.searchsorted(begins, place, side="right")]
        for turn in range(4):
            size = len(body) - turn
            size -= size % 4 == 1
            raw = binascii.a2b_base64(body[turn : turn + size] + "=" * (-size % 4))
            if not _PACKED.search(raw) and not any(p.search(raw) for w, p in _STRETCHES.items() if w == 1 or b"\x00" in raw):
                continue
            first = np.arange(len(raw))
            yield layer.below(raw, place[turn + first * 4 // 3], place[turn - (-(first + 1) * 4 // 3) - 1] + 1)


class Worklist:
    """The layers below a text that are still to be unwrapped; ``complete`` tells that all of them could be."""

    def __init__(self, text: str):
        self.spans: set[Span] = set()
        self.left: set[tuple[int, int]] = set()  # what was not unwrapped to the end
        self.room, self.escaped = MOST_INFLATED, max(MOST_ESCAPED, MOST_NESTED * len(text))
        places = np.arange(len(text) + 1)
        self.work = [Layer(text, places[:-1], places[1:])]
        self.seen = {self.work[0].key()}

    @property
    def complete(self) -> bool:
        return not self.left

    def add(self, layer: Layer) -> None:
        if layer.content and (key := layer.key()) not in self.seen:
            self.seen.add(key)
            if isinstance(layer.content, str):
                self.spans |= {(kind, *layer.place(s, e)) for kind, s, e in direct_spans(layer.content)}
            self.work.append(layer)

    def run(self) -> Worklist:
        while self.work:
            layer = self.work.pop()
            if isinstance(layer.content, bytes):
                self.unwrap_bytes(layer)
                continue
            if ("%" in layer.content or "\\" in layer.content) and (once := unescaped(layer)):
                self.escaped -= len(once.content)
                if self.escaped >= 0:
                    self.add(once)
                else:
                    places = np.arange(len(once.content) + 1)
                    rest = fully_unescaped(Layer(once.content, places[:-1], places[1:]))
                    nests = np.flatnonzero(rest.ends - rest.begins > 1)
                    self.left |= {once.place(int(rest.begins[k]), int(rest.ends[k])) for k in nests}
                    self.add(once.below(rest.content, rest.begins, rest.ends))
                if raw := escaped_bytes(layer):
                    self.inflate(raw)
            for raw in base64_layers(layer):
                self.add(raw)
        return self

    def unwrap_bytes(self, layer: Layer) -> None:
        raw = layer.content
        for text, first, width in _stretches(raw):
            begins = first + width * np.arange(len(text))
            self.add(layer.below(text, begins, begins + 1))
        self.inflate(layer)

    def inflate(self, layer: Layer) -> None:
        raw = layer.content
        for m in _PACKED.finditer(raw):
            packed, room, read = memoryview(raw)[m.start() :], self.room, 0
            for piece, read in unpacked(packed):
                room -= len(piece)
                if room < 0:
                    break
            if not read:
                continue
            here = layer.place(m.start(), m.start() + read)
            before = b""
            for piece, _ in unpacked(packed):
                self.room -= len(piece)
                if self.room < 0:
                    self.left.add(here)
                    break
                self.add(Layer(before + piece, fixed=here))
                before = piece[-OVERLAP:] if len(piece) == PIECE else b""


def scanned(text: str | None) -> tuple[list[Span], list[Span], set[tuple[int, int]]]:
    """(spans as they stand, all spans, places of what was not unwrapped to the end) of one text."""
    if not text:
        return [], [], set()
    base = direct_spans(text)
    if not _ENCODED.search(text):
        return base, base, set()
    done = Worklist(text).run()
    return base, _sorted(list({*base, *done.spans})), done.left


def secret_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(spans as they stand, all spans) of one text."""
    return scanned(text)[:2]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


SPAN_ROWS = "array<struct<kind:string,start:long,end:long,direct:boolean>>"
_PART = 256


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _PART):
            yield batch.slice(at, _PART)
        give_back()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, all its secret spans: array of (kind, start, end, direct: as it stands in the text), and complete."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("direct", pa.bool_())]))
        for part in _parts(batches):
            found, complete = [], []
            for text in part.column(1):
                base, every, left = scanned(text.as_py())
                own = set(base)
                found.append([{"kind": k, "start": s, "end": e, "direct": (k, s, e) in own} for k, s, e in every])
                complete.append(not left)
            yield pa.record_batch([part.column(0), pa.array(found, kinds), pa.array(complete)], names=["doc_id", "spans", "complete"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, spans {SPAN_ROWS}, complete boolean")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of direct spans by kind, base_sha256 over the direct spans, spans: all spans as text, complete."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "complete"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [scanned(t.as_py()) for t in part.column(1)]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _, _ in found], pa.int64()) for kind in KINDS]
            sums = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in found], pa.string())
            spans = pa.array([_joined(every) for _, every, _ in found], pa.string())
            yield pa.record_batch([part.column(0), *counts, sums, spans, pa.array([not left for _, _, left in found], pa.bool_())], names=names)

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, complete boolean"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``; so is what was not unwrapped to the end."""
    _, every, left = scanned(text)
    gone = sorted({*((s, e) for _, s, e in every), *left})
    if not gone:
        return text
    parts, done, k = [], 0, 0
    while k < len(gone):
        start, end = gone[k]
        while k < len(gone) and gone[k][0] <= end:
            end = max(end, gone[k][1])
            k += 1
        parts += [text[done:start], mark]
        done = end
    return "".join([*parts, text[done:]])


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced, other columns as they are, and n_chars, if there, counted anew."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at = part.schema.get_field_index("text")
            texts = pa.array([redacted(t.as_py(), mark) for t in part.column(at)], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), texts)

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(rows, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
