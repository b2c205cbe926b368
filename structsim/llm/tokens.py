"""Token ids of whole texts by a public tokenizer file, as arrays of unsigned 32-bit ids.

Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens one after the other, and a
single blank always begins one unless whitespace stands on both sides of it. Each worker keeps the ids of the chunks
between such blanks by hash (up to a fixed number); only chunks that it has not met reach the tokenizer, many at a time.
Texts with other blanks (doubled, at the end, amid whitespace of any script) or with an added token go to the tokenizer
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from tokenizers import Tokenizer, pre_tokenizers

from structsim.llm.wordhash import gathered, range_hashes, text_slices

END_ID = 2
CHUNKS_KEPT = 1_000_000
# Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# Bytes of the whitespace characters (and the ASCII separators, which cost nothing but time).
_ASCII_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE_SPACE = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def amid_whitespace(data: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """Those of the blanks at the given places that have whitespace on both sides."""
    wide = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])

    def spaces(at: np.ndarray, near: int, two: int, three: int) -> np.ndarray:
        """Whether whitespace stands beside: its byte next to the blank, and where its two or three bytes begin."""
        at = at + 3
        found = _ASCII_SPACE[wide[at + near]]
        odd = np.flatnonzero(wide[at + near] >= 0x80)
        pair = (wide[at[odd] + two].astype(np.int64) << 8) | wide[at[odd] + two + 1]
        triple = (wide[at[odd] + three].astype(np.int64) << 16) | (wide[at[odd] + three + 1].astype(np.int64) << 8) | wide[at[odd] + three + 2]
        found[odd] = np.isin(pair, _WIDE_SPACE) | np.isin(triple, _WIDE_SPACE)
        return found

    after = blanks[spaces(blanks, 1, 1, 1)]
    return after[spaces(after, -1, -2, -3)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.pieces = Tokenizer(self.whole.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # 0xFF is in no UTF-8 text; it parts the pieces.
        self.letters = byte_letters() | {255: " "}
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.widths[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        """The tokenizer's own ids of one text."""
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _added_at(self, raw: bytes) -> np.ndarray:
        """Where added tokens begin."""
        out = []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                out.append(at)
                at = raw.find(token, at + 1)
        return np.array(out, np.int64)

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        raw = [p.encode() for p in pieces]
        groups = [b"\xff".join(raw[k : k + 256]).decode("latin-1").translate(self.letters) for k in range(0, len(raw), 256)]
        ids = np.array([i for e in self.pieces.encode_batch_fast(groups, add_special_tokens=False) for i in e.ids], np.int64)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(b) for b in raw])) + 1
        return ids.astype(np.uint32), np.diff(ends, prepend=0)

    def _learn(self, keys: np.ndarray, chunks: list[bytes], widest: np.ndarray) -> None:
        """Adds the ids of new chunks. Blank-led chunks of Latin letters go in bulk; others by the tokenizer one by one."""
        texts = [c.decode() for c in chunks]
        bulk = [k for k, (t, w) in enumerate(zip(texts, widest.tolist(), strict=True)) if w < 0xCA and t[0] == " " and len(t) > 1 and not t[1].isspace() and not t[-1].isspace()]
        rest = sorted({*range(len(texts))}.difference(bulk))
        pieces = PRE_TOKEN.findall("".join([texts[k] for k in bulk]))
        known = dict.fromkeys(pieces)
        flat, count = self._piece_ids(list(known)) if known else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        for k, p in enumerate(known):
            known[p] = k
        code = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        ids = gathered(flat, (np.cumsum(count) - count)[code], count[code])
        per_chunk = np.add.reduceat(count[code], first) if len(first) else np.zeros(0, np.int64)
        others = [self.plain(texts[k]) for k in rest]
        new_keys, new_count = keys[bulk + rest], np.concatenate([per_chunk, np.array([len(x) for x in others], np.int64)])
        new_at = len(self.flat) + np.cumsum(new_count) - new_count
        self.flat = np.concatenate([self.flat, ids, *others])
        merged = np.concatenate([self.keys, new_keys])
        order = np.argsort(merged, kind="stable")
        self.keys, self.at, self.count = merged[order], np.concatenate([self.at, new_at])[order], np.concatenate([self.count, new_count])[order]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows data[offsets[k]:offsets[k + 1]], one after the other, and how many each has."""
        rows = len(offsets) - 1
        blank = data == 32
        double = np.zeros(len(data) + 1, np.int64)
        if len(data):
            np.cumsum(np.append(blank[:-1] & blank[1:], blank[-1]), out=double[1:])
        filled = offsets[1:] > offsets[:-1]
        ends_blank = filled & blank[np.maximum(offsets[1:] - 1, 0)] if len(data) else np.zeros(rows, bool)
        whole = (double[offsets[1:]] > double[offsets[:-1]]) | ends_blank
        odd = [amid_whitespace(data, np.flatnonzero(blank)), self._added_at(data.tobytes())]
        whole[np.searchsorted(offsets, np.concatenate(odd), side="right") - 1] = True
        slow = np.flatnonzero(whole)
        begins = blank.copy()
        begins[offsets[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        code, unique = pd.factorize(range_hashes(data, starts, ends))
        if len(self.keys) + len(unique) > CHUNKS_KEPT:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            example = np.zeros(len(unique), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            example = example[new]
            widest = np.maximum.reduceat(data, starts)[example]
            raw = data.tobytes()
            self._learn(unique[new], [raw[s:e] for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)], widest)
            place = np.searchsorted(self.keys, unique)
        place = place[code]
        count = self.count[place]
        ids = gathered(self.flat, self.at[place], count)
        before = np.append(0, np.cumsum(count))[np.searchsorted(starts, offsets)]
        if not len(slow):
            return ids, np.diff(before)
        raw, parts, done = data.tobytes(), [], 0
        lengths = np.diff(before)
        for k in slow.tolist():
            own = self.plain(raw[offsets[k] : offsets[k + 1]].decode())
            parts += [ids[before[done] : before[k]], own]
            lengths[k], done = len(own), k + 1
        return np.concatenate([*parts, ids[before[done] :]]), lengths


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded_slices(batch: pa.RecordBatch, column: int, path: str, end_id: int | None = END_ID) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids of these rows, ends of the rows in them); every row ends with ``end_id``, null counts as empty."""
    enc = encoder(path)
    for at, to, data, offsets in text_slices(batch, column):
        ids, lengths = enc.encode_slice(data, offsets)
        ends = np.cumsum(lengths)
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        yield at, to, ids.astype("<u4", copy=False), ends
