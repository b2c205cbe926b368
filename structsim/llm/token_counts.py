"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over bytes. Each node that spells no piece has a failure link to the node that is left after the
longest pieces of its bytes are split off, and the number of these popped pieces is kept with the link. A text is read
once, byte by byte: where no edge goes on, the popped count is added and the link followed, so lengths come out in linear
time and no piece is ever built. A byte where no piece fits counts as one unknown token.

Texts are cut before every blank that no piece can hold behind its first byte, judged by the bytes beside the blank; a
chunk's count does not depend on its neighbours, so each worker keeps the counts of chunks it has met (up to
``CHUNKS_KEPT``).

Null and empty texts have no tokens. Rows are independent, so ties and repeated rows change nothing; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from structsim.llm.tokens import byte_letters, default_tokenizer
from structsim.llm.wordhash import range_hashes, text_slices

CHUNKS_KEPT = 1_000_000


class Automaton:
    """Edges, failure links and popped counts of a set of byte pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}]
        final = [False]
        # With every byte a piece of its own, an unknown byte is one token and no link is missing.
        for piece in [*pieces, *(bytes([b]) for b in range(256))]:
            at = 0
            for b in piece:
                if b not in edges[at]:
                    edges[at][b] = len(edges)
                    edges.append({})
                    final.append(False)
                at = edges[at][b]
            final[at] = at != 0
        self.edges, self.link, self.popped = edges, [0] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            below = []
            for at in level:
                for b, child in edges[at].items():
                    below.append(child)
                    if final[child]:
                        self.link[child], self.popped[child] = 0, 1
                        continue
                    back, popped = self.link[at], self.popped[at]
                    while b not in edges[back]:
                        popped += self.popped[back]
                        back = self.link[back]
                    self.link[child], self.popped[child] = edges[back][b], popped
            level = below

    def count(self, raw: bytes) -> int:
        """Tokens of the greedy longest match."""
        edges, link, popped = self.edges, self.link, self.popped
        total = at = 0
        for b in raw:
            while b not in edges[at]:
                total += popped[at]
                at = link[at]
            at = edges[at][b]
        while at:
            total += popped[at]
            at = link[at]
        return total


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes."""
    back = {letter: b for b, letter in byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(back[c] for c in piece) for piece in sorted(vocabulary, key=vocabulary.get) if all(c in back for c in piece)]


class Counter:
    """Counts of many texts, with the counts of known chunks kept by hash."""

    def __init__(self, path: str):
        pieces = byte_pieces(path)
        self.automaton = Automaton(pieces)
        #: Whether a blank between two bytes may stand inside a piece.
        self.held = np.zeros((256, 256), bool)
        for piece in pieces:
            for k in range(1, len(piece)):
                if piece[k] == 32:
                    self.held[piece[k - 1], piece[k + 1] if k + 1 < len(piece) else slice(None)] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count_slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of the rows data[offsets[k]:offsets[k + 1]]."""
        begins = data == 32
        if len(data):
            blanks = np.flatnonzero(begins)
            begins[blanks[self.held[data[blanks - 1], data[np.minimum(blanks + 1, len(data) - 1)]]]] = False
        begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        code, unique = pd.factorize(range_hashes(data, starts, ends))
        if len(self.keys) + len(unique) > CHUNKS_KEPT:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            example = np.zeros(len(unique), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            count = self.automaton.count
            made = np.array([count(raw[s:e]) for s, e in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)], np.int64)
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.counts = keys[order], np.concatenate([self.counts, made])[order]
            place = np.searchsorted(self.keys, unique)
        before = np.append(0, np.cumsum(self.counts[place][code]))[np.searchsorted(starts, offsets)]
        return np.diff(before)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_bytes, n_tokens (greedy longest match over a byte-level vocabulary file)."""
    path = vocabulary or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, 1):
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(np.diff(offsets)), pa.array(own.count_slice(data, offsets))], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
