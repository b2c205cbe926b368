"""Benchmark items inside training documents: BM25 retrieval by block-max WAND, then overlap of question and answer.

Items are indexed by their words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased) with BM25 impacts that are
divided by the item's own score, so an item's score runs up to 1 for a passage that holds all its words. Postings go by
blocks of ``BLOCK`` items, each with its largest impact per term.

Every document is cut into overlapping passages, twice as long as a copy of the longest item may be (so each copy lies
within one), and every passage is a query. For a batch of passages the block maxima are summed first; a block whose sum
stays below the threshold is skipped whole. In the blocks left, WAND moves to the pivot item, the first whose terms'
largest impacts reach the threshold, and scores only such items. All items at or above the threshold are retrieved.

A retrieved item counts as contained when at least ``OVERLAP`` of its question's and of its answer's 5-word shingles are
in the whole document. The answer is what follows "answer:", else what follows the first question mark; a part of under
five words is one shingle. An item with neither mark is one part, and counts as contained also when it differs from some
stretch of the document in at most 1 - ``OVERLAP`` of its words (changed, left out or put in), as one edit alone breaks
five shingles; both overlaps are then the larger of the two shares.

Broadcast are the items alone, in shards of up to ``SHARD_BYTES`` of text, whose index takes about 15 times as much memory;
larger benchmarks are searched shard by shard. Number and mean length of items and in how many of them a word occurs are
counted over the whole benchmark, so that scores do not depend on the shards. Null or wordless texts and items match nothing. Repeated rows are found each on their
own; repeated item rows are one item (the least text of an item_id counts). Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.wordhash import chain, range_hashes, text_slices
from structsim.llm.workspace import new_folder, small_batches, written

LEAST_SCORE, OVERLAP, SHINGLE = 0.6, 0.8, 5
K1, B = 1.2, 0.75
BLOCK, FREQUENT = 4, 256
SHARD_BYTES = 8_000_000
_CELLS = 4_000_000
FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, and the number of words before each row."""
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _LETTERS[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges], stops[edges - 1] = inside[edges + 1], inside[edges]
    starts = np.flatnonzero(begins)
    return range_hashes(data, starts, np.flatnonzero(stops) + 1), np.searchsorted(starts, offsets)


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    h, before = letter_words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [h[a:b] for a, b in zip(before[:-1], before[1:], strict=True)]


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a word sequence; of a shorter one the whole."""
    if len(h) >= n:
        return np.unique(chain(*(h[k : len(h) - n + 1 + k] for k in range(n))))
    return chain(*(h[k : k + 1] for k in range(len(h)))) if len(h) else h


def marked_parts(text: str) -> tuple[str, str] | None:
    """Question and answer of an item by its marks; None without any."""
    for cut in (re.search(r"\banswer\s*:\s*", text, re.I), re.search(r"\?\s*", text)):
        if cut and text[: cut.start()].strip() and text[cut.end() :].strip():
            return text[: cut.end()], text[cut.end() :]
    return None


def alike(item: np.ndarray, doc: np.ndarray) -> float:
    """1 less the fewest word edits, as a share of the item, that make the item a stretch of the document."""
    steps = np.arange(len(doc) + 1)
    cost = np.zeros(len(doc) + 1, np.int64)
    for word in item:
        change = cost + 1
        change[1:] = np.minimum(change[1:], cost[:-1] + (doc != word))
        cost = np.minimum.accumulate(change - steps) + steps
    return 1 - int(cost.min()) / len(item)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item; without marks, which containment does not ask for, two thirds and the rest."""
    if parts := marked_parts(text):
        return parts
    found = list(re.finditer(r"\S+", text))
    at = found[-max(1, len(found) // 3)].start() if found else 0
    return text[:at], text[at:]


@dataclass(frozen=True)
class Statistics:
    """Of all items: how many have words, their mean number of words, and how many hold each of the sorted ``terms``."""

    items: int
    mean: float
    terms: np.ndarray
    have: np.ndarray


class Index:
    """The BM25 index of some items; ``statistics`` are those of the whole benchmark if these are only a part of it."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        words = hashed_words([t for _, t in items])
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids = [items[k][0] for k in keep]
        if not keep:
            return
        words = [words[k] for k in keep]
        marked = [marked_parts(items[k][1]) for k in keep]
        parts = [m or (items[k][1], items[k][1]) for k, m in zip(keep, marked, strict=True)]
        #: The words of items that are one part.
        self.whole = [None if m else w for m, w in zip(marked, words, strict=True)]
        # Each part's shingles and how many words they have.
        cut = [[(shingles(w), min(SHINGLE, len(w))) for w in hashed_words([p[i] for p in parts])] for i in (0, 1)]
        self.questions, self.answers = cut[0], [q if m is None else a for q, a, m in zip(*cut, marked, strict=True)]
        self.stride = max([32, *(-(-5 * len(w) // 4) for w in words)])
        n = len(words)
        self.blocks = -(-n // BLOCK)
        lengths = np.array([len(w) for w in words])
        item = np.repeat(np.arange(n), lengths)
        self.terms, term = np.unique(np.concatenate(words), return_inverse=True)
        pair, times = np.unique(term * n + item, return_counts=True)
        term_of, item_of = pair // n, pair % n
        have = np.bincount(term_of, minlength=len(self.terms))
        total, mean, holding = n, lengths.mean(), have
        if statistics:
            total, mean = statistics.items, statistics.mean
            holding = statistics.have[np.searchsorted(statistics.terms, self.terms)]
        idf = np.log1p((total - holding + 0.5) / (holding + 0.5))
        impact = idf[term_of] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths[item_of] / mean))
        impact /= np.bincount(item_of, impact, n)[item_of]
        # Postings by block, then term: the items of each (block, term) cell are a run of ascending numbers.
        cell = item_of // BLOCK * len(self.terms) + term_of
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        self.run_begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.run_cell = cell[self.run_begin]
        self.run_begin = np.append(self.run_begin, len(cell))
        self.run_item, self.run_impact = item_of[order].astype(np.int32), impact[order]
        # Block maxima: a row per term and block that has any; the most frequent terms as a dense matrix.
        cell = term_of * self.blocks + item_of // BLOCK
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        most = np.maximum.reduceat(impact, first)
        max_term, self.max_block, self.max_impact = cell[first] // self.blocks, (cell[first] % self.blocks).astype(np.int32), most
        self.max_begin = np.searchsorted(max_term, np.arange(len(self.terms) + 1))
        frequent = np.argsort(-have, kind="stable")[:FREQUENT]
        self.dense_of = np.full(len(self.terms), -1)
        self.dense_of[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks), np.float32)
        in_dense = self.dense_of[max_term] >= 0
        self.dense[self.dense_of[max_term[in_dense]], self.max_block[in_dense]] = most[in_dense]

    def bounds(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Sums of block maxima, passages by blocks, from distinct (passage, term) pairs."""
        dense = self.dense_of[term]
        here = np.zeros((n, len(self.dense)), np.float32)
        here[passage[dense >= 0], dense[dense >= 0]] = 1
        total = here @ self.dense
        passage, term = passage[dense < 0], term[dense < 0]
        count = self.max_begin[term + 1] - self.max_begin[term]
        at = np.repeat(self.max_begin[term] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        total += np.bincount(np.repeat(passage, count) * self.blocks + self.max_block[at], self.max_impact[at], n * self.blocks).reshape(n, -1)
        return total

    def wand(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """Items of a block that reach ``least`` for the given terms."""
        cells = block * len(self.terms) + terms
        at = np.minimum(np.searchsorted(self.run_cell, cells), len(self.run_cell) - 1)
        lists = []  # item at the cursor, cursor, items, impacts, largest impact
        for k in at[self.run_cell[at] == cells].tolist():
            run = slice(self.run_begin[k], self.run_begin[k + 1])
            items, impacts = self.run_item[run].tolist(), self.run_impact[run].tolist()
            lists.append([items[0], 0, items, impacts, max(impacts)])
        out = []
        while lists:
            lists.sort(key=itemgetter(0))
            reach, pivot = 0.0, None
            for cursor in lists:
                reach += cursor[4]
                if reach >= least - 1e-9:
                    pivot = cursor[0]
                    break
            if pivot is None:
                break
            score = 0.0
            for cursor in lists:
                if cursor[0] > pivot:
                    break
                items, at = cursor[2], cursor[1]
                while at < len(items) and items[at] < pivot:
                    at += 1
                if at < len(items) and items[at] == pivot:
                    score += cursor[3][at]
                    at += 1
                cursor[1], cursor[0] = at, items[at] if at < len(items) else -1
            lists = [c for c in lists if c[0] >= 0]
            if score >= least - 1e-9:
                out.append((pivot, score))
        return out

    def retrieve(self, h: np.ndarray, before: np.ndarray, least: float) -> dict[tuple[int, int], float]:
        """(row, item) -> best score over the row's passages."""
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == h)
        term = place[known]
        count = np.diff(before)
        passages = np.maximum(-(-count // self.stride) - 1, 1)
        base = np.cumsum(passages) - passages
        row = np.searchsorted(before, known, side="right") - 1
        step = (known - before[row]) // self.stride
        last = np.minimum(step, passages[row] - 1)
        both = np.concatenate([base[row] + last, (base[row] + step - 1)[(step > 0) & (step - 1 < last)]])
        pair = np.sort(both * len(self.terms) + np.concatenate([term, term[(step > 0) & (step - 1 < last)]]))
        pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
        passage, term = pair // len(self.terms), pair % len(self.terms)
        owner = np.repeat(np.arange(len(count)), passages)
        out: dict[tuple[int, int], float] = {}
        most = max(1, _CELLS // max(self.blocks, len(self.dense), 1))
        for at in range(0, len(owner), most):
            a, b = np.searchsorted(passage, [at, at + most])
            own, its = passage[a:b] - at, term[a:b]
            bound = self.bounds(own, its, min(most, len(owner) - at))
            for p, block in zip(*np.nonzero(bound >= least - 1e-5), strict=True):
                x, y = np.searchsorted(own, [p, p + 1])
                for item, score in self.wand(its[x:y], int(block), least):
                    key = (int(owner[at + p]), item)
                    out[key] = max(score, out.get(key, 0.0))
        return out


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, term, null) for each different word of an item, and (item_id, null, number of words)."""
    for batch in batches:
        for at, to, data, offsets in text_slices(batch, 1):
            h, before = letter_words(data, offsets)
            for k, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                if b > a:
                    own = np.unique(h[a:b]).view(np.int64)
                    item = batch.column(0).slice(at + k, 1).cast(pa.int64()).take(pa.array(np.zeros(len(own) + 1, np.int64)))
                    term = pa.concat_arrays([pa.array(own), pa.nulls(1, pa.int64())])
                    length = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array([b - a], pa.int64())])
                    yield pa.record_batch([item, term, length], names=["item_id", "term", "length"])


def _shards(benchmark: DataFrame, most: int) -> Iterator[Index]:
    """Indexes of shards of up to ``most`` characters; one shard at a time is in the driver, with counts of its words."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= most:
        yield Index(sorted((r["item_id"], r["text"]) for r in items.collect()))
        return
    n = -(-2 * size // most)
    folder = new_folder(benchmark.sparkSession, "decontaminate")
    words = written(items.select("item_id", "text").mapInArrow(_term_batches, "item_id long, term long, length long"), folder, "words")
    total, mean = words.agg(F.count("length"), F.avg("length")).first()
    have = written(words.where("term is not null").groupBy("term").agg(F.count("*").alias("have")), folder, "have")
    for k in range(n):
        here = F.pmod(F.xxhash64(F.col("item_id").cast("long")), F.lit(n)) == k
        own = words.where(here & F.col("term").isNotNull()).select("term").distinct().join(have, "term").toPandas()
        terms = own["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        counts = Statistics(total, float(mean or 0), terms[order], own["have"].to_numpy(np.int64)[order])
        yield Index(sorted((r["item_id"], r["text"]) for r in items.where(here).collect()), counts)


def find_items(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text) and item (item_id, text) that it contains: doc_id, item_id, score, question_overlap, answer_overlap."""
    small_batches(docs.sparkSession)
    out = None
    for index in _shards(benchmark, shard_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = docs.select("doc_id", "text").mapInArrow(lambda it, shared=shared: _found(it, shared.value, least, overlap), FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def _found(batches: Iterator[pa.RecordBatch], index: Index, least: float, overlap: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, data, offsets in text_slices(batch, 1):
            rows = contained(index, data, offsets, least, overlap)
            docs = batch.column(0).slice(at).take(pa.array([r[0] for r in rows], pa.int64()))
            rest = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
            yield pa.record_batch([docs, *rest], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])


def contained(index: Index, data: np.ndarray, offsets: np.ndarray, least: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap) of the items that rows contain."""
    out: list[tuple[int, int, float, float, float]] = []
    if not index.ids:
        return out
    h, before = letter_words(data, offsets)
    seen, own = -1, {}
    for (row, item), score in sorted(index.retrieve(h, before, least).items()):
        if row != seen:
            seen, own = row, {}
        share = []
        for part, n in (index.questions[item], index.answers[item]):
            if n and n not in own:
                own[n] = shingles(h[before[row] : before[row + 1]], n)
            share.append(float(np.isin(part, own[n]).mean()) if len(part) else 1.0)
        if index.whole[item] is not None and share[0] < overlap:
            share = [max(share[0], alike(index.whole[item], h[before[row] : before[row + 1]]))] * 2
        if min(share) >= overlap:
            out.append((row, index.ids[item], score, *share))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; the columns stay as they are."""
    small_batches(docs.sparkSession)
    for index in _shards(benchmark, SHARD_BYTES):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, to, data, offsets in text_slices(batch, batch.schema.get_field_index("text")):
                    keep = np.ones(to - at, bool)
                    keep[[r[0] for r in contained(shared.value, data, offsets, LEAST_SCORE, OVERLAP)]] = False
                    yield batch.slice(at, to - at).filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
