"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation estimates each
labeller's accuracies from the counts of all vote patterns (every document counts; there are at most 3 ** labellers
patterns). The posterior of a document's pattern is its soft label. A hashed linear scorer (word hashes, hashes of byte-class
n-grams and a few shares) is trained on a bounded sample, ``SAMPLE`` documents spread over the patterns, and scores every
whole text.

A text that is null or has no word has no votes; its score is 0 and it is not kept. Rows are independent once the model is
fitted, so repeated rows get equal scores; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.wordhash import chain, mix, range_hashes, text_slices, words

SAMPLE, BUCKETS, KEEP = 4000, 1 << 15, 0.5
STEPS, RATE = 400, 0.05
#: What is believed of every labeller beforehand: chances of a bad vote on bad and on good texts, and how many times the
#: documents that belief is worth. Bad votes on good texts are firmly held to be rare; how often bad texts get one is
#: left to the data. Without it a kind of bad text that one labeller alone sees would drift to good.
BELIEF, BELIEF_WEIGHT = np.array([0.15, 0.0005]), np.array([0.02, 20.0])

_GRAM_BASE, _SHARES = BUCKETS, 2 * BUCKETS

# Byte classes: 0 small letter, 1 capital, 2 digit, 3 space or control, 4 plain punctuation, 5 other sign, 6 non-ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[0:33], _CLASS[128:] = 0, 1, 2, 3, 6
_CLASS[list(b".,;:'\"()-?")] = 4

LABELLERS = ("few_signs", "small_letters", "word_length", "distinct_words", "repeated_pairs", "sentence_shape", "shouting", "bars")


@dataclass
class Shape:
    """Per text: shares of byte classes, words, distinct words and so on."""

    share: np.ndarray  # rows by classes
    n_words: np.ndarray
    mean_word: np.ndarray
    distinct: np.ndarray
    distinct_pairs: np.ndarray
    stops: np.ndarray
    shouts: np.ndarray
    bars: np.ndarray


def shape(data: np.ndarray, offsets: np.ndarray) -> tuple[Shape, np.ndarray, np.ndarray]:
    """The texts' shapes, their word hashes and the number of words before each row."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(rows), lengths)
    kinds = np.bincount(row * 8 + _CLASS[data], minlength=rows * 8).reshape(rows, 8)[:, :7].astype(np.float64)
    seen = np.maximum(lengths - kinds[:, 3], 1)
    h, _, before = words(data, offsets)
    count = np.diff(before)
    owner = np.repeat(np.arange(rows), count)

    def distinct(values: np.ndarray, own: np.ndarray) -> np.ndarray:
        values = values ^ mix(own.astype(np.uint64))  # equal only within a row
        order = np.argsort(values, kind="stable")
        values = values[order]
        first = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
        return np.bincount(own[order][first], minlength=rows) / np.maximum(np.bincount(own, minlength=rows), 1)

    same = owner[1:] == owner[:-1]
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])[same] if len(h) > 1 else h[:0]
    signs = lambda b: np.bincount(row[data == b], minlength=rows) / np.maximum(count, 1)
    return (
        Shape(kinds / seen[:, None], count, seen / np.maximum(count, 1), distinct(h, owner), distinct(pairs, owner[1:][same] if len(h) > 1 else owner[:0]), signs(46), signs(33), signs(124)),
        h,
        before,
    )


def votes(s: Shape) -> np.ndarray:
    """rows by labellers: 1 good, -1 bad, 0 nothing. Thresholds are parameters of the heuristics, not fitted."""

    def vote(bad: np.ndarray, good: np.ndarray | None = None) -> np.ndarray:
        return np.where(bad, -1, 0 if good is None else np.where(good, 1, 0))

    few = s.n_words <= 20  # too few to hold repetition or missing stops against a text
    letters = s.share[:, 0] + s.share[:, 1] + s.share[:, 6]
    out = np.stack([
        vote(s.share[:, 5] > 0.06),
        vote(s.share[:, 1] > 0.5 * letters),
        vote((s.mean_word < 2) | (s.mean_word > 14), (s.mean_word > 2.8) & (s.mean_word < 9.5)),
        vote((s.distinct < 0.15) & ~few),
        vote((s.distinct_pairs < 0.5) & ~few, few | (s.distinct_pairs > 0.8)),
        vote((s.stops == 0) & (s.n_words > 60), few | ((s.stops > 0.02) & (s.stops < 0.6))),
        vote(s.shouts > 0.1),
        vote(s.bars > 0.05),
    ], axis=1)
    out[s.n_words == 0] = 0
    return out.astype(np.int8)


def pattern(v: np.ndarray) -> np.ndarray:
    """Vote rows as numbers in base 3."""
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, accuracies as classes by labellers by votes) by expectation-maximisation.

    Labellers are taken as independent given the class. It starts from the patterns with a bad vote as bad ones, the
    others as good ones, and ``BELIEF`` is the prior.
    """
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3 - 1
    good = np.where((v == -1).any(axis=1), 0.05, 0.95)
    held = BELIEF_WEIGHT * counts.sum() + 1
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        bad, none, yes = (weight @ (v == k) for k in (-1, 0, 1))
        bad = (bad + (held * BELIEF)[:, None]) / (weight.sum(axis=1) + held)[:, None]
        yes = (yes + 1) / (yes + none + 2)
        chance = np.stack([bad, (1 - bad) * (1 - yes), (1 - bad) * yes], axis=2)
        log = np.log(prior)[:, None] + sum(np.log(chance[:, j, :])[:, v[:, j] + 1] for j in range(labellers))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return good, chance


def features(data: np.ndarray, offsets: np.ndarray, s: Shape, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of byte-class 4-grams, each with the number before each row, and the shares of each row."""
    kinds = _CLASS[data].astype(np.int64)
    grams = kinds[:-3] * 343 + kinds[1:-2] * 49 + kinds[2:-1] * 7 + kinds[3:] if len(kinds) > 3 else kinds[:0]
    at = np.minimum(offsets, len(grams))
    shares = np.concatenate([s.share, np.stack([np.minimum(s.mean_word, 20) / 20, s.distinct, s.distinct_pairs, np.minimum(s.stops, 1), np.minimum(s.shouts, 1), np.minimum(s.bars, 1), np.ones(len(s.stops))], axis=1)], axis=1)
    return (h % np.uint64(BUCKETS)).astype(np.int64), before, grams, at, shares


def means(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean of each row's run of values, 0 for an empty one."""
    total = np.append(0.0, np.cumsum(values, dtype=np.float64))
    return (total[before[1:]] - total[before[:-1]]) / np.maximum(np.diff(before), 1)


@dataclass
class Scorer:
    word: np.ndarray
    gram: np.ndarray
    share: np.ndarray
    posterior: dict[int, float]
    accuracies: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, posterior of the weak labels) of each row."""
        s, h, before = shape(data, offsets)
        w, wb, g, gb, shares = features(data, offsets, s, h, before)
        x = means(self.word[w], wb) + means(self.gram[g], gb) + shares @ self.share
        label = np.array([self.posterior.get(int(p), 0.5) for p in pattern(votes(s))])
        return np.where(s.n_words > 0, 1 / (1 + np.exp(-x)), 0.0), np.where(s.n_words > 0, label, 0.0)


def _drawn(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's id and text."""
    return chain(ids.fill_null(0).to_numpy().astype(np.uint64), range_hashes(data, offsets[:-1], offsets[1:]))


def _pattern_counts(docs: DataFrame) -> pd.DataFrame:
    """Patterns of all documents, how many rows have them, and about how many different ones (id and text); at most
    3 ** labellers rows."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, 1):
                s, _, _ = shape(data, offsets)
                spoken = s.n_words > 0
                drawn = _drawn(batch.column(0).slice(at, to - at), data, offsets).view(np.int64)
                columns = [pa.array(pattern(votes(s))[spoken].astype(np.int64)), pa.array(drawn[spoken])]
                yield pa.record_batch(columns, names=["pattern", "drawn"])

    made = docs.select("doc_id", "text").mapInArrow(seen, "pattern long, drawn long").groupBy("pattern")
    return made.agg(F.count("*").alias("n"), F.approx_count_distinct("drawn", 0.05).alias("different")).orderBy("pattern").toPandas()


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Weak labels from all of (doc_id, text), then the scorer from at most ``sample`` documents; None without words.

    Documents are drawn by hash of id and text, and rows equal in both count once, so a repeated or null id or a flood of
    copies neither fills nor empties the sample, nor reaches the driver.
    """
    counts = _pattern_counts(docs)
    if not len(counts):
        return None
    good, accuracies = estimate(counts["pattern"].to_numpy(), counts["n"].to_numpy(), len(LABELLERS))
    posterior = dict(zip(counts["pattern"].tolist(), good.tolist(), strict=True))
    # Both classes get half of the sample, whatever their shares are: the chance of a document goes by its pattern's class.
    is_good = good >= 0.5
    # A class is as large as its different rows are many, as copies of a row are drawn together; half as many again as
    # are wanted make up for the estimate.
    per_class = {k: max(1, int(counts["different"].to_numpy()[is_good == k].sum())) for k in (False, True)}
    chance = {p: min(1.0, 0.75 * sample / per_class[bool(g)]) for p, g in zip(counts["pattern"].tolist(), is_good, strict=True)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, 1):
                s, h, before = shape(data, offsets)
                w, wb, g, gb, shares = features(data, offsets, s, h, before)
                ids = batch.column(0).slice(at, to - at)
                drawn = _drawn(ids, data, offsets)
                turn = drawn.astype(np.float64) / 2.0**64
                drawn = drawn.view(np.int64)
                p = pattern(votes(s))
                taken = [k for k in range(to - at) if s.n_words[k] and turn[k] < chance.get(int(p[k]), 0.0)]
                rows = []
                for k in taken:
                    if int(drawn[k]) in met:
                        continue
                    met.add(int(drawn[k]))
                    buckets, times = np.unique(np.concatenate([w[wb[k] : wb[k + 1]], _GRAM_BASE + g[gb[k] : gb[k + 1]]]), return_counts=True)
                    size = np.where(buckets < _GRAM_BASE, max(wb[k + 1] - wb[k], 1), max(gb[k + 1] - gb[k], 1))
                    rows.append((int(drawn[k]), turn[k] / chance[int(p[k])], ids[k].as_py(), int(p[k]), buckets.astype("<i4").tobytes(), (times / size).astype("<f4").tobytes(), shares[k].astype("<f4").tobytes()))
                types = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["drawn", "turn", "doc_id", "pattern", "buckets", "weights", "shares"])

    # Turns are shares of the class's chance, so the least of them are as many of either class.
    picked = docs.select("doc_id", "text").mapInArrow(pick, "drawn long, turn double, doc_id long, pattern long, buckets binary, weights binary, shares binary")
    got = picked.dropDuplicates(["drawn"]).orderBy("turn", "drawn").limit(sample).collect()
    got = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["buckets"]))
    buckets = [np.frombuffer(r["buckets"], "<i4") for r in got]
    weights = [np.frombuffer(r["weights"], "<f4") for r in got]
    shares = np.array([np.frombuffer(r["shares"], "<f4") for r in got], np.float64)
    label = np.array([posterior[r["pattern"]] for r in got])
    return train(buckets, weights, shares, label, posterior, accuracies)


def train(buckets: list[np.ndarray], weights: list[np.ndarray], shares: np.ndarray, label: np.ndarray, posterior: dict[int, float], accuracies: np.ndarray) -> Scorer:
    """Logistic regression on soft labels by Adam over the whole sample."""
    owner = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    flat, value = np.concatenate(buckets), np.concatenate(weights).astype(np.float64)
    size = _SHARES + shares.shape[1]
    p, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        x = np.bincount(owner, value * p[flat], len(label)) + shares @ p[_SHARES:]
        slope = (1 / (1 + np.exp(-x)) - label) / len(label)
        g = np.append(np.bincount(flat, value * slope[owner], _SHARES), slope @ shares) + 1e-6 * p
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p = p - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Scorer(p[:BUCKETS], p[_GRAM_BASE:_SHARES], p[_SHARES:], posterior, accuracies)


def score_quality(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per row of (doc_id, text): doc_id, weak_label (posterior of the votes), score (the scorer's chance of good), keep.

    A text is dropped only if its weak label and its score both speak against it.
    """
    scorer = fit(docs, sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, 1):
                score, label = scorer.scores(data, offsets) if scorer else (np.zeros(to - at), np.zeros(to - at))
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(label), pa.array(score), pa.array((score >= keep) | (label >= keep))], names=["doc_id", "weak_label", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, weak_label double, score double, keep boolean")
