"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of several widths slide over
them, each filter's largest response in the window passes a ramp, and a softmax layer gives the languages' chances. A
text's chances are its windows' mean, weighted by their bytes. The network is trained in numpy on windows of a
bounded sample of labelled texts (``PER_LANGUAGE`` texts of each language, ``PER_TEXT`` windows of each).

Whole texts are scored. A text that is null or holds no letter is ``und`` with score 0. Ties go to the language that
sorts first. Rows are independent, so repeated rows and extra columns change nothing; an empty table gives no rows. With
no labelled text at all, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structsim.llm.wordhash import text_slices
from structsim.llm.workspace import small_batches

WINDOW, PER_LANGUAGE, PER_TEXT = 256, 500, 4
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
STEPS, BATCH, RATE, SEED = 500, 64, 0.01, 7
NO_LANGUAGE = "und"
_LETTER = regex.compile(r"\p{L}")
_ROWS = 256


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # byte -> numbers
    filters: np.ndarray  # (widest * EMBEDDING, all filters); narrower filters have zeros at their end
    bias: np.ndarray
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response per window, after the ramp, and its place."""
        patches = self.patches(windows)
        response = patches.reshape(-1, patches.shape[-1]) @ self.filters
        response = response.reshape(len(windows), -1, self.filters.shape[1])
        place = response.argmax(axis=1)
        most = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0] + self.bias
        return np.maximum(most, 0), place

    def patches(self, windows: np.ndarray) -> np.ndarray:
        deep = np.ascontiguousarray(self.embedding[windows])
        n, length, width = deep.shape
        step = deep.strides[2]
        shape = (n, length - max(WIDTHS) + 1, max(WIDTHS) * width)
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(deep, shape, (deep.strides[0], width * step, step)))

    def chances(self, windows: np.ndarray) -> np.ndarray:
        """Softmax chances of each window's languages; uses max pooling without places."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for k in range(0, len(windows), _ROWS):
            patches = self.patches(windows[k : k + _ROWS])
            n, places, deep = patches.shape
            most = (patches.reshape(-1, deep) @ self.filters).reshape(n, places, -1).max(axis=1)
            out[k : k + _ROWS] = softmax(np.maximum(most + self.bias, 0) @ self.out + self.out_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Fits the network by Adam on (windows, label numbers). Some windows are shortened at random, as texts can be short."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    mask = np.repeat([[float(k < w) for w in WIDTHS for _ in range(FILTERS)] for k in range(max(WIDTHS))], EMBEDDING, axis=0).astype(np.float32)
    p = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        "filters": (rng.normal(0, 0.4, (max(WIDTHS) * EMBEDDING, total)) * mask).astype(np.float32),
        "bias": np.zeros(total, np.float32),
        "out": rng.normal(0, 0.2, (total, len(languages))).astype(np.float32),
        "out_bias": np.zeros(len(languages), np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick].copy(), labels[pick]
        keep = np.where(rng.random(BATCH) < 0.4, rng.integers(8, WINDOW + 1, BATCH), WINDOW)
        x[np.arange(WINDOW) >= keep[:, None]] = 0
        net = Network(languages, **p)
        hidden, place = net.pooled(x)
        slope = softmax(hidden @ p["out"] + p["out_bias"])
        slope[np.arange(BATCH), y] -= 1
        slope /= BATCH
        back = (slope @ p["out"].T) * (hidden > 0)
        at = place[:, :, None] + np.arange(max(WIDTHS))
        seen = x[np.arange(BATCH)[:, None, None], at]  # the bytes below each filter's best place
        below = p["embedding"][seen].reshape(BATCH, total, -1)
        grown = np.zeros_like(p["embedding"])
        np.add.at(grown, seen.reshape(-1), (back[:, :, None] * p["filters"].T).reshape(-1, EMBEDDING))
        slopes = {"embedding": grown, "filters": np.einsum("bf,bfd->df", back, below) * mask, "bias": back.sum(0), "out": hidden.T @ slope, "out_bias": slope.sum(0)}
        for k, g in slopes.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            rate = RATE * (1 - step / (steps + 1))
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(languages, **p)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts (zeros after a text's end), the row of each, and its bytes."""
    lengths = np.diff(offsets)
    n = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[:-1][row] + inside * WINDOW
    size = np.minimum(WINDOW, offsets[1:][row] - begin)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] if len(row) else np.zeros((0, WINDOW), np.uint8)
    windows = windows.copy()
    short = np.flatnonzero(size < WINDOW)
    for k in short.tolist():
        windows[k, size[k] :] = 0
    return windows, row, size


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4. Null counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, per_text: int = PER_TEXT) -> Network | None:
    """Trains on documents (doc_id, text, lang) that are not held out and have a language.

    The sample is bounded: at most ``per_language`` texts of each language, chosen by hash of the id and the text, and
    ``per_text`` windows of each, spread over the whole text. Equal rows count once, in the sample and in the number of a
    language's texts that its share is worked out from. None if there is no labelled text.
    """
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    distinct = F.approx_count_distinct(F.xxhash64("doc_id", "text", "lang"), 0.05).alias("n")
    counts = {r["lang"]: max(1, r["n"]) for r in labelled.groupBy("lang").agg(distinct).collect()}
    if not counts:
        return None
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * 1.5 * per_language / n) + 1))])
    drawn = labelled.withColumn("drawn", F.xxhash64("doc_id", "text", "lang")).withColumn("turn", F.pmod("drawn", F.lit(scale)))
    picked = drawn.where(F.col("turn") < share[F.col("lang")]).select("drawn", "turn", "doc_id", "lang", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            rows = {"drawn": [], "turn": [], "doc_id": [], "lang": [], "windows": []}
            for key, turn, doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key not in met and _LETTER.search(text):
                    met.add(key)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    own, _, _ = cut(raw, np.array([0, len(raw)]))
                    spread = np.unique(np.linspace(0, len(own) - 1, per_text).astype(int))
                    for name, value in zip(rows, (key, turn, doc, lang, own[spread].tobytes()), strict=True):
                        rows[name].append(value)
            yield pa.record_batch([pa.array(rows["drawn"], pa.int64()), pa.array(rows["turn"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["lang"], pa.string()), pa.array(rows["windows"], pa.binary())], names=list(rows))

    made = picked.mapInArrow(windows, "drawn long, turn long, doc_id long, lang string, windows binary").dropDuplicates(["drawn"])
    # Turns as shares of the language's chance: the least are as many of each language. About half as many again are
    # expected as are taken; three times as many bound what is collected.
    got = made.orderBy(F.col("turn") / share[F.col("lang")], "drawn").limit(3 * per_language * len(counts)).collect()
    taken = dict.fromkeys(counts, 0)
    x, y, languages = [], [], sorted(counts)
    for r in sorted(got, key=lambda r: (r["turn"], r["doc_id"], r["windows"])):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            own = np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW)
            x.append(own)
            y += [languages.index(r["lang"])] * len(own)
    return train(np.concatenate(x), np.array(y), languages) if x else None


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, 1):
                n = to - at
                texts = batch.column(1).slice(at, n)
                spoken = np.array([bool(net and t.is_valid and _LETTER.search(t.as_py())) for t in texts], bool)
                if net is None:
                    names, score = [NO_LANGUAGE] * n, np.zeros(n)
                else:
                    windows, row, size = cut(data, offsets)
                    chances = net.chances(windows) * size[:, None]
                    total = np.stack([np.bincount(row, chances[:, k], n) for k in range(len(net.languages))], axis=1)
                    total /= np.maximum(np.diff(offsets), 1)[:, None]
                    best = total.argmax(axis=1)
                    names = [net.languages[b] if s else NO_LANGUAGE for b, s in zip(best.tolist(), spoken.tolist(), strict=True)]
                    score = np.where(spoken, np.minimum(total[np.arange(n), best], 1.0), 0.0)
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    return predict(docs, fit(docs, per_language)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a language of chance ``least`` or more; the columns stay as they are."""
    small_batches(docs.sparkSession)
    net = fit(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            for at, to, data, offsets in text_slices(batch, where):
                part = batch.slice(at, to - at)
                spoken = np.array([t.is_valid and bool(_LETTER.search(t.as_py())) for t in part.column(where)], bool)
                if net is not None:
                    windows, row, size = cut(data, offsets)
                    chances = net.chances(windows) * size[:, None]
                    total = np.stack([np.bincount(row, chances[:, k], to - at) for k in range(len(net.languages))], axis=1)
                    spoken &= total.max(axis=1) >= least * np.diff(offsets)
                yield part.filter(pa.array(spoken))

    return docs.mapInArrow(rows, docs.schema)
