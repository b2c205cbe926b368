"""Exact Jaccard self-join of documents on their word n-grams, by T-occurrence search.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A document's set holds its distinct n-word shingles as
64-bit hashes; with fewer words the whole sequence is one shingle; without words or text the set is empty and the
document is linked with nothing. Two documents link when 100 * |intersection| >= percent * |union|.

1. Documents with equal sets are one class, named by the set's digest, and each class is searched once.
2. Meeting places: linked sets of sizes up to r differ in at most k shingles, k = 2 r (100 - percent) / (100 + percent).
   The hash range is cut into k + 1 + e parts, so linked sets agree on at least e + 1 parts whole. Up to e parts of a
   set that say little (none or one shingle) are left out; sets that share the content of a part left meet there.
   Parts of small sets say too little for that at low similarities, and all such sets would meet. Pairs whose smaller set is
   in such a size class meet by prefix: with all shingles in one order, frequent ones last, linked sets share one of
   the first size - ceil(percent / 100 * size) + 1 of each.
   Frequent shingles are taken out of all sets for the parts, which makes differences only smaller: no link is lost
   whatever is taken out, and a frequent passage is no meeting place. They are counted in all documents, by each task in
   buffers of ``BUFFER`` hashes; at most the ``FREQUENT`` most frequent ones are sent out.
   A task makes the keys of each class it sees once, settles those that meet within a buffer by itself, and sends one row
   per key and buffer, so neither copies nor near copies crowd a key.
3. Sets that meet, directly or over others, form a cell. In a cell every set searches an inverted index of the cell:
   a partner must occur on at least T = ceil(percent / 100 * size) of the set's lists. DivideSkip sets the T - 1
   longest lists aside, merges the other, short ones by counting, and probes the long lists by binary search for the sets
   found, or reads them where probing costs more. Each hit is settled by exact counts. Only links between sets not yet
   connected are looked for, as classes need no more.
4. A cell above ``CELL`` sets is first thinned: each of its sets is compared with two of those it met, and only sets
   outside the cell's largest component found so far search the whole cell, in blocks of ``CELL``. Where sets of different
   components have few keys in common, as in cells that hang together by chains, only sets of one key search each other.

Null texts have empty sets. Repeated rows give a row each; rows that share a doc_id count as one document, which is
linked by any of its texts; those of them with empty sets name their own doc_id. Rows of null doc_id link like all others;
their component is null where no row with an id can be reached. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from structsim.llm.components import connected_components
from structsim.llm.wordhash import chain, gathered, give_back, mix, text_slices, words
from structsim.llm.workspace import new_folder, small_batches, written

WORDS, PERCENT, CELL = 3, 90, 512
#: Hashes that a task counts or compares at once, how many documents must hold a shingle that is taken out of the meeting
#: places, and how many shingles are taken out at most (eight bytes each are broadcast).
BUFFER, SEEN, FREQUENT = 1_000_000, 32, 1_000_000
#: Most shingles of sets that may meet by prefix, and what marks a key as one of a prefix.
SHORT, PREFIX = 128, (1 << 64) - 1
#: Up to so many ids are broadcast to find their rows; more are joined by a shuffle.
SENT = 1_000_000
#: A probe of a long list costs as much as reading so many entries.
PROBE = 20
SETS = "doc_id long, n_shingles long, d1 long, d2 long, shingle long, times long"
PAIRS = "a long, b long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, _, before = words(data, offsets)
    grams = chain(*(h[k : len(h) - n + 1 + k] for k in range(n))) if len(h) >= n else h[:0]
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            yield chain(np.full(1, b - a, np.uint64), *(h[k : k + 1] for k in range(a, b)))
        else:
            yield h[:0]


@dataclass(frozen=True)
class SizeClass:
    """Sets of ``low`` to ``high`` shingles; ``apart``: in how many linked ones differ at most; ``parts`` of the hash range,
    of which ``spare`` with at most ``little`` shingles may be left out; ``prefix``: whether its sets meet by prefix instead."""

    low: int
    high: int
    apart: int
    parts: int
    spare: int
    little: int
    prefix: bool = False


def _telling(low: int, parts: int, spare: int, little: int) -> bool:
    """Whether sets of ``low`` shingles rarely have more than ``spare`` of these parts with at most ``little``."""
    fill = low / parts
    chance = math.exp(-fill) * (1 + fill * little)
    return parts * chance + 3 * math.sqrt(parts * chance) <= spare


def _parts(low: int, apart: int) -> tuple[int, int, int]:
    """(parts, spare, little) for which sets of ``low`` shingles rarely have more than ``spare`` parts of ``little``."""
    for little in (1, 0):
        spare = 3
        while spare <= max(3, apart // 4):
            parts = apart + 1 + spare
            if _telling(low, parts, spare, little):
                return parts, spare, little
            spare = max(spare + 1, spare * 9 // 8)
    return apart + 1 + max(3, apart // 4), max(3, apart // 4), 0


def size_classes(most: int, percent: int) -> list[SizeClass]:
    """Consecutive size classes up to ``most``; a linked pair is in one class or in two that follow each other."""
    out: list[SizeClass] = []
    low = 1
    while not out or out[-1].high < most:
        high = max(low, low * 5 // 4, 100 * low // percent)
        if not out and percent < 100:  # sizes whose linked sets are equal
            high = max(high, -(-(100 + percent) // (2 * (100 - percent))) - 1)
        apart = 2 * high * (100 - percent) // (100 + percent)
        parts, spare, little = _parts(max(1, percent * low // 100), apart)
        out.append(SizeClass(low, high, apart, parts, spare, little, high <= SHORT and not _telling(max(1, percent * low // 100), parts, spare, little)))
        low = high + 1
    return out


def part_keys(own: np.ndarray, seed: int, of: SizeClass) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys of the parts of the hash range that say something, of all parts, and whether too many say little."""
    part = ((own >> np.uint64(32)) * np.uint64(of.parts)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(own) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(own)))
    content = np.zeros(of.parts, np.uint64)
    telling = np.zeros(of.parts, bool)
    if len(own):
        at = part[first].astype(np.int64)
        content[at] = np.add.reduceat(mix(own), first)
        telling[at] = count > of.little
    keys = chain(content, np.arange(of.parts, dtype=np.uint64) + np.uint64(seed << 32))
    return keys[telling], keys, of.parts - int(telling.sum()) > of.spare


def meeting_keys(own: np.ndarray, frequent: np.ndarray, classes: list[SizeClass], highs: np.ndarray, percent: int) -> np.ndarray:
    """All keys of a set: those of its size class, and of the next one if it can have partners there.

    Of a linked pair's parts that agree, spare + 1 or more, one is telling if at most ``spare`` parts of either set say
    little, and then both have its key. If both have more of them, both also bring the parts of their whole sets; and if
    those, too, say little, all of them. How a pair meets is up to the size class of the smaller set: by prefix, or by the
    parts of the larger one's class.
    """
    if not len(own):
        return own
    level = int(np.searchsorted(highs, len(own)))
    kept = own
    if len(frequent):
        kept = own[frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] != own]
    found = [own[:0]]
    of, below = classes[level], level > 0 and percent * len(own) <= 100 * classes[level - 1].high
    above = 100 * len(own) >= percent * classes[level + 1].low
    if of.prefix and (of.apart or above) or below and classes[level - 1].prefix:
        frequent_last = np.concatenate([kept, own[~np.isin(own, kept, assume_unique=True)]])
        found.append(chain(frequent_last[: len(own) - -(-percent * len(own) // 100) + 1], np.full(1, PREFIX, np.uint64)))
    smaller_by_parts = below and not classes[level - 1].prefix
    for k, asked in ((level, not of.prefix or smaller_by_parts), (level + 1, not of.prefix and above)):
        of = classes[k]
        if not of.apart or not asked:
            continue
        telling, every, short = part_keys(kept, 2 * k, of)
        found.append(telling)
        if short:
            telling, every, short = part_keys(own, 2 * k + 1, of)
            found.append(every if short else telling)
    return np.concatenate(found)


def _digest(own: np.ndarray) -> tuple[int | None, int | None]:
    """What names a set: two 64-bit numbers, null for the empty set."""
    if not len(own):
        return None, None
    return int(own.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(own)).astype(np.int64))


def _sliced(rows: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows in batches that are small outside this process, too."""
    for at in range(0, rows.num_rows, most):
        yield rows.slice(at, most)
    give_back()


def _set_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row per document, with its set's size and digest, and rows (shingle, times) of what repeats within a buffer."""
    types = [pa.int64()] * 6
    names = ["doc_id", "n_shingles", "d1", "d2", "shingle", "times"]
    held: list[np.ndarray] = []

    def repeated() -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        found, times = found[times > 1].view(np.int64), times[times > 1]
        held.clear()
        yield from _sliced(pa.record_batch([*(pa.nulls(len(found), t) for t in types[:4]), pa.array(found), pa.array(times)], names=names))

    seen: set[tuple] = set()
    for batch in batches:
        for at, to, data, offsets in text_slices(batch, 1):
            sizes, digests = [], []
            for own in shingle_sets(data, offsets, n):
                sizes.append(len(own))
                digests.append(_digest(own))
                if digests[-1] not in seen:
                    held.append(own)
                    seen.add(digests[-1])
            if sum(map(len, held)) >= BUFFER:
                yield from repeated()
                seen.clear()
            columns = [pa.array(sizes, pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))]
            none = [pa.nulls(to - at, pa.int64())] * 2
            yield pa.record_batch([batch.column(0).slice(at, to - at).cast(pa.int64()), *columns, *none], names=names)
    yield from repeated()


def _met_in_buffer(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) rows that say the same as the given ones: one per key, and two of a key of their own per pair that met."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    least = nodes[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    apart = nodes != least
    pairs = np.unique(np.stack([least[apart], nodes[apart]], axis=1), axis=0)
    own = chain(pairs[:, 0], pairs[:, 1])
    return np.concatenate([keys[first], own, own]), np.concatenate([nodes[first], pairs[:, 0], pairs[:, 1]])


def _key_batches(batches: Iterator[pa.RecordBatch], n: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, node); a node is the first number of a set's digest."""
    sizes = size_classes(1 << 31, percent)
    highs = np.array([c.high for c in sizes])
    held: list[tuple[np.ndarray, int]] = []
    seen: set[int] = set()

    def sent() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([*(k for k, _ in held), np.zeros(0, np.uint64)])
        nodes = np.repeat(np.array([d for _, d in held], np.int64).view(np.uint64), [len(k) for k, _ in held])
        held.clear()
        seen.clear()
        keys, nodes = _met_in_buffer(keys, nodes)
        order = np.argsort(nodes, kind="stable")  # runs of equal nodes pack better
        keys, nodes = keys[order], nodes[order]
        yield from _sliced(pa.record_batch([pa.array(keys.view(np.int64)), pa.array(nodes.view(np.int64))], names=["key", "node"]))

    total = 0
    for batch in batches:
        for _, _, data, offsets in text_slices(batch, 0):
            for own in shingle_sets(data, offsets, n):
                node = _digest(own)[0]
                if node is None or node in seen:
                    continue
                seen.add(node)
                held.append((meeting_keys(own, frequent, sizes, highs, percent), node))
                total += len(held[-1][0]) + 1
            if total >= BUFFER:
                yield from sent()
                total = 0
    yield from sent()


def _meeting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) sorted by both -> pairs (a, b) of a node and the least one under a key of it, each once a batch."""
    last = np.zeros((2, 0), np.int64)  # the least node under the last key
    for batch in batches:
        key, node = np.concatenate([last, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        least = node[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        last = np.array([key[-1:], least[-1:]])
        pairs = np.unique(np.stack([node, least], axis=1)[node != least], axis=0)
        yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    give_back()


def frequent_shingles(counted: DataFrame, seen: int = SEEN, most: int = FREQUENT) -> np.ndarray:
    """Sorted hashes of the shingles of (shingle, times) that ``seen`` documents or more hold; at most the ``most`` most frequent."""
    total = counted.groupBy("shingle").agg(F.sum("times").alias("n")).where(F.col("n") >= seen)
    top = total.orderBy(F.col("n").desc(), "shingle").limit(most).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def connect(sets: list[np.ndarray], percent: int, queries: range | list[int], union: Union) -> None:
    """Joins in ``union`` all linked sets of which one is a query, by T-occurrence search with DivideSkip.

    The sets found on the short lists are probed on the long ones, all at once; where so many are found that reading the
    long lists whole costs less, they are read.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]  # a token's inverted list is a run of ascending owners
    begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    lists, length = tokens[begin], np.diff(np.append(begin, len(tokens)))
    entries = np.repeat(np.arange(len(lists)), length) * len(sets) + owner  # ascending
    roots = np.array([union.root(k) for k in range(len(sets))])
    for q in queries:
        if (roots == roots[0]).all():
            return
        size = int(sizes[q])
        need = -(-percent * size // 100)
        place = np.searchsorted(lists, sets[q])
        by_length = np.argsort(length[place], kind="stable")
        short, long = place[by_length[: size - need + 1]], place[by_length[size - need + 1 :]]
        times = np.bincount(gathered(owner, begin[short], length[short]), minlength=len(sets))
        found = np.flatnonzero((times > 0) & (roots != roots[q]))
        found = found[100 * np.minimum(sizes[found], size) >= percent * np.maximum(sizes[found], size)]
        if not len(found):
            continue
        if PROBE * len(found) * len(long) < length[long].sum():
            probes = (long * len(sets) + found[:, None]).ravel()
            hit = entries[np.minimum(np.searchsorted(entries, probes), len(entries) - 1)] == probes
            both = times[found] + hit.reshape(len(found), len(long)).sum(axis=1)
        else:
            both = (times + np.bincount(gathered(owner, begin[long], length[long]), minlength=len(sets)))[found]
        for k in found[100 * both >= percent * (sizes[found] + size - both)].tolist():
            a, b = int(roots[q]), int(roots[k])
            if a != b:
                union.join(q, k)
                roots[(roots == a) | (roots == b)] = min(a, b)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, from batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _cell_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(cell, doc, set) sorted by cell -> links (a, b) that connect what is connected in each cell."""
    for cell in _runs(batches, 1):
        cell = [r for k, r in enumerate(cell) if not k or r[1:] != cell[k - 1][1:]]
        union = Union(len(cell))
        connect([np.frombuffer(r[2], np.uint64) for r in cell], percent, range(len(cell)), union)
        pairs = [(r[1], cell[union.root(k)][1]) for k, r in enumerate(cell) if union.root(k) != k]
        yield pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])
    give_back()


def _block_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(cell, i, j, asks, component, doc, set) sorted by the first three: rows that ask search the others."""
    for block in _runs(batches, 3):
        union, seen = Union(len(block)), {}
        for k, r in enumerate(block):
            union.join(k, seen.setdefault(r[4], k))
        before = [union.root(k) for k in range(len(block))]
        connect([np.frombuffer(r[6], np.uint64) for r in block], percent, [k for k, r in enumerate(block) if r[3]], union)
        pairs = [(block[k][4], block[union.root(k)][4]) for k in sorted(set(before)) if union.root(k) != k]
        yield pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])
    give_back()


def few(ids: DataFrame) -> DataFrame:
    """A table of some numbers a row, to be joined with wide rows: up to ``SENT`` of them are broadcast, more are shuffled."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _active_sets(docs: DataFrame, active: DataFrame, n: int) -> DataFrame:
    """(d1, d2, set) of the classes in ``active`` (rep, the least doc_id, may be null); sets are made anew from the texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, 0):
                digests, sets = [], []
                for own in shingle_sets(data, offsets, n):
                    digest = _digest(own)
                    if len(own) and digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        sets.append(own.tobytes())
                columns = [*(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array(sets, pa.binary())]
                yield pa.record_batch(columns, names=["d1", "d2", "set"])
                if len(seen) > BUFFER // 10:
                    seen.clear()

    ids = active.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    rows = docs.join(few(ids), "doc_id", "left_semi").select("text")
    if active.where("rep is null").take(1):
        rows = rows.unionByName(docs.where("doc_id is null").select("text"))
    return rows.mapInArrow(make, "d1 long, d2 long, set binary")


def _ids_of_many_sets(made: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sets are of one doc_id."""
    own = made.where("doc_id is not null and n_shingles > 0").select("doc_id", F.col("d1").alias("a"))
    many = own.groupBy("doc_id").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most")
    return own.join(many.select("doc_id", "b"), "doc_id").where("a <> b").select("a", "b").distinct()


def _linked_classes(docs: DataFrame, folder: str, n: int, percent: int, cell_size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, d1, d2) of all documents, and classes (d1, d2, root, component_id).

    ``root`` names the component by a class; ``component_id`` is its least doc_id, null without any.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    scanned = written(rows.mapInArrow(lambda it: _set_batches(it, n), SETS), folder, "sets")
    made = scanned.where("n_shingles is not null").select("doc_id", "n_shingles", "d1", "d2")
    classes = written(made.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), folder, "classes")

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(scanned.where("shingle is not null").select("shingle", "times")))
    keys = rows.select("text").mapInArrow(lambda it: _key_batches(it, n, percent, frequent.value), "key long, node long")
    # As many partitions as a shuffle has, not fewer, larger ones: each is sorted whole.
    dealt = keys.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "node")
    met = written(dealt.mapInArrow(_meeting_batches, PAIRS).distinct(), folder, "met")

    cells = written(connected_components(met, folder, "cells").select(F.col("node").alias("d1"), F.col("root").alias("cell")), folder, "cells")
    active = written(classes.join(cells, "d1").select("d1", "d2", "rep", "cell"), folder, "active")
    big = written(active.groupBy("cell").count().where(F.col("count") > cell_size).select("cell", F.col("count").alias("n")), folder, "big")
    sets = _active_sets(rows, active, n)
    own = sets.join(few(active.select("d1", "d2", "cell")), ["d1", "d2"])
    members = written(own.select("cell", "d1", F.col("d1").alias("doc"), "set"), folder, "members")
    small = members.join(big, "cell", "left_anti").select("cell", "doc", "set").repartition("cell").sortWithinPartitions("cell", "doc")
    links = small.mapInArrow(lambda it: _cell_batches(it, percent), PAIRS)
    if big.take(1):
        links = links.unionByName(_big_cells(members.join(big, "cell"), met, folder, percent, cell_size, frequent))
    comps = connected_components(written(links.unionByName(_ids_of_many_sets(made)), folder, "links"), folder, "components")
    comps = comps.select(F.col("node").alias("d1"), "root")
    least = comps.join(classes, "d1").groupBy("root").agg(F.min("rep").alias("least"))
    named = classes.join(comps.join(least, "root"), "d1", "left")
    named = named.select("d1", "d2", F.coalesce("root", "d1").alias("root"), F.coalesce("least", "rep").alias("component_id"))
    return made, written(named, folder, "named")


def ngram_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, cell_size: int = CELL) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    made, named = _linked_classes(docs, new_folder(docs.sparkSession, "ngram-join"), n, percent, cell_size)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return made.join(named, ["d1", "d2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _keys_of_sets(members: DataFrame, percent: int, frequent: Broadcast) -> DataFrame:
    """(cell, key, doc, component) of members (cell, doc, component, set): the keys by which sets meet."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = size_classes(1 << 31, percent)
        highs = np.array([c.high for c in sizes])
        for batch in batches:
            keys = [np.unique(meeting_keys(np.frombuffer(x, np.uint64), frequent.value, sizes, highs, percent)) for x in batch.column("set").to_pylist()]
            times = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            columns = [batch.column(c).take(times) for c in ("cell", "doc", "component")]
            yield pa.record_batch([columns[0], pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)), *columns[1:]], names=["cell", "key", "doc", "component"])

    return members.select("cell", "doc", "component", "set").mapInArrow(make, "cell long, key long, doc long, component long")


def _big_cells(members: DataFrame, met: DataFrame, folder: str, percent: int, cell_size: int, frequent: Broadcast) -> DataFrame:
    """Links of the cells above ``cell_size``; members: cell, n, d1, doc, set; met: pairs (a, b) of d1; frequent: shingles left out of keys."""
    members = written(members.select("cell", "n", "d1", "doc", "set").dropDuplicates(["cell", "d1", "doc"]), folder, "big_members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if linked(len(x), len(y), both, percent):
                    pairs.append((a, b))
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    left = members.select(F.col("d1").alias("a"), F.col("doc").alias("doc_a"), F.col("set").alias("x"))
    right = members.select(F.col("d1").alias("b"), F.col("doc").alias("doc_b"), F.col("set").alias("y"))
    # Two of the sets that each one met are enough to thin a cell, and whole sets are joined for no more pairs than that.
    few_met = met.join(members.select(F.col("d1").alias("a")).distinct(), "a", "left_semi").groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    few_met = few_met.select("a", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("b"))
    both = few_met.join(left, "a").join(right, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "x", "y")
    sure = written(both.mapInArrow(check, PAIRS), folder, "sure")
    comps = connected_components(sure, folder, "thinned").withColumnRenamed("node", "doc")
    known = written(members.join(comps, "doc", "left").select("cell", "n", "doc", F.coalesce("root", "doc").alias("component"), "set"), folder, "known")
    counts = known.groupBy("cell", "component").agg(F.count("*").alias("size"))
    largest = counts.groupBy("cell").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("largest"), F.count("*").alias("comps")).where("comps > 1").select("cell", "largest")
    open_ = known.join(largest, "cell")
    asking = open_.where("component <> largest")
    n_asking = asking.groupBy("cell").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    blocks = lambda c: F.ceil(F.col(c) / cell_size).cast("int")
    # Linked sets share a key. Where sets of several components share few, sets are sent once a key, not once a block.
    keyed = written(_keys_of_sets(open_, percent, frequent), folder, "keyed")
    groups = keyed.groupBy("cell", "key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    groups = written(groups.select("cell", "key", "m"), folder, "groups")
    cost = groups.groupBy("cell").agg(F.sum(F.col("m") * F.when(F.col("m") > cell_size, 2 * blocks("m")).otherwise(1)).alias("by_key"))
    each = n_asking.join(cost, "cell").withColumn("by_block", F.col("m") * blocks("n") + F.col("n") * blocks("m"))
    each = written(each.select("cell", (F.col("by_key") < F.col("by_block")).alias("keys")), folder, "ways")
    by_key = keyed.join(groups, ["cell", "key"]).join(few(each.where("keys").select("cell")), "cell", "left_semi")
    by_key = by_key.join(open_.select("cell", "doc", "set"), ["cell", "doc"])
    by_block = each.where("not keys").select("cell")
    open_, asking = open_.join(by_block, "cell", "left_semi"), asking.join(by_block, "cell", "left_semi")
    n_asking = n_asking.drop("n")
    own = lambda c: F.pmod(F.xxhash64("doc"), blocks(c)).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks("m") - 1)).alias("i")
    whole = open_.join(n_asking, "cell").select("cell", every, own("n").alias("j"), F.lit(False).alias("asks"), "component", "doc", "set")
    every = F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("j")
    ask = asking.join(n_asking, "cell").select("cell", own("m").alias("i"), every, F.lit(True).alias("asks"), "component", "doc", "set")
    # A key's sets are a block, or several of which each two meet.
    ends = lambda asks: [F.lit(asks).alias("asks"), "component", "doc", "set"]
    every = F.explode(F.sequence(F.lit(0), blocks("m") - 1))
    keys_ask = by_key.select(F.col("key").alias("cell"), own("m").alias("i"), every.alias("j"), *ends(True))
    keys_whole = by_key.where(F.col("m") > cell_size).select(F.col("key").alias("cell"), every.alias("i"), own("m").alias("j"), *ends(False))
    dealt = ask.unionByName(whole).unionByName(keys_ask).unionByName(keys_whole)
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", F.col("asks").desc(), "doc")
    found = dealt.mapInArrow(lambda it: _block_batches(it, percent), "a long, b long")
    return sure.unionByName(found)


def keep_one_per_group(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per component: that of the doc_id which names it. Rows that share a doc_id are one document.

    Of a component without any id one row stays. Rows without words are linked with nothing, and those of null doc_id all stay.
    """
    folder = new_folder(docs.sparkSession, "kept")
    made, named = _linked_classes(docs, folder, n, percent, CELL)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    comps = made.where("doc_id is not null").join(named, ["d1", "d2"], "left").select("doc_id", component.alias("component_id"))
    ids = comps.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    ids = written(ids.where("least < doc_id or n > 1").select("doc_id", (F.col("least") == F.col("doc_id")).alias("stays")), folder, "ids")
    once = docs.where("doc_id is not null").join(few(ids.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    repeated = ids.where("stays").select("doc_id")
    if repeated.take(1):
        once = once.unionByName(docs.join(few(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
    nameless = docs.where("doc_id is null")
    if nameless.take(1):
        once = once.unionByName(_kept_without_id(nameless, named, n))
    return once


def _kept_without_id(docs: DataFrame, named: DataFrame, n: int) -> DataFrame:
    """Of rows without an id: those without words, and one of each component that has no id."""
    names, column = [], docs.columns.index("text")
    for name in ("d1", "d2"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch, column):
                digests = [_digest(own) for own in shingle_sets(data, offsets, n)]
                part = batch.slice(at, to - at)
                for k, name in enumerate(names):
                    part = part.append_column(name, pa.array([d[k] for d in digests], pa.int64()))
                yield part

    marked = docs.mapInArrow(mark, StructType([*docs.schema.fields, *(StructField(name, LongType()) for name in names)]))
    first = named.where("component_id is null").groupBy("root").agg(F.min(F.struct("d1", "d2")).alias("of"))
    first = first.select(*(F.col(f"of.d{k + 1}").alias(name) for k, name in enumerate(names)))
    kept = marked.join(first, names, "left_semi").dropDuplicates(names)
    return marked.where(F.col(names[0]).isNull()).unionByName(kept).select(*docs.columns)
