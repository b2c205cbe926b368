"""What each filter of a set removes, alone and after others, in every order of the filters and every part of the corpus.

Each part (a language) is cut into ranges of documents in doc_id order. A range keeps, for every filter, the sorted list
of the documents that fail it, and such lists of good and of toxic documents: a posting list holds places in the range,
as ids may repeat, and ``ids`` has the id of each place. For every set of filters that may have come before another,
the lists are united and taken away from the other's by a k-way merge that gallops: it takes the lists block by block up
to a common bound, finds each list's end of the block by doubling steps, and takes over whole what only one list has.
Sizes are summed over ranges; the counts of all orders follow from them, as what a filter removes depends on the set of
its predecessors only.

A range holds at most ``RANGE`` documents whatever their ids, parts and texts are, so a hot part, id or text fills more
ranges, never a larger one. Documents are dealt by part, id and their place in the table.

Null texts are empty ones, a null part is the part "". Each row of the table counts, also where ids repeat. A row without
an id has no smaller id than another and none smaller than its own, so its text repeats nothing and makes nothing a
repetition; it has no labels. A document is good or toxic if any of its label rows says 1. Extra columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.workspace import new_folder, written

FILTERS = "ABCDE"
#: Least words; least share of distinct words and greatest share of capitals, in hundredths.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
RANGE = 65_536
#: Ids of a list that a merge looks at together.
STEP = 4096
_SPACE, _MARKS = "[ \\t\\n\\x0B\\f\\r]+", "[#$%&*|]"

_LISTS = (*FILTERS, "good", "toxic")
POSTINGS = "part string, n long, ids array<long>, " + ", ".join(f"`{name}` array<int>" for name in _LISTS)


def text_failures(documents: DataFrame) -> DataFrame:
    """(row, part, doc_id, digest, A, B, C, D): whether each row's own text fails; ``row`` is its place in the table."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("text", _SPACE), lambda w: w != "")
    part = F.coalesce("lang", F.lit("")).alias("part")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), part, "doc_id", text.alias("text"))
    rows = rows.select("row", "part", "doc_id", "text", words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return rows.select(
        "row", "part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"),
        (n < WORDS).alias("A"), (distinct * 100 < n * DISTINCT).alias("B"),
        (capitals * 100 > F.length("text") * CAPITALS).alias("C"), F.col("text").rlike(_MARKS).alias("D"),
    )


def failures(documents: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """(row, part, doc_id, A to E, good, toxic): ``text_failures``, repeated texts, and the labels."""
    own = written(text_failures(documents), folder, "texts")
    repeated = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # stored, as Spark splits hot keys of a join of two shuffled tables only where neither is an aggregate
    repeated = written(repeated.where("last > first").select("digest", "first"), folder, "repeated")
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*marks).where("good or toxic")
    marked = written(marked, folder, "marked")
    known = own.join(repeated, "digest", "left").join(marked, "doc_id", "left")
    no = F.lit(False)
    return known.select(
        "row", "part", "doc_id", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"),
        F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
    )


def posting_lists(failed: DataFrame, size: int = RANGE) -> DataFrame:
    """One row for each range of documents of a part (``POSTINGS``), from ``failures``."""
    parts = int(failed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = failed.repartitionByRange(parts, "part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    names = ["part", "n", "ids", *_LISTS]

    def listed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [np.flatnonzero(table.column(name).to_numpy()).astype(np.int32) for name in _LISTS]
        values = [table.column("part")[0].as_py(), table.num_rows, table.column("doc_id").to_pylist(), *lists]
        types = [pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * len(_LISTS)]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, None
        for batch in batches:
            part = np.array(batch.column("part").to_pylist(), dtype=object)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (part[a] != at or n == size):
                        yield listed(held)
                        held, n = [], 0
                    take = min(b - a, size - n)
                    held.append(batch.slice(a, take))
                    at, n, a = part[a], n + take, a + take
        if held:
            yield listed(held)

    return dealt.select("part", "doc_id", *_LISTS).mapInArrow(ranges, POSTINGS)


def gallop(ids: np.ndarray, start: int, bound: int) -> int:
    """The first place from ``start`` on whose id is above ``bound``: doubling steps, then a search in the last step."""
    step, at = 1, start
    while at + step < len(ids) and ids[at + step] <= bound:
        at += step
        step *= 2
    return at + int(np.searchsorted(ids[at : at + step + 1], bound, side="right"))


def blocks(lists: list[np.ndarray], step: int = STEP) -> Iterator[list[np.ndarray]]:
    """The lists side by side, cut at common bounds: each time up to the least end of the lists' next ``step`` ids."""
    at = [0] * len(lists)
    while any(a < len(ids) for a, ids in zip(at, lists, strict=True)):
        bound = min(ids[min(a + step, len(ids)) - 1] for a, ids in zip(at, lists, strict=True) if a < len(ids))
        ends = [gallop(ids, a, bound) if a < len(ids) else a for a, ids in zip(at, lists, strict=True)]
        yield [ids[a:b] for a, b, ids in zip(at, ends, lists, strict=True)]
        at = ends


def within(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which ids of a sorted block are also in another, by search for each."""
    if not len(short) or not len(long):
        return np.zeros(len(short), dtype=bool)
    place = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return long[place] == short


def union(lists: list[np.ndarray], step: int = STEP) -> np.ndarray:
    """The ids of any list, sorted."""
    out = []
    for cut in blocks(lists, step):
        some = [ids for ids in cut if len(ids)]
        merged = some[0]
        for ids in some[1:]:
            fresh = ids[~within(ids, merged)]
            merged = np.insert(merged, np.searchsorted(merged, fresh), fresh) if len(fresh) else merged
        out.append(merged)
    return np.concatenate(out) if out else np.empty(0, np.int32)


def difference(ids: np.ndarray, others: np.ndarray, step: int = STEP) -> np.ndarray:
    """The ids that are not among the others, sorted."""
    out = [own[~within(own, rest)] for own, rest in blocks([ids, others], step) if len(own)]
    return np.concatenate(out) if out else np.empty(0, np.int32)


def shared(ids: np.ndarray, others: np.ndarray, step: int = STEP) -> int:
    """How many ids are in both lists."""
    return sum(int(within(own, rest).sum()) for own, rest in blocks([ids, others], step) if len(own) and len(rest))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, filter and set of predecessors (a bit a filter): what the filter removes after them."""
    names = ["part", "n", "filter", "before", "failing", "removed", "good_lost", "toxic_lost"]
    for batch in batches:
        for row in range(batch.num_rows):
            part, n = (batch.column(c)[row].as_py() for c in ("part", "n"))
            lists = {name: batch.column(name)[row].values.to_numpy() for name in _LISTS}
            sets = range(1 << len(FILTERS))
            united = [union([lists[f] for k, f in enumerate(FILTERS) if before >> k & 1]) for before in sets]
            out = []
            for k, name in enumerate(FILTERS):
                for before, gone in enumerate(united):
                    if not before >> k & 1:
                        removed = difference(lists[name], gone)
                        lost = [shared(removed, lists[x]) for x in ("good", "toxic")]
                        out.append((part, n, k, before, len(lists[name]), len(removed), *lost))
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def removals(postings: DataFrame) -> DataFrame:
    """(part, n, filter, before, failing, removed, good_lost, toxic_lost): sums over the ranges of each part."""
    kept = postings.select("part", "n", *_LISTS)
    counts = ("n", "failing", "removed", "good_lost", "toxic_lost")
    schema = "part string, n long, filter int, before int, failing long, removed long, good_lost long, toxic_lost long"
    sized = kept.mapInArrow(_sized, schema)
    sums = [F.sum(c).alias(c) for c in counts]
    return sized.groupBy("part", "filter", "before").agg(*sums)


def _steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, before) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order):
            out.append((name, step + 1, k, before))
            before |= 1 << k
    return out


def audit_filters(documents: DataFrame, labels: DataFrame, size: int = RANGE) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, folder = documents.sparkSession, new_folder(documents.sparkSession, "filter-audit")
    postings = written(posting_lists(failures(documents, labels, folder), size), folder, "postings")
    gone = written(removals(postings), folder, "removals")
    # a set of s predecessors stands before a filter in s! (4 - s)! orders
    earlier_ones, others = F.bit_count("before"), F.lit(len(FILTERS) - 1)
    weight = F.factorial(earlier_ones) * F.factorial(others - earlier_ones)
    alone = F.sum(F.when(earlier_ones == others, F.col("removed")).otherwise(0))
    whole = gone.groupBy("part", "filter").agg(alone.alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    steps = spark.createDataFrame(_steps(), "filter_order string, step int, filter int, before int")
    rows = gone.join(F.broadcast(steps), ["filter", "before"]).join(whole, ["part", "filter"])
    earlier = F.expr("sum(removed) over (partition by part, filter_order order by step)")
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - earlier).alias("kept"), "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
