"""Where large bags meet: in parts of them, so that what is sent for a meeting place does not grow with the bag.

A bag of ``size`` words is dealt over a power of two of parts, each word by its number and by which of its occurrences it is, so
that parts have about ``WORDS`` to twice as many words. Of two bags whose weighted Jaccard similarity reaches a threshold some
part's does, as the whole's is no more than the best part's (shared weights and unions add up over parts). So parts are joined by
prefix instead of bags, with the threshold of the whole. The smaller bag of a pair says how many parts there are; a bag near
the next number is dealt twice.

A part goes to the list of each feature of its prefix with its size, the weight ahead, the features just ahead and a sketch of
``BITS`` parities. Lists share cells; a task's rows of a cell are one row of arrays. All is made where the bags are, and
shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Least words of a part of a bag that has several, and bits of a part's sketch, two words of 64.
WORDS, BITS = 64, 128
#: Features just ahead of a prefix's feature that tell whether a pair met there.
AHEAD = 2
#: Words that a task deals at once, and rows of a cell, about.
DEALT, ROWS = 1 << 20, 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Columns of a cell's rows that are arrays.
ARRAYS = {"list": LongType(), "fc": IntegerType(), "size": IntegerType(), "before": IntegerType(), "last": LongType(), "sketch": LongType(), "block": IntegerType()}


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number of each."""
    x = x.astype(np.uint64) * _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def levels(fc: np.ndarray) -> np.ndarray:
    """The binary logarithm of the number of parts of bags of these sizes."""
    return np.maximum(np.frexp(np.maximum(fc, 1) // WORDS)[1] - 1, 0)


def dealt(features: np.ndarray, cnts: np.ndarray, row: np.ndarray, level: np.ndarray, threshold: float, whole: bool = True) -> dict[str, np.ndarray]:
    """The prefixes of the parts of bags: row, list, feature, size, before, last, sketch, as arrays with an entry a place.

    features, cnts, row: the bags' entries, row by row, features rarest first; level: of each row. Without ``whole`` only
    row, list and feature.
    """
    entry = np.repeat(np.arange(len(row)), cnts)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(cnts) - cnts, cnts)
    base = np.cumsum(1 << level) - (1 << level)
    own = mixed(features)
    part = base[row[entry]] + ((own[entry] >> np.uint64(32)).astype(np.int64) + nth & (1 << level[row[entry]]) - 1)
    order = np.argsort(part, kind="stable")
    part, entry, nth = part[order], entry[order], nth[order]
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    size = np.diff(begins, append=len(part))
    nth_part = np.repeat(np.arange(len(begins)), size)
    runs = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(entry, prepend=-1) != 0))
    of = nth_part[runs]
    before = runs - begins[of]
    kept = np.flatnonzero(before <= size[of] - np.ceil(threshold * size[of] - 1e-9).astype(np.int64))
    at, first = of[kept], runs[kept]
    rows, feature = row[entry[first]], own[entry[first]]
    number = (part[first] - base[rows]).astype(np.uint64)
    key = mixed(feature + (number << np.uint64(5)) + level[rows].astype(np.uint64))
    lists = (key & ~np.uint64(31) | level[rows].astype(np.uint64)).view(np.int64)
    out = {"row": rows, "list": lists, "feature": features[entry[first]]}
    if not whole:
        return out
    bit = mixed(own[entry] + nth.astype(np.uint64)) >> np.uint64(57)
    flags = np.uint64(1) << (bit & np.uint64(63))
    low = np.bitwise_xor.reduceat(np.where(bit < 64, flags, np.uint64(0)), begins)
    high = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), flags), begins)
    last = np.empty((len(kept), AHEAD), np.int64)
    for k in range(1, AHEAD + 1):
        there = np.maximum(kept - k, 0)
        last[:, k - 1] = np.where((kept >= k) & (of[there] == of[kept]), features[entry[runs[there]]], np.iinfo(np.int64).min)
    sketch = np.stack([low[at], high[at]], axis=1).view(np.int64)
    return out | {"size": size[at], "before": before[kept], "last": last, "sketch": sketch}


def _slices(cnts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``DEALT`` words; ``ends`` of each row's entries."""
    upto = np.concatenate([[0], np.cumsum(cnts)])[ends]
    begin = 0
    while begin < len(ends):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + DEALT, "right")))
        yield begin, end
        begin = end


def _places(batch: pa.RecordBatch, threshold: float, whole: bool = True) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """The places of a batch of packed bags, some rows at a time: (fc of all rows, ``dealt``), once for each number of parts that a row has."""
    fc = batch.column("fc").to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(batch.column("features")).to_numpy())
    features, cnts = batch.column("features").flatten().to_numpy(), batch.column("cnts").flatten().to_numpy()
    high, least = levels(fc), levels(np.ceil(threshold * fc - 1e-9).astype(np.int64))
    for begin, end in _slices(cnts, ends):
        first = ends[begin - 1] if begin else 0
        row = np.repeat(np.arange(begin, end), np.diff(ends[begin:end], prepend=first))
        some, its = features[first : ends[end - 1]], cnts[first : ends[end - 1]]
        for down in range(int((high - least)[begin:end].max()) + 1):
            level = high - down
            has = (level >= least)[row]
            if has.any():
                # Rows that are not dealt at this level have no entries, so theirs does not matter.
                yield fc, dealt(some[has], its[has], row[has], np.maximum(level, 0), threshold, whole)


def near_class(fc: np.ndarray, threshold: float) -> np.ndarray:
    """Sizes that may be similar lie in the same class or in neighbours."""
    return np.floor(np.log(fc) / math.log(1.001 / threshold)).astype(np.int64)


def long_lists(packed: DataFrame, threshold: float, least: int, longest: int) -> dict[tuple[str, int], dict[int, int]]:
    """Blocks of each class of sizes of the lists of more than ``longest`` places: {(part, list): {class: blocks}}.

    Only features numbered ``least`` or above are looked at. There are no more such lists than a ``longest``-th of all places.
    """
    schema = "part string, list long, near long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = np.unique(batch.column("part").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for fc, at in _places(batch, threshold, False):
                some = np.flatnonzero(at["feature"] >= least)
                rows = at["row"][some]
                found, n = np.unique(np.stack([code[rows], at["list"][some], near_class(fc[rows], threshold)]), axis=1, return_counts=True)
                yield pa.record_batch([pa.array(names[found[0]], pa.string()), pa.array(found[1]), pa.array(found[2]), pa.array(n.astype(np.int64))], names=["part", "list", "near", "n"])

    each = packed.select("part", "fc", "features", "cnts").mapInArrow(count, schema).groupBy("part", "list", "near").agg(F.sum("n").alias("n"))
    total = each.groupBy("part", "list").agg(F.sum("n").alias("all"), F.collect_list(F.struct("near", "n")).alias("each"))
    out = {}
    for r in total.where(F.col("all") > longest).collect():
        out[r["part"], r["list"]] = {e["near"]: -(-e["n"] // longest) for e in r["each"]}
    return out


def sent(packed: DataFrame, threshold: float, cells: int, label: str | None, blocks: dict[tuple[str, int], dict[int, int]]) -> DataFrame:
    """Places of ``packed`` (part, profile_id, fc, focused, features, cnts, label) by cell: part, cell, x, y, ``ARRAYS``, profile_id, focused, label.

    The lists of ``blocks`` are dealt over them, each two of which that are near enough are a cell of their own (x, y).
    """
    ids = packed.schema["profile_id"].dataType
    columns = [StructField(c, ArrayType(t)) for c, t in ARRAYS.items()]
    columns += [StructField("profile_id", ArrayType(ids)), StructField("focused", ArrayType(BooleanType())), StructField("label", ArrayType(StringType()))]
    schema = StructType([StructField("part", StringType()), *(StructField(c, LongType()) for c in ("cell", "x", "y")), *columns])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for part, of in blocks:
            known.setdefault(part, []).append(of)
        known = {p: np.sort(np.array(x, np.int64)) for p, x in known.items()}
        for batch in batches:
            names, code = np.unique(batch.column("part").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for fc, at in _places(batch, threshold):
                n = len(at["row"])
                cell = (at["list"].view(np.uint64) >> np.uint64(5)).astype(np.int64) % cells
                take, x, y, block = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                long = np.zeros(n, bool)
                for k, name in enumerate(names):
                    if name in known:
                        its = known[name]
                        there = np.minimum(np.searchsorted(its, at["list"]), len(its) - 1)
                        long |= (code[at["row"]] == k) & (its[there] == at["list"])
                if long.any():
                    more = _in_blocks(np.flatnonzero(long), at, fc, names[code[at["row"]]], blocks, threshold, batch)
                    take, cell, x, y, block = (np.concatenate([a[~long], b]) for a, b in zip((take, cell, x, y, block), more, strict=True))
                rows = at["row"][take]
                order = np.lexsort((at["list"][take], y, x, cell, code[rows]))
                take, cell, x, y, block, rows = (a[order] for a in (take, cell, x, y, block, rows))
                key = np.stack([code[rows], cell, x, y])
                begins = np.flatnonzero(np.any(np.diff(key, axis=1, prepend=-1 - key[:, :1]) != 0, axis=0))
                ends = np.append(begins, len(rows)).astype(np.int32)
                lists = lambda values, wide=1: pa.ListArray.from_arrays(pa.array(ends * wide, pa.int32()), values)
                own = {
                    "list": pa.array(at["list"][take]), "fc": pa.array(fc[rows], pa.int32()), "size": pa.array(at["size"][take], pa.int32()),
                    "before": pa.array(at["before"][take], pa.int32()), "last": pa.array(at["last"][take].ravel()), "sketch": pa.array(at["sketch"][take].ravel()), "block": pa.array(block, pa.int32()),
                }
                wide = {"last": AHEAD, "sketch": BITS // 64}
                made = [lists(own[c], wide.get(c, 1)) for c in ARRAYS]
                made += [lists(batch.column(c).take(pa.array(rows))) for c in ("profile_id", "focused", "label")]
                head = [pa.array(names[code[rows[begins]]], pa.string()), *(pa.array(a[begins], pa.int64()) for a in (cell, x, y))]
                yield pa.record_batch([*head, *made], names=["part", "cell", "x", "y", *ARRAYS, "profile_id", "focused", "label"])

    named = F.col(label).cast("string") if label else F.lit(None).cast("string")
    return packed.select("part", "profile_id", "fc", F.coalesce("focused", F.lit(False)).alias("focused"), "features", "cnts", named.alias("label")).mapInArrow(send, schema)


def _in_blocks(some: np.ndarray, at: dict, fc: np.ndarray, part: np.ndarray, blocks: dict, threshold: float, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(place, cell, x, y, block) of places of long lists, each once for every block that its own meets."""
    near = near_class(fc, threshold)
    ids = np.array([hash(i) if isinstance(i, int) else int.from_bytes(str(i).encode()[-8:], "big") % (1 << 62) for i in batch.column("profile_id").to_pylist()], np.int64)
    spread = mixed(ids)
    out: list[list[int]] = [[], [], [], [], []]
    for k in some.tolist():
        row, of = int(at["row"][k]), int(at["list"][k])
        classes = blocks[part[k], of]
        first = {c: sum(n for other, n in classes.items() if other < c) for c in classes}
        own = first[int(near[row])] + int(spread[row]) % classes[int(near[row])]
        for c in (near[row] - 1, near[row], near[row] + 1):
            for other in range(first.get(int(c), 0), first.get(int(c), 0) + classes.get(int(c), 0)):
                for column, v in zip(out, (k, -1 - (of & 0x7FFFFFFFFFFFFFF), min(own, other), max(own, other), own), strict=True):
                    column.append(v)
    return tuple(np.array(c, np.int64) for c in out)


def opened(cells: pa.Table) -> dict[str, np.ndarray | pa.Array]:
    """The arrays of a cell's rows, in order of list and size."""
    cells = cells.combine_chunks()
    flat = {c: pc.list_flatten(cells.column(c)).combine_chunks() for c in [*ARRAYS, "profile_id", "focused", "label"]}
    order = np.lexsort((flat["size"].to_numpy(), flat["list"].to_numpy()))
    take = pa.array(order)
    out = {c: flat[c].to_numpy().astype(np.int64, copy=False)[order] for c in ("list", "fc", "size", "before", "block")}
    out["last"] = flat["last"].to_numpy().reshape(-1, AHEAD)[order]
    out["sketch"] = flat["sketch"].to_numpy().view(np.uint64).reshape(-1, BITS // 64)[order]
    out["focused"] = flat["focused"].to_numpy(zero_copy_only=False).astype(bool)[order]
    return out | {"profile_id": flat["profile_id"].take(take), "label": flat["label"].take(take)}


def met_in_parts(
    packed: DataFrame, threshold: float, label: str | None, allowed: Callable[[pa.Array], tuple[np.ndarray, np.ndarray | None]], near: Callable, focused_only: bool, least: int, longest: int
) -> DataFrame:
    """(a_id, b_id, a_fc, b_fc) of different profiles a part of which may be similar; a pair may come several times.

    allowed: codes of labels, and which may meet which (None: all); near: pairs of a list and near sizes (``simjoin._near``);
    least, longest: as in ``long_lists``.
    """
    total = packed.agg(F.sum("fc")).first()[0] or 0
    cells = max(1, int(total * (1 - threshold)) // ROWS)
    blocks = long_lists(packed, threshold, least, longest)
    kind = packed.schema["profile_id"].dataType
    schema = StructType([StructField("a_id", kind), StructField("b_id", kind), StructField("a_fc", LongType()), StructField("b_fc", LongType())])

    def check(cells: pa.Table) -> pa.Table:
        own = opened(cells)
        lists, fc, size, before, block, last, sketch, focus = (own[c] for c in ("list", "fc", "size", "before", "block", "last", "sketch", "focused"))
        _, key = np.unique(lists, return_inverse=True)
        code, may = allowed(own["label"])
        x, y = cells.column("x")[0].as_py(), cells.column("y")[0].as_py()
        sides = [np.flatnonzero(block == x), np.flatnonzero(block == y)] if x != y else [np.arange(len(key))]
        ls, rs = [], []
        for l, r in near(key, size, sides[0], sides[1] if x != y else None, threshold):
            shorter = np.minimum(fc[l], fc[r])
            total = size[l] + size[r]
            need = np.ceil(threshold / (1 + threshold) * total - 1e-6)
            good = (np.minimum(size[l] - before[l], size[r] - before[r]) >= need) & (shorter / np.maximum(fc[l], fc[r]) >= threshold)
            l, r, room = l[good], r[good], (total - 2 * need)[good]
            good = np.bitwise_count(sketch[l] ^ sketch[r]).sum(axis=1, dtype=np.int64) <= room
            l, r = l[good], r[good]
            good = levels(np.minimum(fc[l], fc[r])) == lists[l] & 31
            if focused_only:
                good &= focus[l] | focus[r]
            if may is not None:
                good &= may[code[l], code[r]]
            for i in range(AHEAD):
                for j in range(AHEAD):
                    good &= (last[l, i] != last[r, j]) | (last[l, i] == np.iinfo(np.int64).min)
            ls.append(l[good])
            rs.append(r[good])
        l, r = (np.concatenate(a) if a else np.zeros(0, np.int64) for a in (ls, rs))
        ids = own["profile_id"]
        return pa.table([ids.take(pa.array(l)), ids.take(pa.array(r)), pa.array(fc[l], pa.int64()), pa.array(fc[r], pa.int64())], names=schema.names)

    return sent(packed, threshold, cells, label, blocks).groupBy("part", "cell", "x", "y").applyInArrow(check, schema)
