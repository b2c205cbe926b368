"""Sweeps over the fragments of a file by their spans: nesting, and overlapping blocks.

Fragments are dealt by path and sorted by where they begin, longer ones first, so whatever holds a fragment comes before
it. A sweep keeps the fragments that reach beyond the present one's start: a chain of nested ones, and of blocks no more
than share a statement.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = ("fragment_id", "path", "kind", "start_byte", "end_byte")


def _dealt(fragments: DataFrame, *columns: str) -> DataFrame:
    longer_first = F.col("end_byte").desc()
    return fragments.select(*_SPAN, *columns).repartition("path").sortWithinPartitions("path", "start_byte", longer_first, "fragment_id")


def annotate_nesting(fragments: DataFrame) -> DataFrame:
    """Adds parent_id, the smallest fragment of the file that strictly holds this one, parent_fingerprint (where
    fragments have a fingerprint) and nesting_depth, the number of parents up from it.

    Equal spans never nest, blocks are not parents of blocks; of equally small ones the first fragment_id is taken.
    """
    prints = "fingerprint" in fragments.columns
    key = fragments.schema["fragment_id"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ones = None, []
        for batch in batches:
            out = []
            for fragment, path, kind, start, end, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != at:
                    at, open_ones = path, []
                open_ones = [o for o in open_ones if o[2] > start or o[2] >= end]
                held = [o for o in open_ones if o[2] >= end and (o[1], o[2]) != (start, end) and not o[3] == kind == "block"]
                depth, parent = 0, None
                if held:
                    parent = min(held, key=lambda o: (o[2] - o[1], o[0]))
                    depth = parent[4] + 1
                    out.append((fragment, parent[0], parent[5], depth))
                open_ones.append((fragment, start, end, kind, depth, own))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            ids = batch.schema.field(0).type
            types = (ids, ids, pa.string(), pa.int64())
            names = ["fragment_id", "parent_id", "parent_fingerprint", "nesting_depth"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    own = F.col("fingerprint") if prints else F.lit(None).cast("string")
    swept = _dealt(fragments.withColumn("_own", own), "_own")
    schema = f"fragment_id {key}, parent_id {key}, parent_fingerprint string, nesting_depth long"
    held = swept.mapInArrow(sweep, schema)
    return fragments.join(held if prints else held.drop("parent_fingerprint"), "fragment_id", "left").na.fill({"nesting_depth": 0})


def overlapping_blocks(fragments: DataFrame) -> DataFrame:
    """(l_id, r_id): pairs of blocks of one path whose spans share a byte, l_id < r_id.

    A block overlaps those of its container that share a statement with it, and those above and below these, so the pairs
    grow with the blocks.
    """
    key = fragments.schema["fragment_id"].dataType.simpleString()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ones = None, []
        for batch in batches:
            left, right = [], []
            for fragment, path, _, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                open_ones = [o for o in open_ones if o[1] > start] if path == at else []
                at = path
                for other, _ in open_ones if end > start else ():
                    left.append(min(fragment, other))
                    right.append(max(fragment, other))
                open_ones.append((fragment, end))
            ids = batch.schema.field(0).type
            yield pa.record_batch([pa.array(left, ids), pa.array(right, ids)], names=["l_id", "r_id"])

    return _dealt(fragments.where("kind = 'block'")).mapInArrow(sweep, f"l_id {key}, r_id {key}")
