"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

Each document is encoded whole with an end id. Longer ones are cut into full pieces, the first of which may be shorter.
Every piece that does not fill a sequence is placed where the sum of squared counts of open sequences per residual gap
becomes smallest, longest pieces first. Documents are dealt by hash into groups of about ``GROUP_ITEMS`` pieces that
are packed on their own, so a task's work is bounded and the number of groups follows the input.

Null and empty texts are a single end id. Repeated rows are pieces of their own. Extra columns are not read. Ties
between gaps go to the smallest gap; ties between pieces go by doc_id and piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.tokens import END_ID, default_tokenizer, encoded_slices
from structsim.llm.workspace import new_folder, small_batches, written

CAPACITY = 1024
GROUP_ITEMS = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, ids, ends in encoded_slices(batch, 1, path, end_id):
            total = np.diff(ends, prepend=0)
            pieces = -(-total // capacity)
            row = np.repeat(np.arange(to - at), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = total - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            begin = (ends - total)[row] + start
            raw = memoryview(ids).cast("B")
            parts = [raw[4 * b : 4 * e] for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).slice(at, to - at).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names=names)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each document of (doc_id, text): doc_id, piece, start, length, ids_crc32, and the ids if asked for."""
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(lambda it: _piece_batches(it, path, end_id, capacity, with_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order.

    With n(g) open sequences of gap g, filling one of gap g by a piece of length p changes the sum of squares by
    2 * (n(g - p) - n(g) + 1), or by 1 - 2 * n(p) if it becomes full; a new one adds 2 * n(capacity - p) + 1.
    """
    count = np.zeros(capacity + 1, np.float64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for k, p in enumerate(lengths.tolist()):
        if p >= capacity:
            sequence[k], made = made, made + 1
            continue
        here = count[p:capacity]
        change = np.where(here > 0, count[: capacity - p] - here + 1, np.inf)
        if here[0] > 0:
            change[0] = 0.5 - here[0]
        best = int(change.argmin())
        if change[best] <= count[capacity - p] + 0.5:
            gap = p + best
            sequence[k], offset[k] = open_at[gap].pop(), capacity - gap
            count[gap] -= 1
            left = best
        else:
            sequence[k], left, made = made, capacity - p, made + 1
        if left:
            count[left] += 1
            open_at[left].append(int(sequence[k]))
    return sequence, offset


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces (columns of ``token_pieces``), which is read twice.

    Only ids, lengths and digests are shuffled, never tokens.
    """
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group_items))
    names = [f.name for f in pieces.schema]

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        return frame[names].assign(sequence_id=sequence * groups + int(key[0]), offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # Full pieces need no partner: they stay where they are, and negative numbers keep their sequences apart.
    alone = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    shared = pieces.where(F.col("length") < capacity).groupBy(group.alias("group")).applyInPandas(pack, schema)
    return shared.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, with_ids: bool = False) -> DataFrame:
    """Packs all documents; one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    folder = new_folder(docs.sparkSession, "packing")
    return place_pieces(written(token_pieces(docs, tokenizer, capacity=capacity, with_ids=with_ids), folder, "pieces"), capacity, group_items)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences as ids, from ``pack_documents(..., with_ids=True)``: sequence_id, length, ids (little-endian u32).

    A sequence has at most ``capacity`` tokens, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
