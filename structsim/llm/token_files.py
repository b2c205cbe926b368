"""Token ids in directly addressable code files.

A file holds the documents of one run of ascending doc_ids, up to about ``FILE_TOKENS`` ids. Ids are split into 8-bit
chunks: level 0 has the lowest chunk of every id, level k the next chunk of those ids that go on. A bitmap per level
marks the ids that go on, and a rank directory has the number of marks before every 512th bit, so any id is read by
one rank per level, without decoding its neighbours.

Layout, little-endian: ``DAC1``, u32 documents, u32 levels, u64 ids; i64 doc_id (the least value for null) and u64
end of each document; then per level u64 n, n chunk bytes, and but for the last level the bitmap's ceil(n / 8) bytes
and ceil(n / 512) u32 ranks.

Spark's own writer commits the files as binary rows of a table, so a lost executor leaves no half-written file and any
store that Spark can write will do; ``token_at`` reads single ids out of them.

Null and empty texts have just the end id. Repeated rows are written each on their own, in the order of their texts.
Extra columns are not read. An empty table gives no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.llm.tokens import END_ID, default_tokenizer, encoded_slices
from structsim.llm.workspace import new_folder, written

FILE_TOKENS = 1_000_000
_NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIIQ")
FILES = "part int, seq int, first_token long, n_tokens long, n_docs long, payload binary"


def pack_levels(ids: np.ndarray) -> list[bytes]:
    """The levels of an array of unsigned ids."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        on = rest > 255
        out += [struct.pack("<Q", len(rest)), (rest & np.uint64(255)).astype(np.uint8).tobytes()]
        if not on.any():
            return out
        ranks = np.append(0, np.cumsum(np.add.reduceat(on, np.arange(0, len(on), 512), dtype=np.int64)))[:-1]
        out += [np.packbits(on, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[on] >> np.uint64(8)


def pack_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    n_levels = (len(levels) + 2) // 4
    docs = np.array([_NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(b"DAC1", len(docs), n_levels, len(ids)), docs.tobytes(), ends.astype("<u8").tobytes(), *levels])


class TokenFile:
    """A file's parts, as views of its bytes."""

    def __init__(self, payload: bytes):
        magic, n_docs, n_levels, self.n_tokens = _HEAD.unpack_from(payload)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 token file")
        at = _HEAD.size
        self.docs = np.frombuffer(payload, "<i8", n_docs, at)
        self.ends = np.frombuffer(payload, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for k in range(n_levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            chunks, marks, ranks = np.frombuffer(payload, np.uint8, n, at + 8), None, None
            at += 8 + n
            if k < n_levels - 1:
                marks = np.frombuffer(payload, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(payload, "<u4", -(-n // 512), at + len(marks))
                at += len(marks) + 4 * len(ranks)
            self.levels.append((chunks, marks, ranks))

    def __getitem__(self, k: int) -> int:
        """The k-th id, by one rank per level."""
        value = 0
        for depth, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[k]) << (8 * depth)
            if marks is None or not marks[k >> 3] >> (k & 7) & 1:
                break
            block = k >> 9
            inside = np.unpackbits(marks[block << 6 : (k >> 3) + 1], bitorder="little")[: k - (block << 9)]
            k = int(ranks[block]) + int(inside.sum())
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out, places = np.zeros(self.n_tokens, np.uint32), None
        for depth, (chunks, marks, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * depth)
            if places is None:
                out |= part
            else:
                out[places] |= part
            if marks is not None:
                on = np.flatnonzero(np.unpackbits(marks, count=len(chunks), bitorder="little"))
                places = on if places is None else places[on]
        return out


def _file_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    part, seq, first = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    n = 0

    def file() -> pa.RecordBatch:
        ids = np.concatenate(held)
        payload = pack_file(docs, np.cumsum(np.concatenate(lengths)), ids)
        return pa.record_batch([pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (first, pa.int64()), (len(ids), pa.int64()), (len(docs), pa.int64()), (payload, pa.binary()))], names=["part", "seq", "first_token", "n_tokens", "n_docs", "payload"])

    for batch in batches:
        for at, to, ids, ends in encoded_slices(batch, 1, path, end_id):
            docs += batch.column(0).slice(at, to - at).to_pylist()
            held.append(ids)
            lengths.append(np.diff(ends, prepend=0))
            n += len(ids)
            if n >= most:
                yield file()
                seq, first, n = seq + 1, first + n, 0
                docs, held, lengths = [], [], []
    if docs:
        yield file()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes (doc_id, text) and writes the ids in ascending doc_id order; returns the table of files.

    Documents are dealt by ranges of doc_id, so tasks hold consecutive runs and part, seq order is doc_id order.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(lambda it: _file_batches(it, path, end_id, file_tokens), FILES), folder, "token_files")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds ``file_start``, the ids in all files before. Only one row per partition meets in the running sum."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row per partition of the writing job, so its size is bounded by the number of tasks.
    running = F.sum("part_tokens").over(_part_order()) - F.col("part_tokens")
    return files.join(F.broadcast(parts.select("part", running.alias("part_start"))), "part").withColumn("file_start", F.col("part_start") + F.col("first_token"))


def _part_order():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            file = TokenFile(payload.as_py())
            raw = memoryview(file.ids().astype("<u4")).cast("B")
            ends = file.ends
            begins = ends - np.diff(ends, prepend=0)
            crcs = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            docs = pa.array(file.docs, mask=file.docs == _NO_ID)
            yield pa.record_batch([docs, pa.array(begins + start), pa.array(ends - begins), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    # A task takes whole files, of which a few are held at a time.
    return with_starts(files).select("file_start", "payload").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids at the positions (``position`` long, counted over all documents) of ``wanted``, without decoding files whole.

    Positions are joined with the files' ranges by position bucket; positions outside get no row. Returns position, id.
    """
    ranges = with_starts(files).withColumn("bucket", F.explode(F.sequence((F.col("file_start") / FILE_TOKENS).cast("long"), ((F.col("file_start") + F.col("n_tokens") - 1) / FILE_TOKENS).cast("long"))))
    asked = wanted.select("position").withColumn("bucket", (F.col("position") / FILE_TOKENS).cast("long"))
    hits = asked.join(ranges, "bucket").where((F.col("position") >= F.col("file_start")) & (F.col("position") < F.col("file_start") + F.col("n_tokens")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            got, last, file = [], None, None
            for k, payload in enumerate(batch.column(2)):
                if (key := int(start[k])) != last:
                    file, last = TokenFile(payload.as_py()), key
                got.append(file[int(place[k] - start[k])])
            yield pa.record_batch([pa.array(place, pa.int64()), pa.array(got, pa.int64())], names=["position", "id"])

    return hits.select("position", "file_start", "payload").mapInArrow(read, "position long, id long")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` to a fresh shared folder and returns ``document_digests`` of what was written."""
    return document_digests(write_token_files(docs, new_folder(docs.sparkSession, "token-files"), tokenizer))
