"""Features of syntax nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a batch of windows, but for a single longer one.
BATCH = 1 << 20


def literal_digests(rows: DataFrame, key: str, text: str, pattern: str, canonical: str = "number") -> DataFrame:
    """(fragment_id, literal_digests): SHA-256 of canonical name, NUL and the literal, in text order."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    return rows.select(F.col(key).alias("fragment_id"), F.transform(found, lambda x: F.sha2(F.concat(F.lit(canonical + "\x00"), x).cast("binary"), 256)).alias("literal_digests"))


_CONTAINER = ("path", "function", "container")


def statement_windows(statements: DataFrame, size: int, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, functions over the cap): every ``size`` consecutive statements of a container.

    statements: path, function, container, pos, start_byte, end_byte, start_line, end_line. Blocks of one function with
    the same span count once, as of the first container, and ``first`` is the number of their first statement in it. A
    function with more than ``cap`` blocks has none and is reported; without a cap all functions have all of theirs.
    """
    own = Window.partitionBy(*_CONTAINER).orderBy("pos")
    order = own.rowsBetween(0, size - 1)
    last = lambda c: F.last(c).over(order).alias(c)
    ends = [F.col("start_byte"), last("end_byte"), F.col("start_line"), last("end_line")]
    wide = statements.select(*_CONTAINER, *ends, F.row_number().over(own).alias("first"), F.count("*").over(order).alias("_n"))
    span = ["path", "function", "start_byte", "end_byte"]
    at = F.min(F.struct("container", "first", "start_line", "end_line")).alias("at")
    blocks = wide.where(F.col("_n") == size).groupBy(*span).agg(at).select(*span, "at.*")
    counted = blocks.groupBy("path", "function").agg(F.count("*").alias("n_blocks"))
    over = counted.where(F.lit(False) if cap is None else F.col("n_blocks") > cap)
    kept = blocks if cap is None else blocks.join(counted.where(F.col("n_blocks") <= cap).select("path", "function"), ["path", "function"])
    name = F.concat(F.lit("block@"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return kept.withColumn("name", name).withColumn("kind", F.lit("block")), over


def text_windows(texts: DataFrame, size: int) -> DataFrame:
    """Every ``size`` consecutive lines of texts (path, text), as ``statement_windows`` gives them of lines, with their text.

    path, first, start_byte, end_byte (in characters), start_line, end_line, name, kind, text. A text's windows are made where
    it is. Texts that are null or have fewer lines have none.
    """
    schema = "path string, first int, start_byte long, end_byte long, start_line int, end_line int, name string, kind string, text string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, types[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines, start = [] if text is None else text.split("\n"), 0
                for k in range(1, len(lines) - size + 2):
                    own = "\n".join(lines[k - 1 : k - 1 + size])
                    rows.append((path, k, start, start + len(own), k, k + size - 1, f"block@{k}-{k + size - 1}", "block", own))
                    start, held = start + len(lines[k - 1]) + 1, held + len(own)
                    if held >= BATCH:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    return texts.select("path", "text").mapInArrow(cut, schema)


def window_bags(blocks: DataFrame, statements: DataFrame, bags: DataFrame, size: int, root: str | None = None) -> DataFrame:
    """(fragment_id, feature, cnt) of blocks (``statement_windows`` with a fragment_id) by the bags of their statements.

    bags: path, function, container, pos, feature, cnt. A statement's bag is made once and handed to each of the at most
    ``size`` windows over it; sums are taken where the features are. ``root``: a feature of the block itself.
    """
    nth = F.row_number().over(Window.partitionBy(*_CONTAINER).orderBy("pos"))
    numbered = statements.select(*_CONTAINER, "pos", nth.alias("nth"))
    over = F.explode(F.sequence(F.greatest(F.col("nth") - (size - 1), F.lit(1)), F.col("nth"))).alias("first")
    dealt = bags.join(numbered, [*_CONTAINER, "pos"]).select(*_CONTAINER, over, "feature", "cnt")
    found = dealt.join(blocks.select("fragment_id", *_CONTAINER, "first"), [*_CONTAINER, "first"]).select("fragment_id", "feature", "cnt")
    if root:
        found = found.unionByName(blocks.select("fragment_id", F.lit(root).alias("feature"), F.lit(1).alias("cnt")))
    return found.groupBy("fragment_id", "feature").agg(F.sum("cnt").cast("int").alias("cnt"))


def ordered_statements(statements: DataFrame) -> DataFrame:
    """(fragment_id, feature, cnt) of ``ordered:statement:<first, middle, last or only>:<shape>``.

    statements: fragment_id, container, pos, shape. All children count for the position; those without a shape give nothing.
    """
    own = Window.partitionBy("fragment_id", "container")
    nth, n = F.row_number().over(own.orderBy("pos")), F.count("*").over(own)
    place = F.when(n == 1, "only").when(nth == 1, "first").when(nth == n, "last").otherwise("middle")
    placed = statements.select("fragment_id", "shape", place.alias("place")).where("shape is not null and shape <> ''")
    return placed.select("fragment_id", F.concat_ws(":", F.lit("ordered:statement"), "place", "shape").alias("feature")).groupBy("fragment_id", "feature").agg(F.count("*").cast("int").alias("cnt"))


def call_slots(calls: DataFrame, most_calls: int = 8, most_slots: int = 8) -> DataFrame:
    """(fragment_id, feature, cnt) of ``ordered:call:<context>:callee-slot-k`` for the first calls.

    calls: fragment_id, pos, callee, context. Only fragments of 2 to 8 distinct callees; slots count the sorted callees from 0.
    """
    names = calls.select("fragment_id", "callee").distinct()
    slots = names.withColumn("slot", F.row_number().over(Window.partitionBy("fragment_id").orderBy("callee")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("fragment_id"))).where(F.col("n").between(2, most_slots))
    early = calls.withColumn("nth", F.row_number().over(Window.partitionBy("fragment_id").orderBy("pos"))).where(F.col("nth") <= most_calls)
    named = early.join(slots, ["fragment_id", "callee"]).select("fragment_id", F.concat_ws(":", F.lit("ordered:call"), "context", F.concat(F.lit("callee-slot-"), F.col("slot").cast("string"))).alias("feature"))
    return named.groupBy("fragment_id", "feature").agg(F.count("*").cast("int").alias("cnt"))
