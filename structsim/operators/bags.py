"""Feature bags: multisets of features per fragment, in long form (fragment_id, feature, cnt)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Columns of a fragment's location, in order.
LOCATION = ("path", "language", "family", "domain", "kind", "name", "start_line", "end_line")
#: Bytes of a batch of texts, but for a single longer one.
BATCH_BYTES = 4 << 20


def word_bags(texts: DataFrame, key: str = "fragment_id", text: str = "text", prefix: str = "word:") -> DataFrame:
    """Bags of lower-case words, split at blanks. Null and blank texts have no rows."""
    words = F.explode(F.split(F.lower(F.col(text)), r"[ \t\r\n]+")).alias("w")
    return texts.select(F.col(key).alias("fragment_id"), words).where("w <> ''").groupBy("fragment_id", F.concat(F.lit(prefix), "w").alias("feature")).agg(F.count("*").cast("int").alias("cnt"))


def with_words(texts: DataFrame, text: str = "text", prefix: str = "word:", prints: bool = False, root: str | None = None) -> DataFrame:
    """Adds ``entries``, the bag of words (``word_bags``) of each row's text as an array of (feature, cnt), and drops the text.

    A row's words are counted where the row is, without a shuffle, so rows of one key are bags of their own. With ``prints``
    feature_count, n_features and fingerprint of that bag come along, as ``fingerprints`` gives them. ``root``: a feature that
    each row's bag has once besides, before all that begin with ``prefix``.
    """
    if root is not None and root >= prefix:
        raise ValueError("a root comes before the words")
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    words = texts.withColumn("_words", F.coalesce(F.split(F.lower(F.col(text)), r"[ \t\r\n]+"), F.array().cast("array<string>"))).drop(text)
    entry = StructType([StructField("feature", StringType()), StructField("cnt", IntegerType())])
    facts = [StructField("feature_count", LongType()), StructField("n_features", LongType()), StructField("fingerprint", StringType())]
    fields = [StructField("entries", ArrayType(entry)), *(facts if prints else [])]
    schema = StructType([f for f in words.schema.fields if f.name != "_words"] + fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_words")
            names = column.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            # Codes are in byte order of the words, so that a bag comes as its fingerprint takes it.
            order = pc.sort_indices(names.dictionary).to_numpy()
            known, sorted_names = max(1, len(order)), names.dictionary.take(pa.array(order))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = place[names.indices.to_numpy(zero_copy_only=False)] if len(row) else np.zeros(0, np.int64)
            filled = pc.not_equal(sorted_names, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
            at, times = np.unique(row[filled] * known + code[filled], return_counts=True)
            features = pc.binary_join_element_wise(pa.scalar(prefix, sorted_names.type), sorted_names, pa.scalar("", sorted_names.type)).take(pa.array(at % known))
            ends = np.searchsorted(at // known, np.arange(len(batch) + 1)).astype(np.int32)
            if root is not None:
                places = np.insert(np.arange(len(times)), ends[:-1], len(times))
                features = pa.concat_arrays([features, pa.array([root], features.type)]).take(pa.array(places))
                times, ends = np.append(times, 1)[places], ends + np.arange(len(ends), dtype=np.int32)
            entries = pa.StructArray.from_arrays([features, pa.array(times, pa.int32())], names=["feature", "cnt"])
            made = [pa.ListArray.from_arrays(pa.array(ends), entries)]
            if prints:
                total = np.concatenate([[0], np.cumsum(times)])[ends]
                made += [pa.array(np.diff(x), pa.int64()) for x in (total, ends)] + [_digests(features, times, ends)]
            rest = [n for n in batch.schema.names if n != "_words"]
            yield pa.record_batch([*(batch.column(n) for n in rest), *made], names=[*rest, *(f.name for f in fields)])

    return words.mapInArrow(count, schema)


def _digests(features: pa.Array, times: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``fingerprint_of`` bags that follow one another, each from one of ``ends`` to the next, in byte order of features."""
    text = pa.string()
    parts = pc.binary_join_element_wise(features.cast(text), pa.scalar("\x1f", text), pa.array(times).cast(text), pa.scalar("\x1e", text), pa.scalar("", text))
    # Values of an array lie side by side, so a bag's text is a run of bytes.
    held = memoryview(parts.buffers()[2] or b"")
    starts = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :][ends] if len(parts) else np.zeros(len(ends), np.int32)
    return pa.array([hashlib.sha256(held[a:b]).hexdigest()[:16] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], text)


def listed_bags(rows: DataFrame) -> DataFrame:
    """(fragment_id, feature, cnt) of rows (fragment_id, entries)."""
    return rows.select("fragment_id", F.explode("entries").alias("e")).select("fragment_id", "e.feature", "e.cnt")


def table_bags(rows: DataFrame, key: Column | str, feature: Column | str, count: Column | None = None) -> DataFrame:
    """Bags of any keyed table: one feature per row, counted, or summed over ``count``."""
    key, feature = (F.col(x) if isinstance(x, str) else x for x in (key, feature))
    amount = F.count("*") if count is None else F.sum(count)
    return rows.select(key.alias("fragment_id"), feature.alias("feature"), *([] if count is None else [count])).where(key.isNotNull() & feature.isNotNull()).groupBy("fragment_id", "feature").agg(amount.cast("int").alias("cnt")).where("cnt > 0")


def merge_bags(bags: DataFrame, parts: DataFrame, root_feature: str = "node:root") -> DataFrame:
    """One bag per whole from the bags of its parts (part: fragment_id, whole: whole_id) and one root feature."""
    summed = bags.join(parts, "fragment_id").groupBy(F.col("whole_id").alias("fragment_id"), "feature").agg(F.sum("cnt").cast("int").alias("cnt"))
    root = parts.select(F.col("whole_id").alias("fragment_id")).distinct().select("fragment_id", F.lit(root_feature).alias("feature"), F.lit(1).alias("cnt"))
    return summed.unionByName(root).groupBy("fragment_id", "feature").agg(F.sum("cnt").cast("int").alias("cnt"))


def merge_rows(rows: DataFrame, root_feature: str = "node:root") -> DataFrame:
    """``merge_bags`` of rows (whole_id, entries) as ``with_words`` gives them: added up where the rows are, then shuffled."""
    root = F.array(F.struct(F.lit(root_feature).alias("feature"), F.lit(1).alias("cnt")))
    each = rows.select(F.col("whole_id").alias("fragment_id"), F.explode("entries").alias("e")).select("fragment_id", "e.*")
    roots = rows.select(F.col("whole_id").alias("fragment_id")).distinct().select("fragment_id", F.explode(root).alias("e")).select("fragment_id", "e.*")
    return each.unionByName(roots).groupBy("fragment_id", "feature").agg(F.sum("cnt").cast("int").alias("cnt"))


def fingerprint_of(entries: Column) -> Column:
    """Fingerprint of an array of (feature, cnt): 16 hex digits of SHA-256 over the features in byte order."""
    parts = F.transform(F.array_sort(entries), lambda e: F.concat(e["feature"], F.lit("\x1f"), e["cnt"].cast("string"), F.lit("\x1e")))
    return F.substring(F.sha2(F.array_join(parts, "").cast("binary"), 256), 1, 16)


def fingerprints(bags: DataFrame) -> DataFrame:
    """Per fragment: feature_count (sum of counts), n_features, fingerprint. A bag is one row's array, as one fragment is."""
    entries = F.collect_list(F.struct("feature", "cnt"))
    return bags.groupBy("fragment_id").agg(F.sum("cnt").alias("feature_count"), F.count("*").alias("n_features"), fingerprint_of(entries).alias("fingerprint"))


def fingerprint_of_map(features: Column | str) -> Column:
    """Fingerprint of a map<string,int> column."""
    features = F.col(features) if isinstance(features, str) else features
    return fingerprint_of(F.transform(F.map_entries(features), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("cnt"))))
