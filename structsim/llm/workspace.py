"""Tables that an operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch of rows that goes to a Python worker, at most (but for a single row).
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as texts can be long; workers and executors hold several at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Where that is unset only a local master, as in tests, gets a temporary folder; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: lineage ends there, and lost executors cost no recomputation."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
