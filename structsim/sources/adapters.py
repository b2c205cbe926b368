"""The test tables as fragments and bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structsim.operators import bags as B
from structsim.sources.storage import stored

ROMANCE, GERMANIC = ("fr", "es"), ("en", "de")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def family(language):
    return F.when(language.isin(*ROMANCE), "romance").when(language.isin(*GERMANIC), "germanic").otherwise("none")


def document_path():
    return F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, language, family, domain, kind, name, lines and text."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("fragment_id"), document_path().alias("path"), F.col("lang").alias("language"), family(F.col("lang")).alias("family"),
        F.lit("text").alias("domain"), F.lit("document").alias("kind"), F.col("source").alias("name"), F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"), "text",
    )


def document_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have words as fragments with their bag, ``entries``, counted row by row; rows that share an id are one bag."""
    files = document_files(spark, sf_dir).where("fragment_id is not null")
    repeated = files.groupBy("fragment_id").count().where("count > 1").select("fragment_id")
    shared = bool(repeated.take(1))
    made = B.with_words(files.join(repeated, "fragment_id", "left_anti").select(*files.columns) if shared else files, prints=True)
    if shared:
        again = files.join(repeated, "fragment_id", "left_semi").select(*files.columns)
        own = B.word_bags(again)
        entries = own.groupBy("fragment_id").agg(F.collect_list(F.struct("feature", "cnt")).alias("entries"))
        made = made.unionByName(again.drop("text").join(entries, "fragment_id").join(B.fingerprints(own), "fragment_id"))
    return made.where("n_features > 0")


def document_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, rows that hold a bag as ``entries``) of ``document_prints``, stored."""
    made = stored(document_prints(spark, sf_dir), "word-bags")
    shared = bool(made.groupBy("fragment_id").count().where("count > 1").take(1))
    return made.drop("entries"), made.dropDuplicates(["fragment_id"]) if shared else made


def document_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, bags) of ``document_prints``, stored."""
    fragments, rows = document_rows(spark, sf_dir)
    return fragments, B.listed_bags(rows)


def supplier_bags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, bags) of suppliers by brand of the parts they delivered; their family is the region."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    bag = B.table_bags(lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sort")), "l_partkey"), "l_suppkey", "sort")
    bag = stored(bag, "brand-bags")
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Nations are a fixed list of 25 rows.
    who = read(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    fragments = who.select(
        F.col("s_suppkey").alias("fragment_id"), F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("s_"), F.col("s_suppkey").cast("string"))).alias("path"),
        F.col("n_name").alias("language"), F.col("r_name").alias("family"), F.lit("trade").alias("domain"), F.lit("supplier").alias("kind"), F.col("n_name").alias("name"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
    )
    return stored(fragments.join(B.fingerprints(bag), "fragment_id"), "fragments"), bag
