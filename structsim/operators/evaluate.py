"""Labelled evaluation: ranks, violations, precision and metrics per class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a labelled pair can be.
CLASSES = ("accepted-positive", "intentional-similarity", "false-positive")
_SIDE = "struct<path:string,name:string,start_line:int>"
CASE = f"id:string,classification:string,reviewer:string,threshold:double,min_score:double,max_score:double,rank:int,reference_score:double,reference_rank:int,left:{_SIDE},right:{_SIDE}"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON document with a list ``cases``; strict."""
    cases = spark.read.schema(f"cases array<struct<{CASE}>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("cases").alias("c")).select("c.*")
    check_cases(cases)
    return cases


def check_cases(cases: DataFrame) -> None:
    """Ids are set and unique, classes known, ranges in order, ranks positive, paths relative."""
    good = (F.col("id") != "") & F.col("classification").isin(*CLASSES) & F.col("threshold").between(0, 1) & (F.col("min_score") <= F.col("max_score")) & F.col("min_score").between(0, 1) & F.col("max_score").between(0, 1) & (F.col("rank") >= 1)
    for side in ("left", "right"):
        good = good & (F.col(f"{side}.path") != "") & ~F.col(f"{side}.path").startswith("/") & ~F.col(f"{side}.path").startswith("../")
    if cases.where(~F.coalesce(good, F.lit(False))).take(1):
        raise ValueError("the manifest has a case that is not well formed")
    if cases.groupBy("id").count().where("count > 1").take(1):
        raise ValueError("the manifest has repeated ids")


def ranked(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``actual_rank`` by score, ties by id, and what is off: score_violation, rank_violation, score and rank movement.

    results: id, score, min_score, max_score, rank, reference_score, reference_rank. An evaluation is a reviewed, small list
    and is ranked as one; ``by`` ranks many evaluations apart.
    """
    order = Window.partitionBy(*(by or [])).orderBy(F.col("score").desc(), "id")
    out = results.withColumn("actual_rank", F.row_number().over(order))
    return (
        out.withColumn("score_violation", ~F.col("score").between(F.col("min_score"), F.col("max_score")))
        .withColumn("rank_violation", F.col("actual_rank") != F.col("rank"))
        .withColumn("score_movement", F.col("score") - F.col("reference_score"))
        .withColumn("rank_movement", F.col("reference_rank") - F.col("actual_rank"))
    )


def precision_at(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: list[str] | None = None) -> DataFrame:
    """(k, precision) of results (id, score, classification) for each k up to their number; false positives do not count."""
    own = by or []
    order = Window.partitionBy(*own).orderBy(F.col("score").desc(), "id")
    hit = F.when(F.col("classification") != "false-positive", 1).otherwise(0)
    seen = results.withColumn("k", F.row_number().over(order)).withColumn("hits", F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(F.col("k").isin(*ks)).select(*own, "k", (F.col("hits").cast("double") / F.col("k")).alias("precision"))


def class_scores(results: DataFrame) -> DataFrame:
    """(classification, n, min_score, max_score, mean_score)."""
    return results.groupBy("classification").agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def metrics(results: DataFrame) -> DataFrame:
    """One row: cases, relevant, actionable, false_positives, actionability.

    Intended similarities are relevant but ask for no action.
    """
    n = lambda *c: F.count(F.when(F.col("classification").isin(*c), 1))
    return results.agg(
        F.count("*").alias("cases"), n("accepted-positive", "intentional-similarity").alias("relevant"), n("accepted-positive").alias("actionable"), n("false-positive").alias("false_positives"),
        (n("accepted-positive").cast("double") / F.count("*")).alias("actionability"),
    )


def resolve_cases(cases: DataFrame, fragments: DataFrame) -> DataFrame:
    """(id, left_id, right_id): each selector (path and name, or path and start line) must name exactly one fragment."""
    out = cases.select("id")
    for side in ("left", "right"):
        want = cases.select("id", F.col(f"{side}.path").alias("path"), F.col(f"{side}.name").alias("n"), F.col(f"{side}.start_line").alias("s"))
        hit = want.join(fragments.select("fragment_id", "path", "name", "start_line"), "path").where((F.col("n").isNull() | (F.col("n") == F.col("name"))) & (F.col("s").isNull() | (F.col("s") == F.col("start_line"))))
        found = hit.groupBy("id").agg(F.count("*").alias("hits"), F.min("fragment_id").alias(f"{side}_id"))
        out = out.join(found.where("hits = 1").drop("hits"), "id", "left")
    if out.where("left_id is null or right_id is null").take(1):
        raise LookupError("a selector names no fragment or several")
    return out
