"""Findings as rows of report formats."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from structsim.functions.names import path_uri, short_digest, terminal_safe
from structsim.sources.storage import stored

AGENT_GROUPS, AGENT_WARNINGS = 25, 20


#: Ids and names of the rules that results go by.
SIMILARITY_RULE, WARNING_RULE = ("SIM001", "structural-similarity"), ("SIM002", "incomplete-structural-analysis")


def artifact_uri(path: Column | str) -> Column:
    """A relative path as a relative URI, an absolute one (also with a drive letter) as a ``file:`` URI."""
    path = F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"\\\\", "/")
    rooted = F.when(path.rlike("^[A-Za-z]:/"), F.concat(F.lit("/"), path)).otherwise(path)
    drive = F.regexp_replace(path_uri(rooted), "^/([A-Za-z])%3A/", "/$1:/")
    return F.when(rooted.startswith("/"), F.concat(F.lit("file://"), drive)).otherwise(path_uri(path))


def sarif_rules(spark) -> DataFrame:
    """(id, name, level) of the rules."""
    rows = [(*SIMILARITY_RULE, "note"), (*WARNING_RULE, "warning")]
    return spark.createDataFrame(rows, "id string, name string, level string")


def sarif_results(groups: DataFrame, places: DataFrame, warnings: DataFrame) -> DataFrame:
    """(level, id, result): a note per group, its first place first and the others related, and a warning per warning.

    groups: group_id, score; places: group_id, location_key, path, start_line, end_line; warnings: path, message.
    """
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    artifact = lambda path: F.struct(artifact_uri(path).alias("uri")).alias("artifactLocation")
    at = F.struct(F.struct(artifact("path"), region.alias("region")).alias("physicalLocation"))
    lists = F.transform(F.array_sort(F.collect_set(F.struct("location_key", at.alias("at")))), lambda x: x["at"])
    lists = places.groupBy("group_id").agg(lists.alias("all"))
    result = F.struct(
        F.lit(SIMILARITY_RULE[0]).alias("ruleId"), F.lit("note").alias("level"), F.array(F.element_at("all", 1)).alias("locations"),
        F.expr("slice(all, 2, greatest(size(all) - 1, 0))").alias("relatedLocations"),
        F.struct(F.col("group_id").alias("group")).alias("partialFingerprints"), F.col("score").alias("similarity"),
    )
    note = groups.join(lists, "group_id").select(F.lit("note").alias("level"), F.col("group_id").alias("id"), F.to_json(result).alias("result"))
    where = F.array(F.struct(F.struct(artifact(F.coalesce("path", F.lit("")))).alias("physicalLocation")))
    said = F.struct(
        F.lit(WARNING_RULE[0]).alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        where.alias("locations"),
    )
    return note.unionByName(warnings.select(F.lit("warning").alias("level"), F.lit("").alias("id"), F.to_json(said).alias("result")))


def report_lines(ranked: DataFrame, places: DataFrame, shown: int = 3) -> DataFrame:
    """(rank, line) of ranked groups (rank, group_id, score, location_pairs): score, short id, pairs and the first places."""
    order = Window.partitionBy("group_id").orderBy("location_key")
    first = places.select("group_id", "location_key").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= shown)
    lists = first.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "location_key"))), lambda x: x["location_key"]), ", ").alias("at"))
    text = F.format_string("%d. %.2f%% %s %d pairs: %s", "rank", F.col("score") * 100, short_digest("group_id"), F.col("location_pairs"), terminal_safe("at"))
    return ranked.join(lists, "group_id").select("rank", text.alias("line"))


def agent_summary(ranked: DataFrame, warnings: DataFrame) -> DataFrame:
    """(kind, line) with at most 25 groups and 20 warnings, and how many of each were left out."""
    kept = ranked.where(F.col("rank") <= AGENT_GROUPS).select(F.lit("group").alias("kind"), F.concat_ws(" ", "group_id", F.round("score", 4).cast("string")).alias("line"))
    said = warnings.orderBy("path", "message").limit(AGENT_WARNINGS).select(F.lit("warning").alias("kind"), F.concat_ws(": ", "path", "message").alias("line"))
    left = lambda frame, most, kind: frame.agg(F.greatest(F.count("*") - most, F.lit(0)).cast("string").alias("line")).select(F.lit(kind).alias("kind"), "line")
    return kept.unionByName(said).unionByName(left(ranked, AGENT_GROUPS, "groups left out")).unionByName(left(warnings, AGENT_WARNINGS, "warnings left out"))


def report_json(totals: DataFrame, groups: DataFrame, schema_version: int) -> DataFrame:
    """(part, document): one row of totals with the version, then a document per group, so no task holds the whole report."""
    head = totals.select(F.lit("report").alias("part"), F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), *totals.columns)).alias("document"))
    return head.unionByName(groups.select(F.lit("group").alias("part"), F.to_json(F.struct(*groups.columns)).alias("document")))


def redact_paths(paths: DataFrame) -> DataFrame:
    """(path, redacted) of all distinct paths: ``<path-NNN>`` by sorted order, with an extension of up to 16 characters.

    Numbers come from a range sort, written once, and the counts of its partitions, so no task holds all paths.
    """
    sorted_ = paths.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path")
    sorted_ = stored(sorted_.withColumn("_id", F.monotonically_increasing_id()), "sorted-paths")
    part = sorted_.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id") - F.shiftleft(F.shiftright("_id", 33), 33))
    counts = part.groupBy("_part").agg(F.count("*").alias("n"))
    # One row per partition: bounded by the number of tasks.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = (F.col("before") + F.col("_row") + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    out = part.join(F.broadcast(before.select("_part", "before")), "_part")
    return out.select("path", F.concat(F.lit("<path-"), padded, F.lit(">"), F.when(F.length(ext) <= 16, ext).otherwise("")).alias("redacted"))


def names_a_path(field: str) -> bool:
    """Whether a field of a report holds a path, or a list of paths."""
    return field in ("path", "root", "ignore_files") or field.endswith(("_path", "_paths"))


def _path_values(value: Column, kind: DataType, is_path: bool, named: Callable[[str], bool]) -> Column | None:
    """All paths within a value, as an array; null if its type has none."""
    if isinstance(kind, StringType):
        return F.array(value) if is_path else None
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType):
            return value if is_path else None
        if _path_values(F.lit(None), kind.elementType, is_path, named) is None:
            return None
        return F.flatten(F.transform(value, lambda x: _path_values(x, kind.elementType, is_path, named)))
    if isinstance(kind, StructType):
        inner = [_path_values(value[f.name], f.dataType, named(f.name), named) for f in kind.fields]
        some = [F.coalesce(c, F.array().cast("array<string>")) for c in inner if c is not None]
        return F.concat(*some) if some else None
    return None


def _with_paths(value: Column, kind: DataType, is_path: bool, named: Callable[[str], bool], new: Callable[[Column], Column]) -> Column:
    """The value with every path in it replaced."""
    if isinstance(kind, StringType):
        return new(value) if is_path else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _with_paths(x, kind.elementType, is_path, named, new))
    if isinstance(kind, StructType):
        inner = [_with_paths(value[f.name], f.dataType, named(f.name), named, new).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*inner))
    return value


def redact_report(tables: Mapping[str, DataFrame], named: Callable[[str], bool] = names_a_path) -> dict[str, DataFrame]:
    """The tables of a report with every path, also within structs and arrays, replaced by its ``redact_paths`` number.

    One dictionary serves all tables, so a path has the same stand-in everywhere. A row meets the dictionary by the
    distinct paths in it; empty and null paths stay as they are.
    """
    kept = {n: stored(df.withColumn("_row", F.monotonically_increasing_id()), f"report-{n}") for n, df in tables.items()}
    held = {}
    for n, df in kept.items():
        schema = StructType([f for f in df.schema.fields if f.name != "_row"])
        found = _path_values(F.struct(*[F.col(f.name) for f in schema.fields]), schema, False, named)
        if found is not None:
            own = df.select("_row", F.explode(F.array_distinct(found)).alias("path")).where("path is not null and path <> ''")
            held[n] = stored(own, f"paths-{n}")
    every = None
    for own in held.values():
        every = own.select("path") if every is None else every.unionByName(own.select("path"))
    if every is None:
        return dict(tables)
    numbers = stored(redact_paths(every), "numbers")
    out = {}
    for n, df in kept.items():
        fields = [f for f in df.schema.fields if f.name != "_row"]
        if n not in held:
            out[n] = df.drop("_row")
            continue
        own = held[n].join(numbers, "path").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("path", "redacted"))).alias("_to"))
        new = lambda path: F.coalesce(F.element_at("_to", path), path)
        columns = [_with_paths(F.col(f.name), f.dataType, named(f.name), named, new).alias(f.name) for f in fields]
        out[n] = df.join(own, "_row", "left").select(*columns)
    return out
