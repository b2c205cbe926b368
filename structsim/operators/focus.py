"""Changed paths and lines as focus: git's captured text as tables, intervals, and who is focused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MalformedText(ValueError):
    """Captured text that is not what it should be."""


def safe_path(path: Column) -> Column:
    """Relative, without a way up at its start."""
    return (path != "") & ~path.startswith("/") & ~path.isin(".", "..") & ~path.startswith("../")


def _refuse(bad: DataFrame, message: str) -> None:
    if bad.take(1):
        raise MalformedText(message)


def parse_name_status(texts: DataFrame, column: str = "text") -> DataFrame:
    """(source, path, deleted) from NUL-separated name-status text, one text per row with its ``source``.

    Renames and copies take two paths and keep the second. The stride varies, so a fold over the fields carries the state.
    """
    fields = F.filter(F.split(F.col(column), "\x00"), lambda x: x != "")
    zero = F.struct(F.lit("").alias("status"), F.lit(0).alias("left"), F.array().cast("array<struct<path:string,deleted:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = F.when(x.rlike("^[RC]"), 2).otherwise(1)
        done = acc["left"] == 1
        entry = F.struct(x.alias("path"), acc["status"].startswith("D").alias("deleted"))
        return (
            F.when(acc["left"] == 0, F.struct(x.alias("status"), take.alias("left"), acc["out"].alias("out")))
            .when(done, F.struct(F.lit("").alias("status"), F.lit(0).alias("left"), F.concat(acc["out"], F.array(entry)).alias("out")))
            .otherwise(F.struct(acc["status"].alias("status"), (acc["left"] - 1).alias("left"), acc["out"].alias("out")))
        )

    folded = texts.select("source", F.aggregate(fields, zero, step).alias("s"))
    _refuse(folded.where("s.left <> 0"), "name-status text ends within an entry")
    out = folded.select("source", F.explode("s.out").alias("e")).select("source", "e.path", "e.deleted").distinct()
    _refuse(out.where(~safe_path(F.col("path"))), "name-status text has an unsafe path")
    return out


def parse_diff_hunks(texts: DataFrame, column: str = "text") -> DataFrame:
    """(source, path, start_line, end_line) of the new side of zero-context diffs, one text per row.

    A patch's header ends at its first hunk; later lines that look like headers are content. A hunk without new lines
    stands for its place and the line after it. Deleted files have no rows.
    """
    text = F.regexp_replace(F.col(column), "\r\n", "\n")
    patches = texts.select("source", F.posexplode(F.split(text, r"(?m)^diff --git ")).alias("k", "patch")).where("k > 0")
    head = F.regexp_extract("patch", r"(?s)^(.*?)(?=\n@@ -|\z)", 1)
    path = F.regexp_extract(head, r"(?m)^\+\+\+ (?:b/)?(.*)$", 1)
    hunk = r"(?m)^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+(?:,[0-9]+)?) @@"
    at = patches.select("source", path.alias("path"), F.explode(F.regexp_extract_all("patch", F.lit(hunk), F.lit(1))).alias("h")).where("path <> '' and path <> '/dev/null'")
    start = F.element_at(F.split("h", ","), 1).cast("int")
    count = F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    first = F.when(count == 0, F.greatest(start, F.lit(1))).otherwise(start)
    return at.select("source", "path", first.alias("start_line"), (F.when(count == 0, first + 1).otherwise(start + count - 1)).alias("end_line"))


def parse_index(texts: DataFrame, column: str = "text") -> DataFrame:
    """(mode, oid, path) from NUL-separated index text ``mode oid stage TAB path``; anything else is an error."""
    record = texts.select(F.explode(F.split(F.col(column), "\x00")).alias("r")).where("r <> ''")
    meta, path = F.split(F.trim(F.regexp_extract("r", r"(?s)^([^\t]*)\t", 1)), " +"), F.regexp_extract("r", r"(?s)^[^\t]*\t(.*)$", 1)
    rows = record.select(meta.alias("m"), path.alias("path"))
    oid = F.try_element_at("m", F.lit(2))
    good = (F.size("m") == 3) & (F.try_element_at("m", F.lit(3)) == "0") & oid.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$") & safe_path(F.col("path"))
    _refuse(rows.where(~F.coalesce(good, F.lit(False))), "index text has an unmerged or malformed entry")
    return rows.select(F.element_at("m", 1).alias("mode"), oid.alias("oid"), "path")


def merge_intervals(intervals: DataFrame, key: str = "path") -> DataFrame:
    """Overlapping or touching intervals (start_line, end_line) of each key as one; invalid ones are dropped."""
    good = intervals.where((F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))).select(key, "start_line", "end_line").distinct()
    order = Window.partitionBy(key).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = good.withColumn("new", F.when(reach.isNull() | (F.col("start_line") > reach + 1), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def mark_focused(fragments: DataFrame, paths: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``focused``: the path is in ``paths``, or the lines meet a valid interval of the path.

    Intervals are joined by path and reduced before they meet the fragments, so none is repeated.
    """
    whole = paths.select("path").distinct().withColumn("whole", F.lit(True))
    spans = merge_intervals(intervals).groupBy("path").agg(F.collect_list(F.struct("start_line", "end_line")).alias("spans"))
    out = fragments.join(whole, "path", "left").join(spans, "path", "left")
    meets = F.exists("spans", lambda s: (s["start_line"] <= F.col("end_line")) & (s["end_line"] >= F.col("start_line")))
    return out.withColumn("focused", F.coalesce("whole", F.lit(False)) | F.coalesce(meets, F.lit(False))).drop("whole", "spans")


def resolve_focus(files: DataFrame, changed: DataFrame, intervals: DataFrame, explicit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(focus paths, focus intervals, one summary row) of changes and explicitly named paths among discovered files.

    changed: path, whole_file. A changed path with intervals is focused by lines, without ones only if it counts whole.
    The summary has discovered_files, missing and mode.
    """
    known = files.select("path").distinct()
    named = explicit.select("path").distinct()
    has = intervals.select("path").distinct()
    change = changed.groupBy("path").agg(F.bool_or("whole_file").alias("whole_file"))
    whole = named.unionByName(change.where("whole_file").join(has, "path", "left_anti").select("path")).distinct().join(known, "path", "left_semi")
    lines = merge_intervals(intervals.join(change.select("path"), "path", "left_semi").join(known, "path", "left_semi"))
    wanted = named.withColumn("kind", F.lit("explicit")).unionByName(change.select("path", F.lit("git").alias("kind")))
    state = wanted.join(known.withColumn("here", F.lit(1)), "path", "left")
    git, own = F.count(F.when(F.col("kind") == "git", 1)) > 0, F.count(F.when(F.col("kind") == "explicit", 1)) > 0
    mode = F.when(git & own, "git-and-explicit").when(git, "git").when(own, "explicit").otherwise("none")
    return whole, lines, state.agg(F.countDistinct(F.when(F.col("here") == 1, F.col("path"))).alias("discovered_files"), F.count(F.when(F.col("here").isNull(), 1)).alias("missing"), mode.alias("mode"))


def focus_evidence(requested: DataFrame, files: DataFrame, excluded: DataFrame, supported: Column) -> DataFrame:
    """What became of each requested path (path, deleted): status, reason, required, covered.

    excluded: path, status, reason of files that discovery left out; ``supported`` is a condition on the path.
    """
    out = requested.groupBy("path").agg(F.bool_or("deleted").alias("deleted")).join(files.select("path").distinct().withColumn("here", F.lit(True)), "path", "left")
    out = out.join(excluded.groupBy("path").agg(F.min("status").alias("out_status"), F.min("reason").alias("out_reason")), "path", "left")
    status = F.when(F.col("deleted"), "deleted").when(F.col("here"), "analyzed").when(F.col("out_status").isNotNull(), F.col("out_status")).when(~supported, "unsupported").otherwise("not_discovered")
    out = out.withColumn("status", status)
    required = ~F.col("status").isin("deleted", "unsupported")
    return out.select("path", "status", F.when(F.col("status") == F.col("out_status"), F.col("out_reason")).alias("reason"), required.alias("required"), (required & (F.col("status") == "analyzed")).alias("covered"))


def focus_totals(evidence: DataFrame) -> DataFrame:
    """One row: requested, required and covered paths of ``focus_evidence``."""
    n = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    return evidence.agg(F.count("*").alias("requested"), n("required"), n("covered"))


def assign_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the longest root (a directory prefix) that holds it; roots are few and checked before.

    Repeated roots, roots without files and files without a root are errors.
    """
    if roots.groupBy("root").count().where("count > 1").take(1):
        raise ValueError("a root is named twice")
    # All directory prefixes of a path are joined by equality, so no pair of file and root is tried in vain.
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root")
    found = files.select("*", above).join(roots.select("root"), "root").withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(F.length("root").desc())))
    own = found.where("nth = 1").drop("nth")
    if files.join(own.select("path"), "path", "left_anti").take(1):
        raise ValueError("a file lies under no root")
    if roots.join(own.select("root").distinct(), "root", "left_anti").take(1):
        raise ValueError("a root has no file")
    return own
