"""Files below roots, and which of them are looked at: excludes, ignore rules, sizes, generated files; and their coverage."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structsim.functions.names import extension, glob_regex
from structsim.options import Options
from structsim.sources.registry import detect_language
from structsim.sources.storage import stored

# Directories that are never entered, and links and submodules in a snapshot.
EXCLUDED_DIRECTORIES = (".build", ".git", ".hg", ".svn", ".turbo", "build", "coverage", "dist", "node_modules", "target", "vendor")
NOT_FILES = ("120000", "160000")


def _relative(base: str) -> Column:
    plain = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 20)).otherwise(plain)


def list_source_tree(spark: SparkSession, roots: Iterable[str], base: str = "") -> DataFrame:
    """(path, size, location) of all files below the roots, without reading any; paths relative to ``base``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return raw.select(_relative(base).alias("path"), F.col("length").alias("size"), F.col("path").alias("location"))


def read_listed(listed: DataFrame, base: str = "") -> DataFrame:
    """(path, content, size) of listed files (location). Their locations go to the driver, where Spark keeps the whole
    listing anyway; contents do not."""
    places = [r["location"] for r in listed.select("location").distinct().toLocalIterator()]
    spark = listed.sparkSession
    if not places:
        return spark.createDataFrame([], "path string, content string, size long")
    raw = spark.read.format("binaryFile").load(places)
    return raw.select(_relative(base).alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


def read_source_tree(spark: SparkSession, roots: Iterable[str], base: str = "") -> DataFrame:
    """(path, content, size) of all files below the roots; ``discover_tree`` reads only those that rules leave."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    return raw.select(_relative(base).alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


@dataclass
class Discovery:
    """What a tree holds for a scan."""

    listed: DataFrame  # path, size, location of the files that are left
    large: DataFrame  # path, status, reason of those above the size limit
    evidence: DataFrame  # path, digest of the ignore files that bind

    def files(self, base: str = "") -> DataFrame:
        """(path, content, size) of the files that are left; only they are read."""
        return read_listed(self.listed, base)


def discover_tree(spark: SparkSession, roots: Iterable[str], base: str = "", excludes: Iterable[str] = (),
                  ignore_names: Iterable[str] = (".gitignore",), limit: int = 0) -> Discovery:
    """Decides by paths and sizes which files of a tree are read.

    Left out are files in directories that are never entered, those that an exclude glob names, those that ignore files
    ignore, and those above the size limit. Ignore files are found level by level from the top: one in a directory that
    those above it have pruned does not bind, is not read and is no evidence. Spark's file sources do not list names that
    begin with ``.`` or ``_``; ignore files are looked up by the file system, files of such names are left out.
    """
    roots = list(roots)
    seen = list_source_tree(spark, roots, base).where(~in_excluded_directory() & ~excluded_by(excludes))
    seen = stored(seen, "listed")
    deepest = seen.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    rules = parse_ignore_rules(spark.createDataFrame([], "base string, content string"))
    bound: list[tuple[str, str]] = []
    for level in range(deepest):
        found = [x for root in roots for x in _named_files(spark, root, level, tuple(ignore_names))]
        if found:
            rows = spark.createDataFrame(found, "location string, path string").select("location", _relative(base).alias("path"))
            rows = rows.where(~in_excluded_directory() & ~excluded_by(excludes))
            bound += [(r["path"], _content(spark, r["location"])) for r in apply_ignore_rules(rows, rules).orderBy("path").collect()]
            table = spark.createDataFrame([(path.rpartition("/")[0], text) for path, text in bound], "base string, content string")
            rules = stored(parse_ignore_rules(table), "rules")
    left = apply_ignore_rules(seen, rules)
    kept, large = split_by_size(left, limit) if limit else (left, left.limit(0).select("path", F.lit("").alias("status"), F.lit("").alias("reason")))
    return Discovery(stored(kept, "kept"), stored(large, "large"), ignore_evidence(spark.createDataFrame(bound, "path string, content string")))


def _named_files(spark: SparkSession, root: str, level: int, names: tuple[str, ...]) -> list[tuple[str, str]]:
    """(location, path) of files of these names, so many directories below a root; one call of the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    pattern = path(root.rstrip("/") + "/*" * level + "/{" + ",".join(names) + "}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [(at, at) for at in (f.getPath().toString() for f in found)]


def _content(spark: SparkSession, location: str) -> str:
    """The text of a small file, as a person writes it by hand."""
    at = spark._jvm.org.apache.hadoop.fs.Path(location)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
    finally:
        stream.close()


def read_snapshot(entries: DataFrame) -> DataFrame:
    """Files of an immutable table (path, mode, size, content), without links and submodules."""
    return entries.where(~F.col("mode").isin(*NOT_FILES)).drop("mode")


def overlay_content(files: DataFrame, overlay: DataFrame, sql_dialect: str = "sql") -> DataFrame:
    """Files with the content of ``overlay`` (path, content) where it has one; a path that is no file is an error.

    Where files have a language, that of files with new content is detected anew, as their first lines may say another.
    """
    if overlay.join(files, "path", "left_anti").take(1):
        raise LookupError("an overlay names no file")
    new = overlay.select("path", F.col("content").alias("_new"))
    out = files.join(new, "path", "left").withColumn("size", F.coalesce(F.octet_length("_new").cast("long"), "size"))
    out = out.withColumn("content", F.coalesce("_new", "content"))
    if "language" in files.columns:
        told = ["language", "family", "domain", "kind"]
        again = detect_language(out.where("_new is not null").drop(*told), sql_dialect)
        return out.where("_new is null").select(*files.columns).unionByName(again.select(*files.columns))
    return out.select(*files.columns)


def merge_discovery(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """One row per path of both; the later one wins."""
    both = primary.withColumn("_o", F.lit(0)).unionByName(extra.withColumn("_o", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.col("_o").desc()))).where("_n = 1").drop("_n", "_o")


def above(path: Column | str) -> Column:
    """All directories above a path, the topmost first."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, 1 << 20), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def in_excluded_directory(path: str = "path", names: Iterable[str] = EXCLUDED_DIRECTORIES) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower), F.array(*[F.lit(n) for n in names]))


def excluded_by(globs: Iterable[str], path: str = "path") -> Column:
    """Whether a glob matches the path, its name, or a directory above it or that one's name."""

    def own(rx: str):
        return lambda p: p.rlike(rx) | F.element_at(F.split(p, "/"), -1).rlike(rx)

    hit = F.lit(False)
    for rx in map(glob_regex, globs):
        hit = hit | own(rx)(F.col(path)) | F.exists(above(path), own(rx))
    return hit


def parse_ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """(base, ordinal, pattern, negated, directory, anchored) of ignore files (base: their directory, content)."""
    lines = ignore_files.select("base", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("ordinal", "raw"))
    line = F.rtrim("raw")
    rows = lines.select("base", "ordinal", line.alias("l")).where("l <> '' and not startswith(l, '#')")
    negated = F.col("l").startswith("!")
    body = F.regexp_replace(F.when(negated, F.expr("substring(l, 2)")).otherwise(F.col("l")), r"^\\([#!])", "$1")
    bare = F.regexp_replace(body, "/+$", "")
    return rows.select("base", "ordinal", negated.alias("negated"), body.endswith("/").alias("directory"), bare.contains("/").alias("anchored"), F.regexp_replace(bare, "^/", "").alias("pattern")).where("pattern <> ''")


def ignore_evidence(ignore_files: DataFrame) -> DataFrame:
    """(path, digest: SHA-256) of the ignore files that were read (path, content), in the order of their paths."""
    return ignore_files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest")).orderBy("path")


def split_by_size(files: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(files within the limit, rows of the others with status and reason)."""
    out = files.where(F.col("size") > limit).select("path", F.lit("skipped_resource").alias("status"), F.lit("resource_limit").alias("reason"))
    return files.where(F.col("size") <= limit), out


# What a comment line of a generated file says, and the name of that marker, in the order tried.
GENERATED_MARKERS = (
    ("^generated by typeshare", "typeshare-generated"),
    ("^generated by the swift generator plugin for the protocol buffer compiler", "swift-protobuf-generated"),
    ("code generated.*do not edit|do not edit.*code generated", "code-generated-do-not-edit"),
    ("this file was automatically generated", "automatically-generated"),
    ("this file is generated.*do not edit|do not edit.*this file is generated", "generated-do-not-edit"),
    ("auto-generated.*do not edit|do not edit.*auto-generated", "auto-generated-do-not-edit"),
    ("@generated", "at-generated"),
)
HEADER_BYTES = 8192
_COMMENT = r"(?m)(^[ \t]*(?:/\*(?s:.*?)(?:\*/|\z)|(?://|#|--|<!--)[^\n]*))"


def generated_marker(content: Column | str) -> Column:
    """The marker of the first comment line, at the head of a text, that has one; null for none.

    Line comments and block comments that begin a line count, code does not.
    """
    whole = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    text = F.substring(whole.cast("binary"), 1, HEADER_BYTES).cast("string")
    lines = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_COMMENT), F.lit(1)), lambda c: F.split(c, "\n")))
    said = F.transform(lines, lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[ \t]*(?:/\*|//|#|--|<!--|\*)?|\*/.*$|\r$", ""))))
    marked = F.transform(said, lambda x: F.coalesce(*[F.when(x.rlike(rx), name) for rx, name in GENERATED_MARKERS]))
    return F.try_element_at(F.array_compact(marked), F.lit(1))


def unsupported_extensions(files: DataFrame) -> DataFrame:
    """(ext, n) of distinct files whose language is unknown; files without extension are not counted."""
    return files.where("language is null").select("path", extension("path").alias("ext")).where("ext <> ''").distinct().groupBy("ext").agg(F.count("*").alias("n"))


def language_inventory(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


def health_checks(files: DataFrame, warnings: DataFrame) -> DataFrame:
    """(check, healthy, n): whether files were found and whether nothing warned."""
    found = files.agg(F.count("*").alias("n")).select(F.lit("discovery").alias("check"), (F.col("n") > 0).alias("healthy"), "n")
    said = warnings.agg(F.count("*").alias("n")).select(F.lit("warnings").alias("check"), (F.col("n") == 0).alias("healthy"), "n")
    return found.unionByName(said)


def _indexed(rules: DataFrame) -> DataFrame:
    """Rules with what a place must have for them: kind and key.

    A pattern without wildcards is met by that name anywhere (``name``) or by that leading path (``path``), ``*.ext`` by
    a name with that last extension (``ext``); the rest have no key and are tried as patterns (``any``).
    """
    wild, ext = F.col("pattern").rlike(r"[*?\[\\{]"), F.col("pattern").rlike(r"^\*\.[^.*?\[\\{/]+$")
    kind = F.when(~wild, F.when(F.col("anchored"), "path").otherwise("name")).when(ext & ~F.col("anchored"), "ext").otherwise("any")
    key = F.when(~wild, F.col("pattern")).when(ext, F.substring("pattern", 2, 1 << 20)).otherwise("")
    return rules.withColumn("kind", kind).withColumn("key", F.when(F.col("kind") == "any", "").otherwise(key))


def _last_verdict(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(place, ignored, reopened) of places (place, is_dir) that any rule matches or may reopen.

    The last rule that matches a leading part of the place decides. ``reopened``: a negation with a slash may match below.
    A place meets rules by the names, extensions and leading paths it has, so literal rules cost nothing where they do
    not match; only other patterns, and negations with a slash, meet every place below their base.
    """
    made = _indexed(rules)
    bound = places.select("place", "is_dir", F.explode(F.concat(F.array(F.lit("")), above("place"))).alias("base"))
    inner = F.when(F.col("base") == "", F.col("place")).otherwise(F.expr("substring(place, length(base) + 2)"))
    bound = bound.withColumn("_in", inner)
    parts = F.split("_in", "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    said = lambda n: F.element_at(parts, n)
    token = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), (n == F.size(parts)).alias("last"))
    tokens = F.concat(
        F.transform(steps, lambda n: token("name", said(n), n)),
        F.transform(steps, lambda n: token("path", F.array_join(F.slice(parts, 1, n), "/"), n)),
        F.transform(steps, lambda n: token("ext", F.regexp_extract(said(n), r"(\.[^.]+)$", 1), n)),
    )
    met = bound.select("place", "is_dir", "base", F.explode(tokens).alias("t")).select("place", "is_dir", "base", "t.*")
    order = F.struct(F.length("base"), "ordinal")
    verdict = lambda hits: hits.select("place", order.alias("order"), "negated", F.lit(False).alias("below"))
    literal = met.join(made.where("kind <> 'any'"), ["base", "kind", "key"])
    literal = verdict(literal.where(~(F.col("directory") & F.col("last") & ~F.col("is_dir"))))

    rows = bound.join(made.where("kind = 'any'"), "base").withColumn("_rx", glob_column(F.col("pattern")))
    none = F.array().cast("array<string>")
    ways = F.when(F.size(parts) > 1, above("_in")).otherwise(none)
    candidates = F.concat(ways, F.when(F.col("directory") & ~F.col("is_dir"), none).otherwise(F.array("_in")))
    tried = F.exists(candidates, lambda p: F.rlike(F.when(F.col("anchored"), p).otherwise(F.element_at(F.split(p, "/"), -1)), F.col("_rx")))
    general = verdict(rows.where(tried))

    again = bound.join(made.where("negated and anchored"), "base")
    own, depth = F.split("pattern", "/"), F.size(F.split("_in", "/"))
    start = glob_column(F.array_join(F.slice(own, 1, depth), "/"))
    may = F.col("pattern").contains("**") | ((F.size(own) > depth) & F.rlike("_in", start))
    below = again.where(may).select("place", F.lit(None).cast("struct<col1:int,ordinal:int>").alias("order"), F.lit(None).cast("boolean").alias("negated"), F.lit(True).alias("below"))
    every = literal.unionAll(general).unionAll(below)
    last = F.max_by("negated", "order")
    return every.groupBy("place").agg(F.coalesce(~last, F.lit(False)).alias("ignored"), F.bool_or("below").alias("reopened"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files that no rule ignores.

    An ignored directory is left out with all below it, unless a negation with a slash may match something there. Each
    directory is judged once. Rules are joined by their base, a directory above the place, so none is tried elsewhere.
    """
    ancestors = files.select("path", F.explode(above("path")).alias("place"))
    dirs = _last_verdict(ancestors.select("place").distinct().withColumn("is_dir", F.lit(True)), rules)
    own = _last_verdict(files.select(F.col("path").alias("place"), F.lit(False).alias("is_dir")), rules)
    pruned = ancestors.join(dirs.where("ignored and not reopened"), "place", "left_semi").select("path")
    gone = pruned.unionByName(own.where("ignored").select(F.col("place").alias("path"))).distinct()
    return files.join(gone, "path", "left_anti")


def glob_column(pattern: Column) -> Column:
    """Patterns that are data as regular expressions: ``**/``, ``**``, ``*``, ``?`` and classes."""
    quoted = F.regexp_replace(pattern, r"([.+(){}^$|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    for a, b in ((r"\*\*/", "\x01"), (r"/\*\*$", "\x02"), (r"\*\*", "\x03"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:[^/]+/)*"), ("\x02", "(?:/.*)?"), ("\x03", ".*")):
        quoted = F.regexp_replace(quoted, a, b)
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def in_domains(domains: Iterable[str]) -> Column:
    """Whether a file's ``domain`` is selected; without a selection all are."""
    names = list(domains)
    return F.col("domain").isin(*names) if names else F.lit(True)


def below_roots(roots: Iterable[str], path: str = "path") -> Column:
    """Whether a path is one of the roots or below one; without roots, or with ``.``, all are."""
    clean = [r.strip("/").removeprefix("./") for r in roots]
    if not clean or any(r in ("", ".") for r in clean):
        return F.lit(True)
    hit = F.lit(False)
    for r in clean:
        hit = hit | (F.col(path) == r) | F.col(path).startswith(f"{r}/")
    return hit


def file_coverage(files: DataFrame, fragments: DataFrame, dropped: DataFrame, warnings: DataFrame) -> DataFrame:
    """Per file: fragment, candidate, below-floor, skipped and diagnostic counts, and why it has no fragments.

    files: path, status (of discovery); fragments: path, kind; dropped: path, below_floor, skipped; warnings: path, kind,
    total_diagnostics, skipped_fragments. Blocks count as fragments, but not as candidates. A file without fragments has
    invalid ones if a warning of kind ``parse``, of skipped fragments or of diagnostics names it, or its size or another
    warning stopped it, or all its candidates were below the floor, or it had none.
    """
    made = fragments.groupBy("path").agg(F.count("*").alias("fragment_count"), F.count(F.when(F.col("kind") != "block", 1)).alias("_own"))
    lost = dropped.groupBy("path").agg(F.sum("below_floor").alias("below_floor"), F.sum("skipped").alias("skipped"))
    invalid = (F.col("kind") == "parse") | (F.col("skipped_fragments") > 0) | (F.col("total_diagnostics") > 0)
    said = warnings.groupBy("path").agg(
        F.sum(F.coalesce("total_diagnostics", F.lit(0))).alias("diagnostics"), F.count("*").alias("_warned"), F.bool_or(F.coalesce(invalid, F.lit(False))).alias("_invalid")
    )
    counts = ["fragment_count", "_own", "below_floor", "skipped", "diagnostics", "_warned"]
    out = files.join(made, "path", "left").join(lost, "path", "left").join(said, "path", "left").na.fill(0, counts).na.fill(False, ["_invalid"])
    out = out.withColumn("candidate_count", F.col("_own") + F.col("below_floor") + F.col("skipped"))
    stopped = (F.col("_warned") > 0) | (F.col("status") == "skipped_resource")
    low = (F.col("candidate_count") > 0) & (F.col("below_floor") == F.col("candidate_count"))
    reason = F.when(F.col("_invalid") | (F.col("skipped") > 0), "invalid_fragments").when(stopped, "resource_limit").when(low, "below_token_floor").otherwise("no_boundaries")
    return out.select("path", "status", "fragment_count", "candidate_count", "below_floor", "skipped", "diagnostics", F.when(F.col("fragment_count") == 0, reason).alias("zero_reason"))


def coverage_summary(coverage: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row of totals over files and warnings; only analyzed files have or lack fragments."""
    n = lambda c: F.count(F.when(c, 1))
    done = F.col("status") == "analyzed"
    own = coverage.agg(
        F.count("*").alias("supported"), n(done).alias("analyzed"), n(F.col("status") == "excluded_generated").alias("generated"),
        F.coalesce(F.sum("fragment_count"), F.lit(0)).alias("fragments"), n(done & (F.col("fragment_count") > 0)).alias("fragment_files"), n(done & (F.col("fragment_count") == 0)).alias("zero_files"),
    )
    named = F.when(F.col("path") != "", F.col("path"))
    parse = (F.col("kind") == "parse") | (F.col("total_diagnostics") > 0)
    said = warnings.agg(
        F.count("*").alias("warnings"), F.countDistinct(named).alias("warning_files"), F.countDistinct(F.when(parse, named)).alias("diagnostic_files"),
        F.coalesce(F.sum(F.when(parse, F.col("total_diagnostics"))), F.lit(0)).alias("diagnostics"),
    )
    return own.crossJoin(said)  # one row each


def coverage_gates(summary: DataFrame, options: Options, focus: DataFrame | None = None, groups: int = 0) -> DataFrame:
    """(gate) rows of the policies that a scan fails: required_coverage, required_focus, file_coverage, zero_files, warnings, diagnostics.

    focus: one row required, covered. File coverage is the share of analyzed files that have fragments. A failed gate hides
    the ``matches`` of a scan that found groups.
    """
    c = F.col
    failed = []
    if options.require_coverage:
        failed.append(F.when((c("analyzed") == 0) | (c("fragments") == 0), "required_coverage"))
    if options.require_focus:
        short = focus.select((c("covered") < c("required")).alias("_short")) if focus is not None else summary.select(F.lit(True).alias("_short"))
        summary = summary.crossJoin(short)
        failed.append(F.when(c("_short"), "required_focus"))
    if options.min_file_coverage > 0:
        share = F.when(c("analyzed") > 0, c("fragment_files").cast("double") / c("analyzed")).otherwise(F.lit(-1.0))
        failed.append(F.when(share < options.min_file_coverage, "file_coverage"))
    if options.max_zero_files >= 0:
        failed.append(F.when(c("zero_files") > options.max_zero_files, "zero_files"))
    if options.fail_on_warning:
        failed.append(F.when(c("warnings") > 0, "warnings"))
    if options.fail_on_diagnostic:
        failed.append(F.when(c("diagnostic_files") > 0, "diagnostics"))
    gates = F.array_compact(F.array(*failed, F.lit(None).cast("string")))
    match = F.array(F.lit("matches")) if groups else F.array().cast("array<string>")
    return summary.select(F.explode(F.when(F.size(gates) > 0, gates).otherwise(match)).alias("gate"))
