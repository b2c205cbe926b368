"""A whole scan: files to syntax nodes, fragments, groups of similar fragments, coverage and totals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structsim.functions.names import fallback_name, label_above
from structsim.operators import groups as G
from structsim.operators import simjoin as J
from structsim.operators import spans as P
from structsim.operators import treebags as T
from structsim.options import Options
from structsim.sources import discover as D
from structsim.sources import extract as X
from structsim.sources.storage import stored

# Kinds of nodes that are a fragment each, and of those that are one as a whole file, with its name.
BOUNDARIES = ("function_definition", "function_declaration", "function_item", "method_declaration", "method_definition", "constructor_declaration")
SCRIPTS = ("program",)
SCRIPT_KIND, SCRIPT_NAME = "script", "top-level"


@dataclass
class Scan:
    """Tables of a scan; all but ``ranked`` and ``totals`` are stored."""

    coverage: DataFrame
    warnings: DataFrame
    fragments: DataFrame
    bags: DataFrame
    profiles: DataFrame
    similar: DataFrame
    groups: DataFrame
    totals: DataFrame
    lonely: DataFrame | None = None

    def ranked(self, options: Options) -> DataFrame:
        """The groups that are reported, in order."""
        return G.top_groups(self.groups, options.max_groups, options.ranking, options.focus_active)

    def places(self, options: Options) -> DataFrame:
        """The places of the reported groups, so many as are kept."""
        members = J.members(self.fragments, self.profiles, options.mode)
        kept = self.ranked(options).select("group_id")
        ids = G.counted_members(self.similar, members, self.lonely).join(kept, "group_id", "left_semi")
        return G.occurrences(ids, self.fragments, options.max_occurrences)


def selected_files(files: DataFrame, options: Options) -> DataFrame:
    """Files (path, content, size, language, family, domain, kind) of known language that a scan looks at, with their status."""
    marked = F.lit(options.exclude_generated) & D.generated_marker("content").isNotNull()
    large = F.col("size") > options.max_file_bytes if options.max_file_bytes else F.lit(False)
    chosen = F.col("language").isNotNull() & ~D.in_excluded_directory() & D.in_domains(options.domains) & D.below_roots(options.roots)
    return files.where(chosen).withColumn("status", F.when(large, "skipped_resource").when(marked, "excluded_generated").otherwise("analyzed"))


def located(files: DataFrame, units: DataFrame) -> DataFrame:
    """Fragments and blocks of ``treebags`` with location, fingerprint and size, from valid units with an id."""
    whole, block = F.col("node_kind").isin(*SCRIPTS) & (F.col("unit") == "fragment"), F.col("unit") == "block"
    lines = F.concat(F.lit("block@"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    name = F.when(block, lines).when(whole, F.lit(SCRIPT_NAME)).otherwise(fallback_name("said", "start_line", "kind"))
    kind = F.when(block, F.lit("block")).when(whole, F.lit(SCRIPT_KIND)).otherwise(F.col("kind"))
    made = units.join(files.select("path", "language", "family", "domain", "kind"), "path")
    made = made.withColumn("name", name).withColumn("kind", kind)
    return made.withColumn("n_features", F.size("features").cast("long")).drop("said", "node_kind", "node_id", "last_id", "unit")


def labelled(units: DataFrame, files: DataFrame) -> DataFrame:
    """Units whose name is the label in the comment line right above them, where their file (path, content) has one."""
    above = units.where("unit = 'fragment'").join(files.select("path", "content"), "path")
    labels = above.select("fragment_id", label_above("content", "start_byte").alias("label")).where("label is not null")
    return units.join(labels, "fragment_id", "left").withColumn("said", F.coalesce("label", "said")).drop("label")


def scan(files: DataFrame, options: Options, extractor: str | X.Reader = "python", boundaries: tuple[str, ...] = BOUNDARIES) -> Scan:
    """Scans files (path, content, size, language, family, domain, kind) that one extractor reads.

    Too many candidate pairs raise ``TooManyPairs`` before any is scored. With ``focus_active`` the files have a column
    ``focused``, which their fragments take over. With ``statement_blocks`` runs of statements are fragments, too.
    """
    mode = "same_family" if options.same_language_only and options.mode == "all" else options.mode
    options = replace(options, mode=mode)
    selected = selected_files(files, options)
    # contents are read once for the status and once for the units, and not written
    chosen = stored(selected.drop("content"), "files")
    read = selected.where("status = 'analyzed'")
    size, most = (options.block_statements, options.max_blocks_per_function) if options.statement_blocks else (0, 0)
    nodes = X.extract_nodes(read, extractor, copies=True)
    units = stored(T.with_id(T.streamed_units(nodes, boundaries, SCRIPTS, size, most)), "units")

    own = units.where("unit = 'fragment'")
    small = F.col("token_count") < options.min_tokens
    low = F.count(F.when(~F.col("invalid") & small, 1)).alias("below_floor")
    dropped = own.groupBy("path").agg(low, F.count(F.when(F.col("invalid"), 1)).alias("skipped"))
    skipped = dropped.select("path", F.col("skipped").alias("skipped_fragments"))
    message = F.coalesce("warning", F.lit("syntax errors")).alias("message")
    parse = units.where("unit = 'file'").select("path", F.lit("parse").alias("kind"), message, F.col("total").alias("total_diagnostics"))
    parse = parse.join(skipped, "path", "left")
    no = F.lit(0).cast("long")
    said = F.format_string("%s at line %d has more than %d windows of statements", F.coalesce("said", F.lit("a function")), "start_line", F.lit(most))
    over = units.where("unit = 'left_out'").select("path", F.lit("coverage").alias("kind"), said.alias("message"), no.alias("total_diagnostics"), no.alias("skipped_fragments"))
    warnings = stored(parse.na.fill(0, ["skipped_fragments"]).unionByName(over), "warnings")

    kept = units.where((F.col("unit") == "block") | (F.col("unit") == "fragment")).where(~F.col("invalid") & ~small)
    if chosen.where("kind = 'query' and status = 'analyzed'").take(1):
        kept = labelled(kept, read.where("kind = 'query'"))
    found = located(chosen, kept).drop("invalid", "total", "warning")
    if options.focus_active:
        found = found.join(chosen.select("path", "focused"), "path")
    found = stored(found, "fragments")
    listed = lambda some: some.select("fragment_id", F.explode("features").alias("feature", "cnt"))
    bags = listed(found)
    fragments = stored(P.annotate_nesting(found.drop("features")), "nested")
    pairs = J.check_pair_limit(fragments, options.threshold, options.max_pairs, mode, options.language_pairs, options.focused_only)
    profs = stored(J.profiles(fragments, mode), "profiles")
    # The join needs the bags that stand for a profile, not those of copies.
    standing = listed(found.join(profs.select(F.col("profile_id").alias("fragment_id")), "fragment_id", "left_semi"))
    similar = stored(J.similar_profiles(fragments, standing, options.threshold, mode, options.language_pairs, options.focused_only, profs), "similar")
    members = J.members(fragments, profs, mode)
    lonely = None
    if options.statement_blocks:
        members = stored(members, "members")
        similar, lonely = (stored(t, n) for t, n in zip(G.without_overlaps(similar, profs, members), ("similar", "lonely"), strict=True))
    flags = G.profile_flags(similar, members, options.priority_paths)
    groups = G.review_priority(G.group_counts(similar, profs), flags, options.priority_paths)
    if options.focus_active:
        counts = G.focused_counts(G.counted_members(similar, members, lonely), fragments)
        groups = groups.join(counts, "group_id", "left").na.fill(0, ["focused_count"])
    groups = stored(groups, "groups")
    coverage = stored(D.file_coverage(chosen, fragments, dropped, warnings), "coverage")
    candidates = chosen.sparkSession.range(1).select(F.lit(pairs).alias("candidate_pairs"))
    totals = G.report_totals(chosen.where("status = 'analyzed'").count(), fragments, candidates, groups, options.max_groups)
    return Scan(coverage, warnings, fragments, bags, profs, similar, groups, totals, lonely)
