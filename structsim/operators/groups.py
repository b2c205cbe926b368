"""Groups of similar fragments: identity, counts, occurrences, literal evidence, review priority and order."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structsim.functions.names import glob_match, is_distinctive_name, location_key, pair_id, parent_dir
from structsim.operators.spans import overlapping_blocks


def group_counts(similar: DataFrame, profs: DataFrame) -> DataFrame:
    """Groups from pairs of profiles (``simjoin.similar_profiles``) by counting, without listing pairs of fragments.

    A group is an unordered pair of fingerprints, also across partitions: group_id, score, min_fc, location_pairs.
    Where blocks may overlap, ``similar`` comes from ``without_overlaps``.
    """
    left = profs.select(F.col("profile_id").alias("l_id"), F.col("fingerprint").alias("lf"), F.col("n_occ").alias("ln"))
    right = profs.select(F.col("profile_id").alias("r_id"), F.col("fingerprint").alias("rf"), F.col("n_occ").alias("rn"))
    n = _all_pairs() - (F.col("overlaps") if "overlaps" in similar.columns else F.lit(0))
    return (
        similar.join(left, "l_id").join(right, "r_id").groupBy(pair_id("lf", "rf").alias("group_id"))
        .agg(F.max("score").alias("score"), F.min(F.least("l_fc", "r_fc")).alias("min_fc"), F.sum(n).alias("location_pairs"))
    )


def _all_pairs() -> Column:
    """Pairs of fragments of two profiles with ln and rn fragments."""
    return F.when(F.col("l_id") == F.col("r_id"), F.expr("ln * (ln - 1) div 2")).otherwise(F.col("ln") * F.col("rn"))


def without_overlaps(similar: DataFrame, profs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(similar, lonely): pairs of profiles that have pairs of fragments left when overlapping blocks of a path are none.

    ``similar`` has a column ``overlaps``, the number of pairs to take away. lonely: l_id, r_id, fragment_id of fragments
    that overlap every partner. Only the overlapping pairs are listed, never all pairs of two profiles.
    """
    of = members.where("kind = 'block'").select("fragment_id", "profile_id")
    met = overlapping_blocks(members).join(of.toDF("l_id", "lp"), "l_id").join(of.toDF("r_id", "rp"), "r_id")
    pair = [F.least("lp", "rp").alias("l_id"), F.greatest("lp", "rp").alias("r_id")]
    counts = met.groupBy(*pair).agg(F.count("*").alias("overlaps"))
    sizes = profs.select("profile_id", "n_occ")
    sized = similar.join(counts, ["l_id", "r_id"], "left").na.fill(0, ["overlaps"])
    sized = sized.join(sizes.toDF("l_id", "ln"), "l_id").join(sizes.toDF("r_id", "rn"), "r_id")
    left = sized.where(_all_pairs() > F.col("overlaps")).drop("ln", "rn")
    side = lambda own, other: F.struct(F.col(own).alias("fragment_id"), F.col(other).alias("other"))
    both = F.explode(F.array(side("l_id", "rp"), side("r_id", "lp"))).alias("s")
    each = met.select("lp", "rp", both).groupBy(*pair, "s.fragment_id", "s.other").agg(F.count("*").alias("met"))
    partners = F.col("n_occ") - F.when(F.col("l_id") == F.col("r_id"), 1).otherwise(0)
    each = each.join(sizes.withColumnRenamed("profile_id", "other"), "other")
    return left, each.where(F.col("met") == partners).select("l_id", "r_id", "fragment_id")


def match_groups(pairs: DataFrame) -> DataFrame:
    """Groups from listed pairs (``simjoin.similar_pairs``): group_id, score, location_pairs."""
    return pairs.groupBy(pair_id("left_fingerprint", "right_fingerprint").alias("group_id")).agg(F.max("score").alias("score"), F.count("*").alias("location_pairs"))


def with_location_key(fragments: DataFrame) -> DataFrame:
    return fragments.withColumn("location_key", location_key("path", "start_line", "end_line", "language", "name"))


def listed_members(pairs: DataFrame) -> DataFrame:
    """(group_id, fragment_id, fingerprint) of the fragments in listed pairs."""
    side = lambda c: F.struct(F.col(f"{c}_id").alias("fragment_id"), F.col(f"{c}_fingerprint").alias("fingerprint"))
    both = pairs.select(pair_id("left_fingerprint", "right_fingerprint").alias("group_id"), F.explode(F.array(side("left"), side("right"))).alias("s"))
    return both.select("group_id", "s.*").distinct()


def counted_members(similar: DataFrame, members: DataFrame, lonely: DataFrame | None = None) -> DataFrame:
    """The same from pairs of profiles and the fragments with their ``profile_id``; no pair of fragments is listed.

    ``lonely``: the fragments that are in no pair of a pair of profiles (``without_overlaps``).
    """
    prints = members.select("profile_id", "fingerprint").distinct()
    left = prints.select(F.col("profile_id").alias("l_id"), F.col("fingerprint").alias("lf"))
    right = prints.select(F.col("profile_id").alias("r_id"), F.col("fingerprint").alias("rf"))
    sides = F.explode(F.array("l_id", "r_id")).alias("profile_id")
    ids = similar.join(left, "l_id").join(right, "r_id").select(pair_id("lf", "rf").alias("group_id"), "l_id", "r_id", sides)
    own = members.select("profile_id", "fragment_id", "fingerprint")
    if lonely is None:
        return ids.select("group_id", "profile_id").distinct().join(own, "profile_id").select("group_id", "fragment_id", "fingerprint")
    found = ids.join(own, "profile_id").join(lonely, ["l_id", "r_id", "fragment_id"], "left_anti")
    return found.select("group_id", "fragment_id", "fingerprint").distinct()


def pairs_of_groups(similar: DataFrame, profs: DataFrame, few: DataFrame) -> DataFrame:
    """The pairs of profiles that a few groups (group_id) are of, so few that every task can hold them."""
    sides = F.split("group_id", ":")
    ends = few.select(F.explode(F.array_distinct(sides)).alias("fingerprint")).distinct()
    prints = profs.select("profile_id", "fingerprint").join(F.broadcast(ends), "fingerprint", "left_semi")
    side = lambda a: prints.select(F.col("profile_id").alias(f"{a}_id"), F.col("fingerprint").alias(f"{a}f"))
    held = similar.join(side("l"), "l_id").join(side("r"), "r_id").withColumn("group_id", pair_id("lf", "rf"))
    return held.join(F.broadcast(few.select("group_id")), "group_id", "left_semi").select(*similar.columns)


def occurrences(ids: DataFrame, fragments: DataFrame, max_occurrences: int = 0) -> DataFrame:
    """The places of each profile of each group: group_id, fingerprint, location_key, place, occurrence_count.

    ids: (group_id, fragment_id, fingerprint), as from ``listed_members`` or ``counted_members``. Places are distinct and
    ordered; the count is exact, and at most ``max_occurrences`` places are kept (0: all).
    """
    places = ids.join(with_location_key(fragments).select("fragment_id", "location_key"), "fragment_id").select("group_id", "fingerprint", "location_key").distinct()
    own = Window.partitionBy("group_id", "fingerprint")
    out = places.withColumn("place", F.row_number().over(own.orderBy("location_key"))).withColumn("occurrence_count", F.count("*").over(own))
    return out.where(F.col("place") <= max_occurrences) if max_occurrences else out


def path_pairs(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Distinct unordered pairs of places per group: group_id, left_key, right_key and both sides' path and name."""
    has = with_location_key(fragments).select("fragment_id", "location_key", "path", "name")
    left = has.select(F.col("fragment_id").alias("left_id"), F.struct(F.col("location_key").alias("key"), "path", "name").alias("l"))
    right = has.select(F.col("fragment_id").alias("right_id"), F.struct(F.col("location_key").alias("key"), "path", "name").alias("r"))
    both = pairs.join(left, "left_id").join(right, "right_id").select(pair_id("left_fingerprint", "right_fingerprint").alias("group_id"), F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"))
    return both.select("group_id", F.col("l.key").alias("left_key"), F.col("r.key").alias("right_key"), F.col("l.path").alias("left_path"), F.col("r.path").alias("right_path"), F.col("l.name").alias("left_name"), F.col("r.name").alias("right_name")).distinct()


def profile_path_pairs(similar: DataFrame, members: DataFrame) -> DataFrame:
    """``path_pairs`` from pairs of profiles and fragments with ``profile_id``: a pair is made where its sides meet, with all it has.

    Pairs of fragments are distinct, so only where fragments share a place are pairs of places made distinct. Not for
    fragments among which blocks overlap.
    """
    place = F.struct(F.col("location_key").alias("key"), "path", "name")
    has = with_location_key(members).select("profile_id", "fragment_id", "fingerprint", place.alias("at"))
    side = lambda a: has.select(*[F.col(c).alias(f"{a}_{n}") for c, n in (("profile_id", "id"), ("fragment_id", "fragment"), ("fingerprint", "print"), ("at", "at"))])
    both = similar.select("l_id", "r_id").join(side("l"), "l_id").join(side("r"), "r_id")
    both = both.where((F.col("l_id") != F.col("r_id")) | (F.col("l_fragment") < F.col("r_fragment")))
    both = both.select(pair_id("l_print", "r_print").alias("group_id"), F.least("l_at", "r_at").alias("l"), F.greatest("l_at", "r_at").alias("r"))
    names = [F.col(f"{a}.{c}").alias(f"{side}_{c}") for c in ("key", "path", "name") for a, side in (("l", "left"), ("r", "right"))]
    out = both.select("group_id", *names)
    return out.distinct() if has.groupBy("at").count().where("count > 1").take(1) else out


def partner_counts(similar: DataFrame, members: DataFrame) -> DataFrame:
    """The distinct places of fragments with ``profile_id``, each with the path pairs (``path_pairs``) it is a side of.

    profile_id, fragment_id, path, location_key; others: its partners in other profiles; own: those in its own, 0 where
    that is not similar to itself. Counted from profiles; for fragments whose places are their own alone.
    """
    places = with_location_key(members).select("profile_id", "fragment_id", "path", "location_key").distinct()
    sizes = places.groupBy("profile_id").agg(F.count("*").alias("n"))
    side = lambda a, b: F.struct(F.col(a).alias("profile_id"), F.col(b).alias("other"))
    ends = similar.where("l_id <> r_id").select(F.explode(F.array(side("l_id", "r_id"), side("r_id", "l_id"))).alias("s")).select("s.*")
    others = ends.join(sizes.withColumnRenamed("profile_id", "other"), "other").groupBy("profile_id").agg(F.sum("n").alias("others"))
    itself = similar.where("l_id = r_id").select(F.col("l_id").alias("profile_id")).join(sizes, "profile_id")
    held = places.groupBy("profile_id", "fragment_id").agg(F.count("*").alias("held"))
    out = places.join(held, ["profile_id", "fragment_id"]).join(others, "profile_id", "left").join(itself, "profile_id", "left")
    return out.withColumn("own", F.coalesce(F.col("n") - F.col("held"), F.lit(0))).na.fill(0, ["others"]).drop("n", "held")


def literal_evidence(pairs: DataFrame, literals: DataFrame) -> DataFrame:
    """How literals (fragment_id, literal_digests: array) differ within groups that have any.

    group_id, compared_pairs, pairs_with_differences, max_differing, count_mismatch_pairs. Positions are compared over the
    shorter list, and the gap in length counts as differing.
    """
    none = F.array().cast("array<string>")
    side = lambda a, b: literals.select(F.col("fragment_id").alias(a), F.col("literal_digests").alias(b))
    both = pairs.join(side("left_id", "l"), "left_id", "left").join(side("right_id", "r"), "right_id", "left")
    both = both.select(pair_id("left_fingerprint", "right_fingerprint").alias("group_id"), F.coalesce("l", none).alias("l"), F.coalesce("r", none).alias("r")).where((F.size("l") > 0) | (F.size("r") > 0))
    shorter = F.least(F.size("l"), F.size("r"))
    unequal = F.size(F.filter(F.zip_with(F.slice("l", 1, shorter), F.slice("r", 1, shorter), lambda a, b: a != b), lambda x: x))
    gap = F.abs(F.size("l") - F.size("r"))
    diff = both.select("group_id", gap.alias("gap"), (unequal + gap).alias("d"))
    return diff.groupBy("group_id").agg(
        F.count("*").alias("compared_pairs"), F.count(F.when(F.col("d") > 0, 1)).alias("pairs_with_differences"),
        F.max("d").alias("max_differing"), F.count(F.when(F.col("gap") > 0, 1)).alias("count_mismatch_pairs"),
    )


def profile_literal_evidence(similar: DataFrame, members: DataFrame, literals: DataFrame) -> DataFrame:
    """``literal_evidence`` from pairs of profiles and fragments with ``profile_id``, without listing pairs of fragments.

    Fragments of a profile with equal literals stand for each other: pairs of different lists are compared once and
    counted by the products of how often the lists occur.
    """
    none = F.array().cast("array<string>")
    own = members.select("profile_id", "fingerprint", "fragment_id").join(literals.select("fragment_id", "literal_digests"), "fragment_id", "left")
    lists = own.groupBy("profile_id", "fingerprint", F.coalesce("literal_digests", none).alias("d")).agg(F.count("*").alias("n"))
    side = lambda a: lists.select(*[F.col(c).alias(f"{a}_{n}") for c, n in (("profile_id", "id"), ("fingerprint", "print"), ("d", "d"), ("n", "n"))])
    both = similar.select("l_id", "r_id").join(side("l"), "l_id").join(side("r"), "r_id")
    itself, equal = F.col("l_id") == F.col("r_id"), F.col("l_d") == F.col("r_d")
    n = F.when(itself & equal, F.expr("l_n * (l_n - 1) div 2")).otherwise(F.col("l_n") * F.col("r_n"))
    both = both.where(~itself | (F.col("l_d") <= F.col("r_d"))).withColumn("n", n)
    both = both.where((F.col("n") > 0) & ((F.size("l_d") > 0) | (F.size("r_d") > 0)))
    shorter = F.least(F.size("l_d"), F.size("r_d"))
    unequal = F.zip_with(F.slice("l_d", 1, shorter), F.slice("r_d", 1, shorter), lambda a, b: a != b)
    gap = F.abs(F.size("l_d") - F.size("r_d"))
    differing = F.when(equal, 0).otherwise(F.size(F.filter(unequal, lambda x: x)) + gap)
    told = both.select(pair_id("l_print", "r_print").alias("group_id"), "n", gap.alias("gap"), differing.alias("differing"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return told.groupBy("group_id").agg(
        F.sum("n").cast("long").alias("compared_pairs"), total(F.col("differing") > 0).alias("pairs_with_differences"),
        F.max("differing").alias("max_differing"), total(F.col("gap") > 0).alias("count_mismatch_pairs"),
    )


def _rule_flags(rules: tuple[tuple[str, int], ...], *paths: str) -> list[Column]:
    hit = lambda p: reduce(lambda a, b: a | b, (glob_match(p, path) for path in paths))
    return [F.bool_or(hit(p)).alias(f"rule{k}") for k, (p, _) in enumerate(rules)]


def place_flags(places: DataFrame, rules: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """What path pairs say about their group: group_id, same_name_away, away, same_name, other_file and a flag per rule."""
    rules = tuple(rules)
    other = F.col("left_path") != F.col("right_path")
    same = other & is_distinctive_name("left_name") & (F.col("left_name") == F.col("right_name"))
    away = other & (parent_dir("left_path") != parent_dir("right_path"))
    flags = [F.bool_or(c).alias(n) for c, n in ((same & away, "same_name_away"), (away, "away"), (same, "same_name"), (other, "other_file"))]
    return places.groupBy("group_id").agg(*flags, *_rule_flags(rules, "left_path", "right_path"))


def profile_flags(similar: DataFrame, members: DataFrame, rules: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """The same from pairs of profiles and the fragments with their ``profile_id``, without listing pairs of places.

    Two sides have unequal paths somewhere unless all their paths are one, so least and greatest paths and directories say
    it all, for whole profiles and for the fragments of one name in them. Overlapping blocks are of one path, so that
    leaving their pairs out changes no flag of a pair of profiles that has others.
    """
    rules = tuple(rules)
    ends = [F.min("path").alias("p0"), F.max("path").alias("p1"), F.min(parent_dir("path")).alias("d0"), F.max(parent_dir("path")).alias("d1")]
    whole = members.groupBy("profile_id", "fingerprint").agg(*ends, *_rule_flags(rules, "path"))
    named = members.where(is_distinctive_name("name")).groupBy("profile_id", "name").agg(*ends)
    as_side = lambda frame, a: frame.select(*[F.col(c).alias(c if c == "name" else "l_id r_id".split()[a == "r"] if c == "profile_id" else f"{a}_{c}") for c in frame.columns])
    differ = lambda c: F.least(f"l_{c}0", f"r_{c}0") != F.greatest(f"l_{c}1", f"r_{c}1")
    pairs = similar.select("l_id", "r_id")
    sides = pairs.join(as_side(whole, "l"), "l_id").join(as_side(whole, "r"), "r_id")
    files = [F.bool_or(differ("d")).alias("away"), F.bool_or(differ("p")).alias("other_file")]
    files += [F.bool_or(F.col(f"l_rule{k}") | F.col(f"r_rule{k}")).alias(f"rule{k}") for k in range(len(rules))]
    group = pair_id("l_fingerprint", "r_fingerprint").alias("group_id")
    names = pairs.join(as_side(named, "l"), "l_id").join(as_side(named, "r"), ["r_id", "name"])
    names = names.groupBy("l_id", "r_id").agg(F.bool_or(differ("d")).alias("n_away"), F.bool_or(differ("p")).alias("n_other"))
    same = [F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for c, n in (("n_away", "same_name_away"), ("n_other", "same_name"))]
    return sides.join(names, ["l_id", "r_id"], "left").groupBy(group).agg(*same, *files)


def review_priority(groups: DataFrame, flags: DataFrame, rules: Iterable[tuple[str, int]] = ()) -> DataFrame:
    """Adds priority and signals to groups (group_id, location_pairs) by their flags (``place_flags`` or ``profile_flags``)."""
    rules = tuple(rules)
    known = [("same_name_away", 4, "same-name-cross-directory"), ("away", 2, "cross-directory"), ("same_name", 2, "same-name-cross-file"), ("other_file", 1, "cross-file")]
    terms = [(F.col(c), w, s) for c, w, s in known] + [(F.col("location_pairs") > 1, 1, "repeated-location-pairs")]
    terms += [(F.col(f"rule{k}"), w, f"priority-path:{p}(+{w})") for k, (p, w) in enumerate(rules)]
    total = sum((F.when(c, w).otherwise(0) for c, w, _ in terms), F.lit(0))
    signals = F.array_compact(F.array(*[F.when(c, s) for c, _, s in terms]))
    marked = groups.join(flags, "group_id").withColumn("priority", total).withColumn("signals", signals)
    return marked.drop(*[c for c, _, _ in known], *[f"rule{k}" for k in range(len(rules))])


def focused_counts(ids: DataFrame, fragments: DataFrame) -> DataFrame:
    """Distinct focused places per group (group_id, focused_count), for groups that have any; fragments have ``focused``."""
    found = occurrences(ids, fragments.where("focused"))
    return found.groupBy("group_id").agg(F.countDistinct("location_key").alias("focused_count"))


def order_columns(ranking: str = "structural", focus_active: bool = False) -> list[Column]:
    """The total order of groups: focused first, review priority, score, smaller bag's size, pairs, id."""
    first = [(F.coalesce(F.col("focused_count"), F.lit(0)) > 0).desc()] if focus_active else []
    review = [F.col("priority").desc()] if ranking == "review" else []
    return [*first, *review, F.col("score").desc(), F.col("min_fc").desc(), F.col("location_pairs").desc(), F.col("group_id")]


def top_groups(groups: DataFrame, max_groups: int, ranking: str = "structural", focus_active: bool = False) -> DataFrame:
    """The first groups by rank (0: all); a top-k, so no task holds more than ``max_groups`` rows of a partition."""
    order = order_columns(ranking, focus_active)
    kept = groups.orderBy(*order)
    kept = kept.limit(max_groups) if max_groups else kept
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order))) if max_groups else kept


def report_totals(files: int, fragments: DataFrame, candidate_pairs: DataFrame, groups: DataFrame, max_groups: int, suppressed: DataFrame | None = None) -> DataFrame:
    """One row of totals, all taken before groups are cut."""
    g = groups.agg(F.coalesce(F.sum("location_pairs"), F.lit(0)).alias("location_pairs"), F.count("*").alias("total_groups"), F.count(F.when(F.col("focused_count") > 0, 1)).alias("focused_groups") if "focused_count" in groups.columns else F.lit(0).alias("focused_groups"))
    out = fragments.agg(F.count("*").alias("fragments")).crossJoin(candidate_pairs).crossJoin(g).withColumn("files", F.lit(files))
    out = out.crossJoin(suppressed) if suppressed is not None else out.withColumn("suppressed_pairs", F.lit(0)).withColumn("suppressed_groups", F.lit(0))
    return out.withColumn("truncated", (F.lit(max_groups) > 0) & (F.col("total_groups") > max_groups))


def fragment_order() -> list[Column]:
    """The order of fragments in a report."""
    return [location_key("path", "start_line", "end_line", "language", "name")]


def warning_order() -> list[Column]:
    """The order of warnings in a report."""
    return [F.col("path"), F.col("message")]
