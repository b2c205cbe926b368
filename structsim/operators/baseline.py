"""The reviewed baseline: entries, set operations, suppression, digests and receipts.

An entry is (id, similarity, left_path, left_key, right_path, right_key, classification, note). In content scope an id has
one entry; in path scope one per id and unordered pair of paths.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structsim.functions.names import pair_id
from structsim.operators.groups import with_location_key

SCOPES = ("content", "path")
# What a reviewer can call an accepted entry.
CLASSIFICATIONS = ("", "intentional", "necessary-duplication", "test-fixture", "generated", "false-positive", "other")
LONGEST_NOTE = 4096
ENTRY = "id string, similarity double, left_path string, left_key string, right_path string, right_key string, classification string, note string"


class BaselineError(ValueError):
    """A baseline that cannot be used as it is."""


def entry_key(scope: str, id_: str = "id", left: str = "left_path", right: str = "right_path") -> Column:
    if scope not in SCOPES:
        raise BaselineError(f"scope must be one of {SCOPES}")
    return F.col(id_) if scope == "content" else F.concat_ws("\x1f", id_, F.least(left, right), F.greatest(left, right))


def entries_from_groups(groups: DataFrame, places: DataFrame, scope: str) -> DataFrame:
    """Entries of the current groups (group_id, score) from their path pairs (``groups.path_pairs``).

    Content scope takes a group's first path pair; path scope, of the pairs with equal paths, the last one.
    """
    order = F.struct("left_key", "right_key")
    side = F.struct("left_path", "left_key", "right_path", "right_key")
    pick, key = (F.min_by, ["group_id"]) if scope == "content" else (F.max_by, ["group_id", F.least("left_path", "right_path").alias("p"), F.greatest("left_path", "right_path").alias("q")])
    if scope not in SCOPES:
        raise BaselineError(f"scope must be one of {SCOPES}")
    chosen = places.groupBy(*key).agg(pick(side, order).alias("s")).select("group_id", "s.*")
    return chosen.join(groups.select("group_id", "score"), "group_id").select(F.col("group_id").alias("id"), F.col("score").alias("similarity"), "left_path", "left_key", "right_path", "right_key", F.lit("").alias("classification"), F.lit("").alias("note"))


def _ends(members: DataFrame, by: list[str], last: bool) -> DataFrame:
    """Per profile (and path) its first two or last two places, ``one`` and ``two``: (location_key, path), two may be null."""
    order = F.col("location_key").desc() if last else F.col("location_key")
    own = Window.partitionBy("profile_id", *by).orderBy(order)
    nth = with_location_key(members).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= 2)
    side = F.struct("location_key", F.col("path").alias("at"))
    picks = [F.max(F.when(F.col("nth") == k, side)).alias(name) for k, name in ((1, "one"), (2, "two"))]
    return nth.groupBy("profile_id", *by).agg(*picks)


def _sides(similar: DataFrame, profs: DataFrame, each: DataFrame) -> DataFrame:
    """Pairs of profiles with their group_id and both sides' columns of ``each``, as l_* and r_*."""
    prints = profs.select("profile_id", "fingerprint")
    of = lambda a: each.join(prints, "profile_id").select(*[F.col(c).alias(f"{a}_{'id' if c == 'profile_id' else c}") for c in [*each.columns, "fingerprint"]])
    pairs = similar.select("l_id", "r_id", "score").join(of("l"), "l_id").join(of("r"), "r_id")
    return pairs.withColumn("group_id", pair_id("l_fingerprint", "r_fingerprint"))


def entries_from_profiles(similar: DataFrame, profs: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """``entries_from_groups`` without listing pairs of places, from pairs of profiles and fragments with ``profile_id``.

    Of all pairs of a place a of one set and b of another, the first in order of the lesser place and then of the greater
    is that of both sets' first places, and the last one that of their last places; within one set it is that of its
    first or last two. Content scope needs two places of a profile, path scope two of a profile and path; only pairs of
    paths are listed there, as each is an entry. Not for fragments among which blocks overlap.
    """
    if scope not in SCOPES:
        raise BaselineError(f"scope must be one of {SCOPES}")
    path = scope == "path"
    each = _ends(members, ["path"] if path else [], path)
    # Only a set with itself needs its second places.
    apart = _sides(similar.where("l_id <> r_id"), profs, each.drop("two"))
    own = each.where("two is not null").join(profs.select("profile_id", "fingerprint"), "profile_id")
    own = similar.where("l_id = r_id").select(F.col("l_id").alias("profile_id"), "score").join(own, "profile_id")
    own = own.select("score", pair_id("fingerprint", "fingerprint").alias("group_id"), F.col("one").alias("l_one"), F.col("two").alias("r_one"))
    both = apart.select("score", "group_id", "l_one", "r_one").unionByName(own)
    if path:
        # Places of one set in different paths are pairs, too.
        cross = _sides(similar.where("l_id = r_id"), profs, each.drop("two")).where("l_path < r_path")
        both = both.unionByName(cross.select("score", "group_id", "l_one", "r_one"))
    pair = F.struct(F.least("l_one", "r_one").alias("l"), F.greatest("l_one", "r_one").alias("r"))
    both = both.select("group_id", F.col("score").alias("similarity"), pair.alias("s"))
    # Sets of equal fingerprints in different partitions make several pairs of sets one group.
    shared = bool(profs.groupBy("fingerprint").count().where("count > 1").take(1))
    at = [F.least("s.l.at", "s.r.at").alias("p"), F.greatest("s.l.at", "s.r.at").alias("q")] if path else []
    chosen = both
    if path or shared:
        chosen = both.groupBy("group_id", *at).agg(F.max("similarity").alias("similarity"), (F.max("s") if path else F.min("s")).alias("s"))
    if path and shared:
        scores = both.groupBy("group_id").agg(F.max("similarity").alias("similarity"))
        chosen = chosen.drop("similarity").join(scores, "group_id")
    ends = [F.col(f"s.{x}.{c}").alias(f"{side}_{n}") for x, side in (("l", "left"), ("r", "right")) for c, n in (("at", "path"), ("location_key", "key"))]
    return chosen.select(F.col("group_id").alias("id"), "similarity", *ends, F.lit("").alias("classification"), F.lit("").alias("note"))


def suppressed_counts(similar: DataFrame, profs: DataFrame, members: DataFrame, baseline: DataFrame, scope: str) -> DataFrame:
    """One row suppressed_pairs, suppressed_groups, left_pairs of pairs of fragments, by arithmetic on profiles (and paths)."""
    by = ["path"] if scope == "path" else []
    both = _sides(similar, profs, members.groupBy("profile_id", *by).agg(F.count("*").alias("n")))
    same = F.col("l_id") == F.col("r_id")
    if by:
        both = both.where(~same | (F.col("l_path") <= F.col("r_path")))
        same = same & (F.col("l_path") == F.col("r_path"))
    n = F.when(same, F.expr("l_n * (l_n - 1) div 2")).otherwise(F.col("l_n") * F.col("r_n"))
    key = entry_key(scope, "group_id", "l_path", "r_path").alias("k")
    counted = both.select("group_id", key, n.alias("n")).where("n > 0").groupBy("group_id", "k").agg(F.sum("n").alias("n"))
    accepted = baseline.select(entry_key(scope).alias("k")).distinct().withColumn("known", F.lit(True))
    told = counted.join(accepted, "k", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return told.agg(
        total(F.col("known")).alias("suppressed_pairs"), F.count_distinct(F.when(F.col("known"), F.col("group_id"))).alias("suppressed_groups"),
        total(~F.col("known")).alias("left_pairs"),
    )


def refuse_truncated(truncated: bool) -> None:
    if truncated:
        raise BaselineError("a truncated report cannot change a baseline")


def replaced(current: DataFrame, previous: DataFrame, scope: str) -> DataFrame:
    """The current entries, with classification and note of equal previous ones."""
    old = previous.select(entry_key(scope).alias("k"), F.col("classification").alias("c0"), F.col("note").alias("n0"))
    out = current.withColumn("k", entry_key(scope)).join(old, "k", "left")
    return out.withColumn("classification", F.coalesce("c0", "classification")).withColumn("note", F.coalesce("n0", "note")).select(*current.columns)


def added(baseline: DataFrame, current: DataFrame, scope: str, id_: str, note: str | None = None, classification: str | None = None) -> tuple[DataFrame, int, int]:
    """The baseline with all current entries of one id; how many are new and how many were there. No such entry is an error."""
    _check_review(note, classification)
    mine = current.where(F.col("id") == id_).withColumn("k", entry_key(scope))
    old = baseline.withColumn("k", entry_key(scope))
    known = old.select("k", F.col("classification").alias("c0"), F.col("note").alias("n0"))
    merged = mine.join(known, "k", "left")
    counts = merged.agg(F.count("*").alias("n"), F.count("c0").alias("known")).first()
    if not counts["n"]:
        raise BaselineError(f"the scan has no group {id_}")
    merged = merged.withColumn("classification", F.lit(classification) if classification is not None else F.coalesce("c0", "classification"))
    merged = merged.withColumn("note", F.lit(note) if note is not None else F.coalesce("n0", "note"))
    rest = old.join(mine.select("k"), "k", "left_anti")
    return rest.select(*baseline.columns).unionByName(merged.select(*baseline.columns)), counts["n"] - counts["known"], counts["known"]


def _check_review(note: str | None, classification: str | None) -> None:
    if classification is not None and classification not in CLASSIFICATIONS:
        raise BaselineError(f"classification must be one of {CLASSIFICATIONS}")
    if note is not None and len(note.encode()) > LONGEST_NOTE:
        raise BaselineError(f"a note has at most {LONGEST_NOTE} bytes")


def _known(baseline: DataFrame, id_: str) -> int:
    n = baseline.where(F.col("id") == id_).count()
    if not n:
        raise BaselineError(f"the baseline has no entry {id_}")
    return n


def removed(baseline: DataFrame, id_: str) -> tuple[DataFrame, int]:
    n = _known(baseline, id_)
    return baseline.where(F.col("id") != id_), n


def edited(baseline: DataFrame, id_: str, note: str | None = None, classification: str | None = None) -> tuple[DataFrame, int]:
    if note is None and classification is None:
        raise BaselineError("an edit sets a note or a classification")
    _check_review(note, classification)
    n = _known(baseline, id_)
    for column, value in (("note", note), ("classification", classification)):
        if value is not None:
            baseline = baseline.withColumn(column, F.when(F.col("id") == id_, value).otherwise(F.col(column)))
    return baseline, n


def pruned(baseline: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """The entries that the current groups still have; nothing is added."""
    return baseline.withColumn("k", entry_key(scope)).join(current.select(entry_key(scope).alias("k")), "k", "left_semi").select(*baseline.columns)


def stale(baseline: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """The entries that the current groups no longer have."""
    return baseline.withColumn("k", entry_key(scope)).join(current.select(entry_key(scope).alias("k")), "k", "left_anti").orderBy("k").select(*baseline.columns)


def replacement_preview(baseline: DataFrame, current: DataFrame, scope: str) -> DataFrame:
    """One row: candidates, new, retained, removed."""
    a = current.select(entry_key(scope).alias("k"), F.lit(1).alias("now")).distinct()
    b = baseline.select(entry_key(scope).alias("k"), F.lit(1).alias("old")).distinct()
    return a.join(b, "k", "full").agg(
        F.count("now").alias("candidates"), F.count(F.when(F.col("old").isNull(), 1)).alias("new"),
        F.count(F.when(F.col("now").isNotNull() & F.col("old").isNotNull(), 1)).alias("retained"), F.count(F.when(F.col("now").isNull(), 1)).alias("removed"),
    )


def suppress(pairs: DataFrame, baseline: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(pairs that stay, one row suppressed_pairs and suppressed_groups). Pairs have group_id, left_path and right_path.

    In path scope a group can be suppressed in part, and its id then counts in both.
    """
    key = entry_key(scope, "group_id").alias("k")
    accepted = baseline.select(entry_key(scope).alias("k")).distinct()
    keyed = pairs.withColumn("k", key)
    gone = keyed.join(accepted, "k", "left_semi").agg(F.count("*").alias("suppressed_pairs"), F.countDistinct("group_id").alias("suppressed_groups"))
    return keyed.join(accepted, "k", "left_anti").drop("k"), gone


def profile_digest(profile: Mapping[str, object]) -> str:
    """SHA-256 of a scan profile; lists are sorted and without repeats."""
    plain = {k: sorted({json.dumps(x, sort_keys=True) for x in v}) if isinstance(v, (list, tuple, set)) else v for k, v in profile.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()


#: How many digests one step of ``index_digest`` joins, about.
DIGEST_FAN = 4096


def index_digest(entries: DataFrame) -> DataFrame:
    """One row ``index_digest`` over (mode, oid, path), equal for equal sets of entries.

    Each entry's digest is SHA-256 of mode, oid and path, NUL after each. A single stream over all entries would be one
    task, so digests are joined as a tree: sorted ones with a common beginning are digested together, about ``DIGEST_FAN``
    at a time, until one is left.
    """
    nul = F.lit("\x00")
    level = entries.select(F.sha2(F.concat("mode", nul, "oid", nul, "path", nul).cast("binary"), 256).alias("d"))
    n, fan_digits = entries.count(), 3
    digits = 0
    while 16**digits * DIGEST_FAN < n:
        digits += 1
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "").cast("binary"), 256)
    key = F.substring("d", 1, digits)
    while digits:
        level = level.groupBy(key.alias("k")).agg(joined.alias("d"))
        digits = max(0, digits - fan_digits)
        key = F.substring("k", 1, digits)
    return level.agg(joined.alias("index_digest"))


def validate(entries: DataFrame, meta: Mapping[str, object], expected: Mapping[str, object], scope: str) -> None:
    """Fails unless version, digest and threshold are as expected and every entry is well formed and unique."""
    for name in ("schema_version", "normalization_version", "profile_digest", "threshold"):
        if meta.get(name) != expected.get(name):
            raise BaselineError(f"the baseline's {name} is {meta.get(name)!r}, not {expected.get(name)!r}; migrate it or scan as before")
    bad = entries.where(F.col("id").isNull() | (F.col("id") == "") | ~F.col("classification").isin(*CLASSIFICATIONS) | (F.octet_length("note") > LONGEST_NOTE) | ~F.col("similarity").between(0, 1))
    if bad.take(1):
        raise BaselineError("the baseline has an entry that is not well formed")
    if entries.groupBy(entry_key(scope)).count().where("count > 1").take(1):
        raise BaselineError("the baseline has repeated entries")


def write_baseline(entries: DataFrame, path: str, meta: Mapping[str, object], scope: str) -> None:
    """Sorted entries and one metadata row, both as JSON lines."""
    entries.orderBy(entry_key(scope)).write.mode("overwrite").json(f"{path}/entries")
    spark = entries.sparkSession
    spark.createDataFrame([(json.dumps(dict(meta), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_baseline(spark, path: str, expected: Mapping[str, object], scope: str) -> DataFrame:
    """The entries of a baseline that passes ``validate``."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    entries = spark.read.schema(ENTRY).option("mode", "FAILFAST").json(f"{path}/entries").na.fill("", ["classification", "note"])
    validate(entries, meta, expected, scope)
    return entries


def warnings_by_kind(warnings: DataFrame, allowed: Iterable[str] = ()) -> DataFrame:
    """(kind, n) of warnings that are not allowed; an empty kind is ``other``. Any row blocks a baseline change."""
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "other").otherwise(F.col("kind"))
    return warnings.select(kind.alias("kind")).where(~F.col("kind").isin(*list(allowed) or [""])).groupBy("kind").agg(F.count("*").alias("n"))


RECEIPT_FIELDS = ("tool_version", "head_commit", "index_digest", "profile_digest", "normalization_version")


def make_receipt(groups: DataFrame, evidence: Mapping[str, str]) -> DataFrame:
    """One row: the evidence fields and the sorted ids of focused groups (group_id). Ids must be well formed, and some."""
    ids = groups.select("group_id").distinct()
    state = ids.agg(F.count("*").alias("n"), F.count(F.when(~F.col("group_id").rlike("^[0-9a-f]{16}:[0-9a-f]{16}$"), 1)).alias("bad")).first()
    if not state["n"]:
        raise BaselineError("no focused group needs a receipt")
    if state["bad"]:
        raise BaselineError("an id is not a pair of fingerprints")
    return ids.agg(F.array_sort(F.collect_list("group_id")).alias("ids")).select(*[F.lit(evidence[f]).alias(f) for f in RECEIPT_FIELDS], "ids")


def receipt_drift(receipt: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``drift``: the first field in which the receipt and a current one differ, null if it holds."""
    a, b = receipt.alias("a"), current.alias("b")
    checks = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in (*RECEIPT_FIELDS, "ids")]
    return a.crossJoin(b).select(F.coalesce(*checks).alias("drift"))


def receipt_digest(receipt: DataFrame) -> DataFrame:
    """One row ``digest``: SHA-256 of the receipt's fields and ids as JSON, equal for equal receipts."""
    return receipt.select(F.sha2(F.to_json(F.struct(*RECEIPT_FIELDS, "ids")).cast("binary"), 256).alias("digest"))


def match_gates(totals: DataFrame, fail_on_match: bool = False, fail_on_focused_match: bool = False, drift: DataFrame | None = None) -> DataFrame:
    """(gate) rows of the policies on matches that a scan fails: matches, focused_matches.

    totals: one row total_groups, focused_groups. ``drift``: of the receipt that was given (``receipt_drift``); one that
    holds waives the gate on focused matches, and no other.
    """
    waived = drift.select(F.col("drift").isNull().alias("_waived")) if drift is not None else totals.select(F.lit(False).alias("_waived"))
    every, focused = F.lit(fail_on_match) & (F.col("total_groups") > 0), F.lit(fail_on_focused_match) & (F.col("focused_groups") > 0)
    gates = F.array_compact(F.array(F.when(every, "matches"), F.when(focused & ~F.col("_waived"), "focused_matches")))
    return totals.crossJoin(waived).select(F.explode(gates).alias("gate"))


def migrated(entries: DataFrame, meta: Mapping[str, object], profile: Mapping[str, object], threshold: float, scope: str) -> tuple[DataFrame, dict[str, object]]:
    """The entries with their metadata as they are, and ``meta`` with the digest of a scan profile that was accepted."""
    kept = dict(meta) | {"profile_digest": profile_digest(profile), "threshold": threshold}
    validate(entries, kept, kept, scope)
    return entries, kept
