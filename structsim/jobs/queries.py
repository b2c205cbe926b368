"""The registered queries of the similarity operators, over the given tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structsim.functions import names as N
from structsim.operators import explain as X
from structsim.operators import groups as G
from structsim.operators import simjoin as J
from structsim.sources import adapters as A
from structsim.sources.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DOC_THRESHOLD, SUPPLIER_THRESHOLD = 0.8, 0.85


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- shared SQL -----------------------------------------------------------------------------------------------------
_SPLIT = r"regexp_split_to_array({0}, '[ \t\r\n]+')"
SQL_DOC_BAGS = f"""
bags as (select doc_id as id, 'word:' || w as feature, count(*)::int as cnt
  from (select doc_id, unnest({_SPLIT.format('lower(text)')}) as w from documents) where w <> '' group by all),
prints as (select id, sum(cnt) as fc, count(*) as nf,
  substr(sha256(string_agg(feature || chr(31) || cnt || chr(30), '' order by feature)), 1, 16) as fp from bags group by id),
frags as (select doc_id as id, source || '/' || lang || '/doc_' || doc_id || '.txt' as path, lang as language,
  case when lang in ('fr', 'es') then 'romance' when lang in ('en', 'de') then 'germanic' else 'none' end as family,
  source as name, 1 as start_line, len(string_split(text, chr(10))) as end_line, fc, fp from documents join prints on id = doc_id)"""
SQL_SUPPLIER_BAGS = """
bags as (select l_suppkey as id, p_brand as feature, count(*)::int as cnt
  from lineitem join part on l_partkey = p_partkey group by all),
prints as (select id, sum(cnt) as fc, count(*) as nf,
  substr(sha256(string_agg(feature || chr(31) || cnt || chr(30), '' order by feature)), 1, 16) as fp from bags group by id),
frags as (select s_suppkey as id, r_name || '/' || n_name || '/s_' || s_suppkey as path, n_name as language, r_name as family,
  n_name as name, 1 as start_line, 1 as end_line, fc, fp
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey join prints on id = s_suppkey)"""


def sql_pairs(threshold: float, where: str = "true") -> str:
    """Pairs of ``frags`` that reach the threshold, over whole bags: (a, b, inter, uni, score).

    Of fragments with equal bags one is compared. Two bags that reach the threshold t share one of the features that
    stand, rarest first, before the last t of a bag's weight, so only bags that share such a feature are compared.
    """
    return f"""
uniq as materialized (select fp, min(id) as rep, any_value(fc) as fc from frags group by fp),
ubag as materialized (select rep, fc, feature, cnt from uniq join bags on id = rep),
rarity as (select feature, count(*) as df from ubag group by feature),
ahead as (select rep, fc, feature, coalesce(sum(cnt) over (partition by rep order by df, feature rows between unbounded preceding and 1 preceding), 0) as before from ubag join rarity using (feature)),
pre as materialized (select * from ahead where before <= fc - ceil({threshold} * fc - 1e-9)),
near as materialized (select distinct l.rep as a, r.rep as b, l.fc as afc, r.fc as bfc from pre l join pre r on l.feature = r.feature and l.rep < r.rep
  and least(l.fc, r.fc)::double / greatest(l.fc, r.fc) >= {threshold}
  and least(l.fc - l.before, r.fc - r.before) >= ceil({threshold / (1 + threshold)} * (l.fc + r.fc) - 1e-6)),
met as (select a, b, afc, bfc, sum(least(x.cnt, y.cnt)) as inter from near join ubag x on x.rep = a join ubag y on y.rep = b and y.feature = x.feature group by a, b, afc, bfc),
likes as materialized (select l.fp as x, r.fp as y, inter, afc + bfc - inter as uni from met join uniq l on l.rep = a join uniq r on r.rep = b where inter::double / (afc + bfc - inter) >= {threshold}
  union all select fp, fp, fc, fc from uniq),
pairs as (select l.id as a, r.id as b, l.fc as afc, r.fc as bfc, l.fp as afp, r.fp as bfp, l.path as apath, r.path as bpath, l.name as aname, r.name as bname,
  inter, uni, inter::double / uni as score
  from (select x, y, inter, uni from likes union select y, x, inter, uni from likes) join frags l on l.fp = x join frags r on r.fp = y and l.id < r.id where {where})"""


SQL_GROUPS = """
groups as (select least(afp, bfp) || ':' || greatest(afp, bfp) as group_id, max(score) as score, min(least(afc, bfc)) as min_fc, count(*) as location_pairs
  from pairs group by 1)"""


# --- bags and identity ------------------------------------------------------------------------------------------------
@query(f"with {SQL_DOC_BAGS} select id as fragment_id, fc::bigint as feature_count, nf as n_features, fp as fingerprint from prints")
def fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: fingerprints of word bags."""
    return A.document_prints(spark, sf_dir).select("fragment_id", "feature_count", "n_features", "fingerprint")


@query("""
with parts as (select doc_id as id, lang || '/' || source as whole, 'word:' || w as feature, count(*) as cnt
  from (select doc_id, lang, source, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) as w from documents) where w <> '' group by all),
m as (select whole, feature, sum(cnt)::bigint as cnt from parts group by all
  union all select distinct lang || '/' || source, 'node:root', 1 from documents)
select whole as fragment_id, count(*) as n_features, sum(cnt)::bigint as feature_count,
  substr(sha256(string_agg(feature || chr(31) || cnt || chr(30), '' order by feature)), 1, 16) as fingerprint from m group by whole""")
def merged_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the documents of a source and language as one bag under a root."""
    from structsim.operators import bags as B

    files = A.document_files(spark, sf_dir)
    return B.fingerprints(B.merge_rows(B.with_words(files.select(F.concat_ws("/", "language", "name").alias("whole_id"), "text"))))


# --- joins ------------------------------------------------------------------------------------------------------------
def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("left_id", "right_id", F.col("intersection").cast("long").alias("intersection"), F.col("union_size").cast("long").alias("union_size"), "score")


_SELECT_PAIRS = "select a as left_id, b as right_id, inter::bigint as intersection, uni::bigint as union_size, score from pairs"


@query(f"with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)} {_SELECT_PAIRS}")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents by weighted Jaccard of their word bags."""
    return _pairs(J.similar_pairs(*A.document_rows(spark, sf_dir), DOC_THRESHOLD))


@query(f"with {SQL_SUPPLIER_BAGS}, {sql_pairs(SUPPLIER_THRESHOLD, 'l.family = r.family')} {_SELECT_PAIRS}")
def similar_same_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one region."""
    return _pairs(J.similar_pairs(*A.supplier_bags(spark, sf_dir), SUPPLIER_THRESHOLD, "same_family"))


@query(f"with {SQL_SUPPLIER_BAGS}, {sql_pairs(SUPPLIER_THRESHOLD, 'l.family <> r.family')} {_SELECT_PAIRS}")
def similar_cross_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of different regions."""
    return _pairs(J.similar_pairs(*A.supplier_bags(spark, sf_dir), SUPPLIER_THRESHOLD, "cross_family"))


LANGUAGE_PAIRS = (("NATION_21", "NATION_9"), ("NATION_11", "NATION_11"), ("NATION_4", "NATION_2"), ("NATION_0", "NATION_6"), ("NATION_9", "NATION_9"))
_IN_PAIRS = " or ".join(f"(least(l.language, r.language) = '{min(p)}' and greatest(l.language, r.language) = '{max(p)}')" for p in LANGUAGE_PAIRS)


@query(f"with {SQL_SUPPLIER_BAGS}, {sql_pairs(SUPPLIER_THRESHOLD, _IN_PAIRS)} {_SELECT_PAIRS}")
def similar_language_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of chosen pairs of nations."""
    return _pairs(J.similar_pairs(*A.supplier_bags(spark, sf_dir), SUPPLIER_THRESHOLD, "language_pairs", LANGUAGE_PAIRS))


@query(f"with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD, 'l.id % 7 = 0 or r.id % 7 = 0')} {_SELECT_PAIRS}")
def similar_focused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a focused document on one side or both."""
    fragments, rows = (x.withColumn("focused", F.col("fragment_id") % 7 == 0) for x in A.document_rows(spark, sf_dir))
    return _pairs(J.similar_pairs(fragments, rows, DOC_THRESHOLD, focused_only=True))


def _sql_count(bags: str, threshold: float, where: str, label: str) -> str:
    return f"select '{label}' as mode, (select count(*) from {bags} l join {bags} r on l.id < r.id and least(l.fc, r.fc)::double / greatest(l.fc, r.fc) >= {threshold} and ({where})) as candidate_pairs"


@query(f"with {SQL_SUPPLIER_BAGS} " + " union all ".join(
    _sql_count("frags", SUPPLIER_THRESHOLD, w, m) for m, w in (("all", "true"), ("same_family", "l.family = r.family"), ("cross_family", "l.family <> r.family"), ("language_pairs", _IN_PAIRS), ("focused", "l.id % 7 = 0 or r.id % 7 = 0"))
))
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact candidate counts of every mode, from sizes alone."""
    fragments, _ = A.supplier_bags(spark, sf_dir)
    counts = [J.candidate_pairs(fragments, SUPPLIER_THRESHOLD, m, LANGUAGE_PAIRS if m == "language_pairs" else ()).select(F.lit(m).alias("mode"), "candidate_pairs") for m in J.MODES]
    focused = J.candidate_pairs(fragments.withColumn("focused", F.col("fragment_id") % 7 == 0), SUPPLIER_THRESHOLD, focused_only=True)
    counts.append(focused.select(F.lit("focused").alias("mode"), "candidate_pairs"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# --- groups -----------------------------------------------------------------------------------------------------------
def _document_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(fragments, rows that hold their bags, profiles, similar profiles) of documents."""
    fragments, rows = A.document_rows(spark, sf_dir)
    profs = stored(J.profiles(fragments), "profiles")
    return fragments, rows, profs, stored(J.similar_profiles(fragments, rows, DOC_THRESHOLD, profs=profs), "similar")


@query(f"with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS} select group_id, score, min_fc::bigint as min_fc, location_pairs from groups")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: groups and their pair counts by arithmetic on profiles."""
    _, _, profs, similar = _document_profiles(spark, sf_dir)
    out = G.group_counts(similar, profs)
    return out.select("group_id", "score", F.col("min_fc").cast("long").alias("min_fc"), F.col("location_pairs").cast("long").alias("location_pairs"))


_KEYS = "printf('%s:%09d:%09d:%s:%s', path, start_line, end_line, language, name)"


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)},
ids as (select distinct least(afp, bfp) || ':' || greatest(afp, bfp) as group_id, unnest([a, b]) as id, unnest([afp, bfp]) as fingerprint from pairs),
places as (select distinct group_id, fingerprint, {_KEYS} as location_key from ids join frags using (id)),
ranked as (select *, row_number() over (partition by group_id, fingerprint order by location_key) as place, count(*) over (partition by group_id, fingerprint) as occurrence_count from places)
select group_id, fingerprint, location_key, place::int as place, occurrence_count from ranked where place <= 3""")
def group_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first places of each profile of each group, with exact counts."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    return G.occurrences(G.counted_members(similar, J.members(fragments, profs, "all")), fragments, 3)


_PLACES = f"""
keyed as (select id, path, name, {_KEYS} as k from frags),
places as (select distinct least(afp, bfp) || ':' || greatest(afp, bfp) as group_id, least(x.k, y.k) as left_key, greatest(x.k, y.k) as right_key,
  case when x.k <= y.k then x.path else y.path end as left_path, case when x.k <= y.k then y.path else x.path end as right_path,
  case when x.k <= y.k then x.name else y.name end as left_name, case when x.k <= y.k then y.name else x.name end as right_name
  from pairs join keyed x on x.id = a join keyed y on y.id = b)"""


@query(f"with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {_PLACES} select * from places")
def group_path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of places."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    return G.profile_path_pairs(similar, stored(J.members(fragments, profs, "all"), "members"))


_LITERALS = r"list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: true)"


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)},
lit as (select doc_id as id, [sha256('number' || chr(0) || x) for x in {_LITERALS}] as ds from documents),
both_ as (select least(afp, bfp) || ':' || greatest(afp, bfp) as group_id, x.ds as l, y.ds as r from pairs join lit x on x.id = a join lit y on y.id = b where len(x.ds) > 0 or len(y.ds) > 0),
diff as (select group_id, abs(len(l) - len(r)) as gap, len(list_filter(range(1, least(len(l), len(r)) + 1), lambda k: l[k] <> r[k])) + abs(len(l) - len(r)) as d from both_)
select group_id, count(*) as compared_pairs, count(*) filter (d > 0) as pairs_with_differences, max(d)::int as max_differing, count(*) filter (gap > 0) as count_mismatch_pairs from diff group by group_id""")
def group_literal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the numbers in similar documents differ."""
    from structsim.operators.features import literal_digests

    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    literals = literal_digests(A.read(spark, sf_dir, "documents"), "doc_id", "text", "[0-9]+")
    return G.profile_literal_evidence(similar, J.members(fragments, profs, "all"), literals)


RULES = (("src1/**", 25), ("**/de/*.txt", 3))
_REVIEW = f"""
flags as (select group_id,
  bool_or(left_path <> right_path and left_name = right_name and regexp_replace(left_path, '/[^/]*$', '') <> regexp_replace(right_path, '/[^/]*$', '')) as s1,
  bool_or(left_path <> right_path and regexp_replace(left_path, '/[^/]*$', '') <> regexp_replace(right_path, '/[^/]*$', '')) as s2,
  bool_or(left_path <> right_path and left_name = right_name) as s3, bool_or(left_path <> right_path) as s4,
  bool_or(left_path like 'src1/%' or right_path like 'src1/%') as r1,
  bool_or(regexp_matches(left_path, '/de/[^/]*[.]txt$') or regexp_matches(right_path, '/de/[^/]*[.]txt$')) as r2 from places group by group_id),
reviewed as (select g.*, 4 * s1::int + 2 * s2::int + 2 * s3::int + s4::int + (location_pairs > 1)::int + 25 * r1::int + 3 * r2::int as priority,
  list_filter([case when s1 then 'same-name-cross-directory' end, case when s2 then 'cross-directory' end, case when s3 then 'same-name-cross-file' end, case when s4 then 'cross-file' end,
   case when location_pairs > 1 then 'repeated-location-pairs' end, case when r1 then 'priority-path:src1/**(+25)' end, case when r2 then 'priority-path:**/de/*.txt(+3)' end], lambda x: x is not null) as signals
  from groups g join flags using (group_id))"""


def reviewed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    flags = G.profile_flags(similar, J.members(fragments, profs, "all"), RULES)
    return G.review_priority(G.group_counts(similar, profs), flags, RULES)


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS}, {_PLACES}, {_REVIEW}
select group_id, score, min_fc::bigint as min_fc, location_pairs, priority::int as priority, array_to_string(signals, ',') as signals from reviewed""")
def review_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review priority and signals of every group."""
    counts = [F.col(c).cast("long").alias(c) for c in ("min_fc", "location_pairs")]
    return reviewed_groups(spark, sf_dir).select("group_id", "score", *counts, "priority", F.array_join("signals", ",").alias("signals"))


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS}, {_PLACES}, {_REVIEW}
select group_id, priority::int as priority, score, row_number() over (order by priority desc, score desc, min_fc desc, location_pairs desc, group_id)::int as rank from reviewed order by rank limit 25""")
def top_review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first groups in review order."""
    return G.top_groups(reviewed_groups(spark, sf_dir), 25, "review").select("group_id", "priority", "score", "rank")


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS},
foc as (select group_id, count(distinct id) as focused_count from (select least(afp, bfp) || ':' || greatest(afp, bfp) as group_id, unnest([a, b]) as id from pairs) where id % 7 = 0 group by 1)
select group_id, coalesce(focused_count, 0) as focused_count, score, row_number() over (order by coalesce(focused_count, 0) > 0 desc, score desc, min_fc desc, location_pairs desc, group_id)::int as rank
from groups left join foc using (group_id) order by rank limit 40""")
def focused_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focused places per group, and groups with one come first."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    fragments = fragments.withColumn("focused", F.col("fragment_id") % 7 == 0)
    counts = G.focused_counts(G.counted_members(similar, J.members(fragments, profs, "all")), fragments)
    groups = G.group_counts(similar, profs).join(counts, "group_id", "left").na.fill({"focused_count": 0})
    return G.top_groups(groups, 40, focus_active=True).select("group_id", "focused_count", "score", "rank")


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS}
select (select count(*) from documents)::int as files, (select count(*) from frags) as fragments,
(select count(*) from frags l join frags r on l.id < r.id and least(l.fc, r.fc)::double / greatest(l.fc, r.fc) >= {DOC_THRESHOLD}) as candidate_pairs,
(select sum(location_pairs)::bigint from groups) as location_pairs, (select count(*) from groups) as total_groups, 0 as focused_groups, 0 as suppressed_pairs, 0 as suppressed_groups, (select count(*) > 100 from groups) as truncated""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals before any cut."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    groups = G.group_counts(similar, profs)
    out = G.report_totals(A.read(spark, sf_dir, "documents").count(), fragments, J.candidate_pairs(fragments, DOC_THRESHOLD), groups, 100)
    return out.withColumn("location_pairs", F.col("location_pairs").cast("long"))


# --- evidence ---------------------------------------------------------------------------------------------------------
def _aligned_profiles(similar: DataFrame, profs: DataFrame) -> DataFrame:
    """Pairs of similar profiles with the smaller fingerprint on the left; a profile's bag is that of its id's fragment."""
    side = lambda a: profs.select(F.col("profile_id").alias(f"{a}_id"), F.col("fingerprint").alias(f"{a}_print"))
    turn = F.col("l_print") > F.col("r_print")
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    both = similar.join(side("l"), "l_id").join(side("r"), "r_id")
    return both.select(F.concat_ws("-", "l_id", "r_id").alias("pair_id"), pick("l_id", "r_id").alias("left_id"), pick("r_id", "l_id").alias("right_id"))


@query(f"""with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)},
ps as (select a || '-' || b as pair_id, case when afp > bfp then b else a end as l, case when afp > bfp then a else b end as r from pairs),
al as (select pair_id, feature, sum(lc) as lc, sum(rc) as rc from (select pair_id, feature, cnt as lc, 0 as rc from ps join bags on id = l union all select pair_id, feature, 0, cnt from ps join bags on id = r) group by all),
k as (select pair_id, feature, 'shared' as k, least(lc, rc) as v from al union all select pair_id, feature, 'left_only', lc - least(lc, rc) from al union all select pair_id, feature, 'right_only', rc - least(lc, rc) from al),
t as (select *, row_number() over (partition by pair_id, k order by v desc, feature) as n from k where v > 0),
s as (select pair_id, coalesce(string_agg(feature || '=' || v, ';' order by n) filter (k = 'shared'), '') as shared,
  coalesce(string_agg(feature || '=' || v, ';' order by n) filter (k = 'left_only'), '') as left_only, coalesce(string_agg(feature || '=' || v, ';' order by n) filter (k = 'right_only'), '') as right_only from t where n <= 8 group by pair_id),
tot as (select pair_id, sum(least(lc, rc))::bigint as intersection, sum(greatest(lc, rc))::bigint as union_size, sum(lc - least(lc, rc))::bigint as left_total, sum(rc - least(lc, rc))::bigint as right_total from al group by pair_id)
select pair_id, intersection, union_size, left_total, right_total, shared, left_only, right_only from tot join s using (pair_id)""")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared and one-sided features of every similar pair, worked out once per pair of profiles."""
    fragments, rows, profs, similar = _document_profiles(spark, sf_dir)
    out = stored(X.structural_evidence(_aligned_profiles(similar, profs), rows), "evidence").withColumnRenamed("pair_id", "profiles")
    for c in ("shared", "left_only", "right_only"):
        out = out.withColumn(c, F.array_join(c, ";"))
    pairs = J.listed_pairs(fragments, profs, similar).select(F.concat_ws("-", "left_id", "right_id").alias("pair_id"), F.concat_ws("-", "l_id", "r_id").alias("profiles"))
    return pairs.join(out, "profiles").select("pair_id", "intersection", "union_size", "left_total", "right_total", "shared", "left_only", "right_only")
