"""Registered queries of the reviewed baseline, change focus and labelled evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structsim.jobs.queries import DOC_THRESHOLD, SQL_DOC_BAGS, SQL_GROUPS, _document_profiles, _PLACES, query, sql_pairs
from structsim.functions.names import pair_id
from structsim.operators import baseline as B
from structsim.operators import evaluate as E
from structsim.operators import explain as X
from structsim.operators import focus as C
from structsim.operators import groups as G
from structsim.operators import report as R
from structsim.operators import simjoin as J
from structsim.sources import adapters as A
from structsim.sources.storage import stored

_CURRENT = f"with {SQL_DOC_BAGS}, {sql_pairs(DOC_THRESHOLD)}, {SQL_GROUPS}, {_PLACES}"
_ENTRIES = """,
pe as (select group_id as id, score as similarity, arg_max(left_path, left_key || chr(1) || right_key) as left_path, arg_max(left_key, left_key || chr(1) || right_key) as left_key,
 arg_max(right_path, left_key || chr(1) || right_key) as right_path, arg_max(right_key, left_key || chr(1) || right_key) as right_key from places join groups using (group_id)
 group by group_id, score, least(left_path, right_path), greatest(left_path, right_path)),
ce as (select group_id as id, score as similarity, arg_min(left_path, left_key || chr(1) || right_key) as left_path, arg_min(left_key, left_key || chr(1) || right_key) as left_key,
 arg_min(right_path, left_key || chr(1) || right_key) as right_path, arg_min(right_key, left_key || chr(1) || right_key) as right_key from places join groups using (group_id) group by group_id, score),
old as (select id, left_path, right_path, 'intentional' as classification, 'seen' as note from ce where substr(id, 1, 1) < '8' union all select 'gone:' || substr(id, 1, 4), left_path, right_path, 'other', '' from ce where substr(id, 1, 1) = '0')"""


def _profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(similar profiles, profiles, members) of documents."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    return similar, profs, stored(J.members(fragments, profs, "all"), "members")


def _current(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    """Entries of the current groups."""
    return stored(B.entries_from_profiles(*_profiles(spark, sf_dir), scope), "entries")


def _reviewed(current: DataFrame) -> DataFrame:
    """A reviewed baseline: half of the current entries, and some that are gone."""
    half = current.where(F.substring("id", 1, 1) < "8").withColumn("classification", F.lit("intentional")).withColumn("note", F.lit("seen"))
    gone = current.where(F.substring("id", 1, 1) == "0").withColumn("id", F.concat(F.lit("gone:"), F.substring("id", 1, 4))).withColumn("classification", F.lit("other"))
    return half.unionByName(gone)


@query(f"{_CURRENT}{_ENTRIES} select id, similarity, left_path, left_key, right_path, right_key from pe")
def baseline_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: path-scoped entries of the current groups."""
    return _current(spark, sf_dir, "path").drop("classification", "note")


@query(f"{_CURRENT}{_ENTRIES} select ce.id, similarity, ce.left_path, ce.left_key, ce.right_path, ce.right_key, coalesce(classification, '') as classification, coalesce(note, '') as note from ce left join old using (id)")
def baseline_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2: content-scoped entries with the metadata of earlier ones."""
    current = _current(spark, sf_dir, "content")
    return B.replaced(current, _reviewed(current), "content")


@query(f"{_CURRENT}{_ENTRIES} select 'kept' as what, old.id from old join ce using (id) union all select 'stale', old.id from old anti join ce using (id)")
def baseline_kept_and_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are still there, and those that are not."""
    current = _current(spark, sf_dir, "content")
    old = _reviewed(current)
    kept = B.pruned(old, current, "content").select(F.lit("kept").alias("what"), "id")
    return kept.unionByName(B.stale(old, current, "content").select(F.lit("stale").alias("what"), "id"))


@query(f"{_CURRENT}{_ENTRIES} select (select count(*) from ce) as candidates, (select count(*) from ce anti join old using (id)) as new, (select count(*) from ce semi join old using (id)) as retained, (select count(distinct id) from old anti join ce using (id)) as removed")
def baseline_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing the baseline would do."""
    current = _current(spark, sf_dir, "content")
    return B.replacement_preview(_reviewed(current), current, "content")


@query(f"{_CURRENT}{_ENTRIES}, gone as (select group_id from places semi join old on id = group_id) select (select count(*) from gone) as suppressed_pairs, (select count(distinct group_id) from gone) as suppressed_groups, (select count(*) from places) - (select count(*) from gone) as left_pairs")
def baseline_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the baseline accepts, and the rest."""
    found = _profiles(spark, sf_dir)
    current = stored(B.entries_from_profiles(*found, "content"), "entries")
    return B.suppressed_counts(*found, _reviewed(current), "content")


_SPANS = "select 'u' || user_id as path, (floor(epoch(ts))::bigint // 3600 % 5000 + 1)::int as start_line, (floor(epoch(ts))::bigint // 3600 % 5000 + 1 + floor(abs(value))::int % 7 - 1)::int as end_line from events where user_id is not null"


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.read(spark, sf_dir, "events").where("user_id is not null")
    start = (F.expr("unix_timestamp(ts) div 3600 % 5000") + 1).cast("int")
    long = F.floor(F.abs("value")).cast("int") % 7 - 1
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), start.alias("start_line"), (start + long).alias("end_line"))


_MERGED = f"""spans as ({_SPANS}), good as (select distinct * from spans where start_line >= 1 and end_line >= start_line),
flagged as (select *, case when max(end_line) over w is null or start_line > max(end_line) over w + 1 then 1 else 0 end as fresh from good
  window w as (partition by path order by start_line, end_line rows between unbounded preceding and 1 preceding)),
isl as (select *, sum(fresh) over (partition by path order by start_line, end_line rows unbounded preceding) as island from flagged),
merged as (select path, min(start_line) as start_line, max(end_line) as end_line from isl group by path, island)"""


@query(f"with {_MERGED} select * from merged")
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of activity per user, joined where they touch."""
    return C.merge_intervals(_event_spans(spark, sf_dir))


@query(f"""with {_MERGED}, f as (select event_id as fragment_id, 'u' || user_id as path, (floor(epoch(ts))::bigint // 3600 % 5000 + 3)::int as start_line, (floor(epoch(ts))::bigint // 3600 % 5000 + 4)::int as end_line from events where event_type = 'click')
select fragment_id, path, (path in ('u1', 'u2', 'u3') or exists (select 1 from merged m where m.path = f.path and m.path like '%7' and m.start_line <= f.end_line and m.end_line >= f.start_line)) as focused from f""")
def focused_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks focused by user or by the user's active hours."""
    start = F.expr("unix_timestamp(ts) div 3600 % 5000").cast("int")
    clicks = A.read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("fragment_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), (start + 3).alias("start_line"), (start + 4).alias("end_line"))
    paths = clicks.where(F.col("path").isin("u1", "u2", "u3")).select("path")
    spans = _event_spans(spark, sf_dir).where(F.col("path").endswith("7"))
    return C.mark_focused(clicks, paths, spans).select("fragment_id", "path", "focused")


@query("""with req as (select source || '/' || lang || '/doc_' || (doc_id + 40) || '.txt' as path, doc_id % 11 = 0 as deleted from documents),
files as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, length(text) as n from documents),
r as (select path, bool_or(deleted) as deleted from req group by path),
s as (select r.path, case when deleted then 'deleted' when n <= 4000 then 'analyzed' when n > 4000 then 'skipped_resource' when path like 'src1%' then 'unsupported' else 'not_discovered' end as status from r left join files using (path))
select path, status, case when status = 'skipped_resource' then 'resource_limit' end as reason, status not in ('deleted', 'unsupported') as required, status = 'analyzed' as covered from s""")
def focus_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of requested paths."""
    docs = A.read(spark, sf_dir, "documents")
    asked = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), (F.col("doc_id") + 40).cast("string"), F.lit(".txt"))).alias("path"), (F.col("doc_id") % 11 == 0).alias("deleted"))
    files = docs.select(A.document_path().alias("path"), F.length("text").alias("n"))
    left_out = files.where("n > 4000").select("path", F.lit("skipped_resource").alias("status"), F.lit("resource_limit").alias("reason"))
    return C.focus_evidence(asked, files.where("n <= 4000"), left_out, ~F.col("path").startswith("src1"))


@query("select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, case when lang = 'fr' and source in ('src1', 'src2') then source || '/fr' else source end as root from documents")
def assigned_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file under its deepest root."""
    docs = A.read(spark, sf_dir, "documents")
    deep = docs.where("lang = 'fr' and source in ('src1', 'src2')").select(F.concat_ws("/", "source", "lang").alias("root"))
    roots = docs.select(F.col("source").alias("root")).unionByName(deep).distinct()
    return C.assign_roots(docs.select(A.document_path().alias("path")), roots).select("path", "root")


_RESULTS = """res as (select l.doc_id::varchar as id, source as evaluation, case when toxic = 1 then 'false-positive' when quality = 1 then 'accepted-positive' else 'intentional-similarity' end as classification,
 (l.doc_id * 37 % 101)::double / 128 as score, 0.25::double as min_score, 0.75::double as max_score, (l.doc_id % 9 + 1)::int as rank, case when l.doc_id % 4 > 0 then (l.doc_id % 64)::double / 64 end as reference_score, case when l.doc_id % 4 > 0 then (l.doc_id % 7)::int end as reference_rank
 from labels l join documents d on d.doc_id = l.doc_id)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = A.read(spark, sf_dir, "labels"), A.read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("evaluation"))
    known = F.col("doc_id") % 4 > 0
    kind = F.when(F.col("toxic") == 1, "false-positive").when(F.col("quality") == 1, "accepted-positive").otherwise("intentional-similarity")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "evaluation", kind.alias("classification"), ((F.col("doc_id") * 37 % 101).cast("double") / 128).alias("score"), F.lit(0.25).alias("min_score"), F.lit(0.75).alias("max_score"),
        (F.col("doc_id") % 9 + 1).cast("int").alias("rank"), F.when(known, (F.col("doc_id") % 64).cast("double") / 64).alias("reference_score"), F.when(known, (F.col("doc_id") % 7).cast("int")).alias("reference_rank"),
    )


@query(f"""with {_RESULTS}, r as (select *, row_number() over (partition by evaluation order by score desc, id)::int as actual_rank from res)
select id, evaluation, actual_rank, not (score between min_score and max_score) as score_violation, actual_rank <> rank as rank_violation, score - reference_score as score_movement, (reference_rank - actual_rank)::double as rank_movement from r""")
def evaluation_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, violations and movement of labelled results, an evaluation per source."""
    return E.ranked(_results(spark, sf_dir), ["evaluation"]).select("id", "evaluation", "actual_rank", "score_violation", "rank_violation", "score_movement", F.col("rank_movement").cast("double").alias("rank_movement"))


@query(f"""with {_RESULTS}, r as (select *, row_number() over w as k, sum((classification <> 'false-positive')::int) over (w rows unbounded preceding) as hits from res window w as (partition by evaluation order by score desc, id))
select evaluation, k::int as k, hits::double / k as precision from r where k in (1, 3, 5, 10)""")
def evaluation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at 1, 3, 5 and 10."""
    return E.precision_at(_results(spark, sf_dir), by=["evaluation"])


@query(f"with {_RESULTS} select classification, count(*) as n, min(score) as min_score, max(score) as max_score, avg(score) as mean_score from res group by classification")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per class."""
    return E.class_scores(_results(spark, sf_dir))


@query(f"""with {_RESULTS} select count(*) as cases, count(*) filter (classification <> 'false-positive') as relevant, count(*) filter (classification = 'accepted-positive') as actionable,
count(*) filter (classification = 'false-positive') as false_positives, (count(*) filter (classification = 'accepted-positive'))::double / count(*) as actionability from res""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and actionability."""
    return E.metrics(_results(spark, sf_dir))


@query(f"""{_CURRENT}, top as (select path from (select left_path as path from places union all select right_path from places) group by path order by count(*) desc, path limit 1),
sides as (select distinct group_id, left_key as k, left_path as path from places union select distinct group_id, right_key, right_path from places),
here as (select group_id, k from sides semi join top using (path))
select h.group_id, h.k as location_key, coalesce((select string_agg(s.k, ',' order by s.k) from sides s where s.group_id = h.group_id and s.k <> h.k), '') as related from here h""")
def path_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path has in common with others, for the path with the most places."""
    similar, profs, members = _profiles(spark, sf_dir)
    places = stored(G.partner_counts(similar, members), "places")
    counts = places.groupBy("path").agg(F.sum(F.col("others") + F.col("own")).alias("n")).where("n > 0")
    path = counts.orderBy(F.col("n").desc(), "path").first()["path"]
    here = places.where(F.col("path") == path).select("profile_id").distinct()
    near = similar.join(here.toDF("l_id"), "l_id", "left_semi").unionByName(similar.join(here.toDF("r_id"), "r_id", "left_semi")).select("l_id", "r_id").distinct()
    prints = profs.select("profile_id", "fingerprint")
    near = near.join(prints.toDF("l_id", "lf"), "l_id").join(prints.toDF("r_id", "rf"), "r_id").withColumn("group_id", pair_id("lf", "rf"))
    sides = near.select("group_id", (F.col("l_id") == F.col("r_id")).alias("itself"), F.explode(F.array_distinct(F.array("l_id", "r_id"))).alias("profile_id"))
    both = sides.join(places, "profile_id").where("not itself or own > 0").select("group_id", "location_key", "path")
    return X.findings_for_path(both.distinct(), path).select("group_id", "location_key", F.array_join("related", ",").alias("related"))


@query(f"""{_CURRENT}, r as (select group_id, score, location_pairs, row_number() over (order by score desc, min_fc desc, location_pairs desc, group_id) as rank from groups),
sides as (select distinct group_id, left_key as k from places union select distinct group_id, right_key from places),
n as (select *, row_number() over (partition by group_id order by k) as nth from sides)
select rank::int as rank, printf('%d. %.2f%% %s %d pairs: %s', rank, score * 100, substr(group_id, 1, 12), location_pairs, string_agg(k, ', ' order by nth) filter (nth <= 3)) as line
from r join n using (group_id) where rank <= 100 group by rank, score, group_id, location_pairs""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report of at most 100 groups."""
    fragments, _, profs, similar = _document_profiles(spark, sf_dir)
    ranked = stored(G.top_groups(G.group_counts(similar, profs), 100), "ranked")
    members = J.members(fragments, profs, "all")
    # Only places of the groups that are told are listed.
    told = G.pairs_of_groups(similar, profs, ranked)
    return R.report_lines(ranked, G.occurrences(G.counted_members(told, members), fragments))
