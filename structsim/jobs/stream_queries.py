"""Registered query of the corpus log, which a stream of changed files keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structsim.jobs.queries import _SPLIT, DOC_THRESHOLD, query, sql_pairs
from structsim.sources import adapters as A
from structsim.sources.storage import fresh_folder
from structsim.streaming.incremental import CorpusLog


@query(f"""with state as materialized (select 'doc_' || doc_id as path, case when doc_id % 4 = 2 then 3 when doc_id % 3 = 0 then 1 else 0 end::bigint as version,
  case when doc_id % 4 = 2 then 'moved ' || coalesce(text, '') when doc_id % 3 = 0 then coalesce(text, '') || ' changed again' else coalesce(text, '') end as text
  from documents where doc_id % 4 = 2 or doc_id % 5 <> 1),
bags as materialized (select path as id, 'word:' || w as feature, count(*)::int as cnt from (select path, unnest({_SPLIT.format('lower(text)')}) as w from state) where w <> '' group by all),
prints as (select id, sum(cnt) as fc, substr(sha256(string_agg(feature || chr(31) || cnt || chr(30), '' order by feature)), 1, 16) as fp from bags group by id),
frags as materialized (select id, path, '' as name, version, fc, fp from prints join state on id = path),
{sql_pairs(DOC_THRESHOLD)}
select a as left_path, x.version as left_version, b as right_path, y.version as right_version, score from pairs join state x on x.path = a join state y on y.path = b""")
def corpus_log_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents after batches of changes, deletions, versions that come late and moved files."""
    docs = A.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))

    def change(which: str, version: int, text, deleted: bool = False) -> DataFrame:
        return docs.where(which).select("path", F.lit(version).cast("long").alias("version"), text.alias("text"), F.lit(deleted).alias("deleted"))

    log = CorpusLog(spark, fresh_folder(spark, "corpus-log"), DOC_THRESHOLD, every=2)
    log.build(docs.select("path", "text"))
    log.apply(change("doc_id % 3 = 0", 1, F.concat("text", F.lit(" changed again"))), 0)
    late = change("doc_id % 3 = 0", 0, F.lit("too late"))
    log.apply(change("doc_id % 5 = 1", 2, F.lit(None).cast("string"), True).unionByName(late), 1)
    log.apply(change("doc_id % 4 = 2", 3, F.concat(F.lit("moved "), "text")), 2)
    return log.current_findings(2)
