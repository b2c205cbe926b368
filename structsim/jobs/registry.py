"""All registered queries of the similarity operators."""

from structsim.jobs import review_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from structsim.jobs.queries import ORACLE_SQL, QUERIES, top_review_groups

__all__ = ["ORACLE_SQL", "QUERIES", "top_review_groups"]
