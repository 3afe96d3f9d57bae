"""Named queries over the library's operators, with the SQL that gives the same rows."""

from quillon.plans import actor_queries, detail_queries, function_queries, graph_queries, library_queries, link_queries, matching_queries, overview_queries, record_queries, relational_queries, scope_queries, store_queries  # noqa: F401
from quillon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
