"""All queries of the library's own operators by name, with their SQL."""

from .plans import alignment_queries, audit_queries, continuity_queries, greedy_queries, interval_queries, source_queries, stream_queries, telemetry_queries, text_queries

_PARTS = (telemetry_queries, interval_queries, continuity_queries, text_queries, audit_queries, greedy_queries, alignment_queries, stream_queries, source_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
