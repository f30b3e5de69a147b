"""All core queries and their SQL, collected from the modules beside this one."""

from __future__ import annotations

from textloom.plans import choice_queries, feature_queries, index_queries, linking_queries, metric_queries, more_queries, nested_queries, reader_queries, sequence_queries, session_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _r in (text_queries.R, index_queries.R, linking_queries.R, vector_queries.R, metric_queries.R, feature_queries.R, session_queries.R, sequence_queries.R, more_queries.R, reader_queries.R, choice_queries.R):
    QUERIES.update(_r.queries)
    ORACLE.update(_r.oracle)
for _m in (nested_queries,):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
FLAGSHIP = "tk01_bm25_top10"
