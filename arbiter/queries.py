"""The registered queries of the reference's own operators, and the SQL that checks them."""

from __future__ import annotations

from arbiter.plans import evaluation_queries, graph_queries, relevance_queries, system_queries, text_queries

_ALL = {**relevance_queries.QUERIES, **graph_queries.QUERIES, **text_queries.QUERIES, **evaluation_queries.QUERIES, **system_queries.QUERIES}
QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}
