"""All queries of the library over the driver tables, and their SQL."""

from __future__ import annotations

from . import card_queries, evidence_queries, flow_queries, graph_queries, naming_queries, package_queries, phrase_queries, region_queries, sheet_queries, stream_queries, text_queries

_MODULES = (card_queries, evidence_queries, graph_queries, naming_queries, phrase_queries, region_queries, sheet_queries, stream_queries, text_queries, flow_queries, package_queries)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
