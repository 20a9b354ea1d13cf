"""All registered queries of the library, by name, and their oracle SQL."""

from __future__ import annotations

from folioworks.plans import index_queries, telemetry_queries, text_queries

_MODULES = (telemetry_queries, text_queries, index_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "hybrid_retrieve"
