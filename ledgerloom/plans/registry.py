"""All queries of the core and their SQL."""

from __future__ import annotations

from . import claim_queries, export_queries, fact_queries, identity_queries, privacy_queries, store_queries, training

_MODULES = (training, fact_queries, claim_queries, store_queries, export_queries, privacy_queries, identity_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
