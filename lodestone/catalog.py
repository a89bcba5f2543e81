"""Every query of the library with the SQL it is held against."""

from __future__ import annotations

from lodestone.plans import enrich_queries, index_queries, parse_queries, retrieve_queries, rule_queries, search_queries, service_queries, store_queries  # noqa: F401  (they register their queries)
from lodestone.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "retrieve_e2e"
