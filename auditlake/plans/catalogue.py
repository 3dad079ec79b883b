"""All queries of the engine's core, from the modules that hold them."""

from __future__ import annotations

from auditlake.plans import finding_queries, planted_cases, skew_queries, source_queries

MODULES = (finding_queries, skew_queries, source_queries, planted_cases)
FLAGSHIP = "pattern_rules"


def queries():
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
