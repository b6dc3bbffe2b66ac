"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from quern import registry
from quern.queries import answers, catalog, graph, records, retrieval, texts, lookups, fields, kg, claims, evidence, chunking, answer_plan, evaluation  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
