"""All queries of the core and their SQL."""

from __future__ import annotations

from gridloom.plans import network_queries, operations, problems, reference  # noqa: F401  (operations adds its queries to those of reference)


def core_queries() -> dict:
    return reference.QUERIES | problems.QUERIES | network_queries.QUERIES


def core_sql() -> dict[str, str]:
    return reference.SQL | problems.SQL | network_queries.SQL
