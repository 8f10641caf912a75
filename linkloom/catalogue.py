"""All queries of the link graph by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from .plans import queries as plans, sql


def queries():
    return plans.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
