"""Registry of the library's own queries and their SQL."""

from __future__ import annotations

from leafmill.plans import queries_extract, queries_flows, queries_more, queries_tables, queries_text, registry  # noqa: F401


def flagship(spark, sf_dir):
    return queries_tables.nav_links(spark, sf_dir)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
