"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from medspan.plans import measures, row_queries


def flagship(spark, sf_dir):
    """Patients with an encounter during which a medication was dated."""
    return measures.queries()["measure_with_during"](spark, sf_dir)


def queries() -> dict:
    return measures.queries() | row_queries.queries()


def oracle_sql() -> dict:
    return measures.oracle_sql() | row_queries.oracle_sql()
