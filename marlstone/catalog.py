"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from marlstone.plans import gold_queries, learning_queries, model_queries, place_queries, source_queries
from marlstone.session import ship

MODULES = (gold_queries, source_queries, model_queries, place_queries, learning_queries)


def shipped(query):
    """The query, with this package sent to the executors first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
