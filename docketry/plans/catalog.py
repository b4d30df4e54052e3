"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

from . import fit_queries, policy_queries, policy_sql, review_queries, text_queries, text_sql

_PARTS = ((policy_queries.QUERIES, policy_sql.ORACLES), (text_queries.QUERIES, text_sql.ORACLES), (fit_queries.QUERIES, fit_queries.ORACLES), (review_queries.QUERIES, review_queries.ORACLES))


def flagship(spark, sf_dir):
    return queries()["full_pipeline"](spark, sf_dir)


def queries() -> dict:
    return {k: v for own, _ in _PARTS for k, v in own.items()}


def oracle_sql() -> dict:
    return {k: v for _, own in _PARTS for k, v in own.items()}
