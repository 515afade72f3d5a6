"""All queries of the document-unit operators, and their SQL."""

from __future__ import annotations

import functools
import importlib

from quire.session import ship

_PARTS = ("source_queries", "window_queries", "join_queries", "function_queries", "state_queries", "paper_queries", "text_queries", "rule_queries", "match_queries", "evidence_queries")


def _parts():
    return [importlib.import_module(f"quire.plans.{p}") for p in _PARTS]


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {k: _shipped(f) for p in _parts() for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _parts() for k, s in p.SQL.items()}
