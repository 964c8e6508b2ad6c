"""All registered queries of the engine and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["graph_queries", "rule_queries", "path_queries", "score_queries", "temporal_queries", "model_queries", "analysis_queries"]


def _gathered(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(import_module(f"graphloom.plans.{m}"), name))
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE")
