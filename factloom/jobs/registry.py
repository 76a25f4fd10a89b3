"""The registered queries of the fact operators and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar_queries", "usage_queries", "instance_queries", "log_queries", "graph_queries", "report_queries", "stream_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"factloom.jobs.{m}"), name)
    return out


def queries() -> dict:
    return _all("Q")


def oracle_sql() -> dict:
    return _all("O")
