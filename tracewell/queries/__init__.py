"""Registered queries: each reads the tables of a folder and may carry its SQL twin."""

from __future__ import annotations

import importlib

from tracewell.queries.registry import all_queries, all_sql

MODULES: tuple[str, ...] = ("sessions", "reports", "benchmark", "screens", "corpus", "knowledge", "synth", "live")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracewell.queries.{name}")


__all__ = ["all_queries", "all_sql", "load"]
