"""Registered queries: a DataFrame builder and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from assayframe.plans import (  # noqa: F401
        q_composition,
        q_dedup,
        q_features,
        q_matching,
        q_metrics,
        q_sources,
        q_splits,
    )
