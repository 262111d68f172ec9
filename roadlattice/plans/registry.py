"""Registration of queries beside their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from roadlattice.sources.adapters import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name; sql may name the adapter views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
