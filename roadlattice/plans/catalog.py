"""All queries over the road operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import costs, extras, files, generation, graphs, guidance, layers, portfolio, projection, recombine, reports, requests, routes, spatial, verdicts, ways  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
