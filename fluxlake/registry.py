"""Query registry: a name, a function of (spark, sf_dir) and, where SQL can express it, a DuckDB query for the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that register queries when imported.
MODULES: list[str] = ["operators.statistics", "operators.timeseries", "operators.spectra", "operators.splits", "operators.spectral", "operators.metrics", "operators.leaderboard", "operators.gates", "plans.relational", "functions.scalar", "functions.schedules", "sources.stores", "streaming.monitors", "operators.dynamics", "operators.subgrid", "operators.acceptance", "operators.separable", "sources.chunks", "operators.standard", "operators.constraints", "operators.tiles", "sources.sidecars", "streaming.resumed", "operators.reviews"]

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator: registers a query under a name, with its oracle."""

    def register(f):
        if name in _QUERIES and _QUERIES[name].__module__ + _QUERIES[name].__qualname__ != f.__module__ + f.__qualname__:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"fluxlake.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
