"""Registered queries over the mapped tables, with their DuckDB oracles."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name, oracle=None):
    """Decorator: registers fn(spark, sf_dir) -> DataFrame under name, with its oracle SQL."""

    def add(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
