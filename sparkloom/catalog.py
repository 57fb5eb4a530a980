"""Named queries: name -> (callable, oracle SQL)."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under name, with the DuckDB SQL that must give the same rows."""

    def put(fn):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = fn
        if sql:
            _ORACLES[name] = sql
        return fn

    return put


def _load() -> None:
    import importlib

    for module in ("relational", "search", "evidence", "memory", "graphs", "operations", "lifecycle", "structure", "citations"):
        importlib.import_module(f"sparkloom.plans.{module}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
