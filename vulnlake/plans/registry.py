"""Registry of named queries: each entry pairs a Spark builder
``(spark, sf_dir) -> DataFrame`` with the DuckDB SQL that must return the
same rows (or ``None`` where SQL cannot express the operator)."""

from __future__ import annotations

from collections.abc import Callable

_ENTRIES: dict[str, tuple[Callable, Callable[[], str] | str | None]] = {}


def register(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = (fn, sql)
        return fn
    return deco


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    out = {}
    for k, (_, sql) in _ENTRIES.items():
        if sql is None:
            continue
        out[k] = sql() if callable(sql) else sql
    return out


def _load_all():
    # importing the modules registers their queries
    from vulnlake.plans import registered  # noqa: F401
