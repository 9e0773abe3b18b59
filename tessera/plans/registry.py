"""All queries of the library with their DuckDB SQL."""

from __future__ import annotations

from tessera.plans import format_plans, sizing_plans, store_plans, stream_plans

_ALL = store_plans.QUERIES | sizing_plans.QUERIES | format_plans.QUERIES | stream_plans.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
