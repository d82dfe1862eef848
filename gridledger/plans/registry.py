"""The catalogue of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridledger.plans.register import Register, with_register_sql

Plan = Callable[..., DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query. ``sql`` may name register tables; they are prepended as CTEs."""

    def add(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = sql
        return plan

    return add


def _runner(plan: Plan) -> Callable[..., DataFrame]:
    def run(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
        """Run on an input folder; ``filters`` override the plan's own keyword defaults."""
        return plan(Register(spark, sf_dir), **filters)

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(plan) for name, plan in _PLANS.items()}


def all_sql() -> dict[str, str]:
    return {name: with_register_sql(sql) for name, sql in _SQL.items()}
