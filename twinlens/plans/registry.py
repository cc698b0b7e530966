"""The catalogue of runnable queries: name, Spark job, inventory rows, second-engine SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinlens.plans.derive import BASE, Tables, with_tables


@dataclass(frozen=True)
class Query:
    name: str
    rows: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """One set of table handles per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def query(name: str, rows: str, sql: str | None = None, needs: str = ""):
    """Register a Spark job under a name; `needs` lists the derivations its SQL reads."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, rows, fn, _with(needs.split(), sql) if sql else None)
        return fn

    return add


def _with(needs: list[str], sql: str) -> str:
    from twinlens.plans.second_engine import SPECIAL

    ctes: list[tuple[str, str]] = []
    for need in needs:
        for name, text in with_tables(need, SPECIAL):
            if name not in [n for n, _ in ctes] and name not in BASE:
                ctes.append((name, text))
    if not ctes:
        return sql
    head = ", ".join(f"{n} AS ({t})" for n, t in ctes)
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
