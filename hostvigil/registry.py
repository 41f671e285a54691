"""Named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostvigil.sources.fixtures import FIXTURES, fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(sql: str, names: tuple[str, ...] | list[str]) -> str:
    """DuckDB SQL with fixture views in front."""
    views = [f"{n} AS ({FIXTURES[n]})" for n in names]
    return f"WITH {', '.join(views)} {sql}" if views else sql


def query(oracle: str | None = None, fixtures: str = "", name: str | None = None):
    """Register a query(spark, sf_dir); `oracle` is DuckDB SQL over the tables and the named fixtures."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = with_fixtures(oracle, fixtures.split())
        return f

    return add


def sql_query(name: str, sql: str, fixtures: str = "", tables: str = "", duck: dict[str, str] | None = None) -> None:
    """Register a query whose Spark SQL and oracle share their text, but for the replacements in `duck`."""
    names = fixtures.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: fixture(spark, sf_dir, n) for n in names} | {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
        text = sql.replace("{", "{{").replace("}", "}}")
        for n in frames:
            text = text.replace(f"<{n}>", f"{{{n}}}")
        return spark.sql(text, **frames)

    text = sql
    for a, b in (duck or {}).items():
        text = text.replace(a, b)
    for n in [*names, *tables.split()]:
        text = text.replace(f"<{n}>", n)
    QUERIES[name] = run
    ORACLES[name] = with_fixtures(text, names)
