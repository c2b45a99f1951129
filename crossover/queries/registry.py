"""Registry of queries: each has a Spark form and, where SQL can say it, a twin for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossover.queries.fixtures import FIXTURES, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Frames:
    """Driver tables and the projections of them that stand in for catalogs, logs and damaged copies."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                needs, sql = FIXTURES[name]
                self._made[name] = self.spark.sql(sql, **{n: self[n] for n in needs})
        return self._made[name]

    def dealt(self, **keys: str) -> Frames:
        """The frames over tables dealt by a column each. A window by that column needs no exchange of its own then, in which the texts
        made before it would move as well."""
        out = Frames(self.spark, self.folder)
        out._made = {table: self[table].repartition(key) for table, key in keys.items()}
        return out


def _with_fixtures(names: tuple[str, ...], sql: str) -> str:
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in ctes:
            return
        needs, body = FIXTURES[name]
        for n in needs:
            add(n)
        ctes[name] = f"{name} AS ({body.format(**{n: n for n in needs})})"

    for name in names:
        add(name)
    sql = sql.strip()
    if not ctes:
        return sql
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes.values()) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes.values()) + "\n" + sql


def query(name: str, *fixtures: str, sql: str | None = None):
    """Register ``fn(frames)`` under ``name``; ``sql`` may use the driver tables and the named fixtures."""

    def wrap(fn: Callable[[Frames], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Frames(spark, folder))
        if sql is not None:
            ORACLES[name] = _with_fixtures(fixtures, sql)
        return fn

    return wrap
