"""Catalog snapshots of many databases."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossover.sources.schemas import CATALOG

# What to ask a source for, by kind; the schema filter is part of the question.
MYSQL_CATALOG_SQL = {
    "tables": "SELECT table_schema AS schema_name, table_name, table_type, engine, table_rows, data_length, index_length, auto_increment, table_collation FROM information_schema.tables",
    "columns": "SELECT table_schema AS schema_name, table_name, column_name, ordinal_position, data_type, is_nullable, column_default, character_set_name, collation_name FROM information_schema.columns",
    "modules": "SELECT routine_schema AS schema_name, routine_name AS name, 'routine' AS kind, routine_type, routine_definition AS definition FROM information_schema.routines",
}


def snapshot_sources(spark: SparkSession, sources: dict[str, dict[str, str]], kind: str, path: str, sql: str | None = None, concurrency: int = 16) -> dict[str, str]:
    """Ask every source for one catalog and keep the answers as Parquet, one folder per source.

    ``sources`` maps a source id to its JDBC options. Sources that refuse are returned with their error and leave no folder; the
    others go on. Reading the folders back is one scan, where a union of thousands of queries would be a huge plan.
    """
    def one(item: tuple[str, dict[str, str]]) -> tuple[str, str] | None:
        source_id, options = item
        try:
            spark.read.format("jdbc").options(**options).option("query", sql or MYSQL_CATALOG_SQL[kind]).load().write.mode("overwrite").parquet(f"{path}/{kind}/source_id={source_id}")
        except Exception as e:  # a source may deny any of the reads
            return source_id, str(e)
        return None

    with ThreadPoolExecutor(concurrency) as pool:
        return dict(s for s in pool.map(one, sources.items()) if s)


def write_snapshot(df: DataFrame, path: str, kind: str) -> None:
    df.write.mode("overwrite").partitionBy("source_id").parquet(f"{path}/{kind}")


def read_catalog(spark: SparkSession, path: str, kind: str, sources: list[str] | None = None) -> DataFrame:
    """Snapshots of one kind with a fixed schema; naming sources prunes their folders."""
    df = spark.read.schema(CATALOG[kind]).parquet(f"{path}/{kind}")
    return df if sources is None else df.where(F.col("source_id").isin(sources))


def read_server_meta(variables: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per source from (source_id, name, value). ``names`` gives the wanted variables with their types.

    All variables are optional, and text that is no number becomes NULL.
    """
    def value(name: str, kind: str) -> Column:
        return F.max(F.when(F.lower("name") == name, F.col("value"))).try_cast(kind).alias(name)

    return variables.groupBy("source_id").agg(*[value(n, t) for n, t in names.items()])
