"""Reading and writing migrated tables over JDBC, sharded by key range."""

from __future__ import annotations

import decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.sketch import quantiles
from crossover.session import ship

FETCH_ROWS = 20_000


def range_options(url: str, table: str, column: str, low, high, parts: int, fetchsize: int = FETCH_ROWS) -> dict[str, str]:
    """Reader options for a table with one numeric or date key: ``parts`` ranges, one query each."""
    return {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
            "numPartitions": str(parts), "fetchsize": str(fetchsize)}


def _literal(v) -> str:
    return str(v) if isinstance(v, (int, float, decimal.Decimal)) else "'" + str(v).replace("'", "''") + "'"


def _after(keys: list[str], bound: tuple) -> str:
    """``keys`` > ``bound`` in key order, written so that every database understands it."""
    parts = []
    for i, k in enumerate(keys):
        same = [f"{p} = {_literal(b)}" for p, b in zip(keys[:i], bound)]
        parts.append("(" + " AND ".join([*same, f"{k} > {_literal(bound[i])}"]) + ")")
    return "(" + " OR ".join(parts) + ")"


def range_predicates(keys: list[str], bounds: list[tuple]) -> list[str]:
    """Conditions that split a table at ``bounds`` of a composite key; each row meets exactly one of them."""
    if not bounds:
        return ["1 = 1"]
    nulls = " OR ".join(f"{k} IS NULL" for k in keys)
    # A part of a composite key may be NULL while another is beyond a bound; such rows belong to the first shard alone.
    filled = "".join(f" AND {k} IS NOT NULL" for k in keys) if len(keys) > 1 else ""
    out = [f"(NOT {_after(keys, bounds[0])} OR {nulls})"]
    for low, high in zip(bounds, bounds[1:]):
        out.append(f"({_after(keys, low)} AND NOT {_after(keys, high)}{filled})")
    return [*out, f"({_after(keys, bounds[-1])}{filled})" if filled else _after(keys, bounds[-1])]


def read_table(spark: SparkSession, url: str, table: str, keys: list[str], bounds: list[tuple] | tuple, parts: int = 8,
               properties: dict[str, str] | None = None) -> DataFrame:
    """One migrated table. With one key ``bounds`` is (low, high); with several it is the list of split points."""
    props = {"fetchsize": str(FETCH_ROWS), **(properties or {})}
    if len(keys) == 1 and isinstance(bounds, tuple):
        return spark.read.format("jdbc").options(**range_options(url, table, keys[0], *bounds, parts), **(properties or {})).load()
    return spark.read.jdbc(url, table, predicates=range_predicates(keys, bounds), properties=props)


def write_table(df: DataFrame, url: str, table: str, batch: int = 1000, retry: bool = False, connections: int | None = None,
                properties: dict[str, str] | None = None) -> None:
    """Load rows in batches. ``retry`` empties the table first and keeps its definition, so a failed load can run again."""
    out = df if connections is None else df.coalesce(connections)
    props = {"batchsize": str(batch), "isolationLevel": "READ_COMMITTED", "truncate": "true", **(properties or {})}
    out.write.jdbc(url, table, mode="overwrite" if retry else "append", properties=props)


def split_points(df: DataFrame, keys: list[str], shards: int) -> list[tuple]:
    """Up to ``shards`` - 1 bounds of keys of any sortable types for :func:`range_predicates`, from a sketch over all rows.

    What comes to the driver are the bounds.
    """
    ship(df.sparkSession)
    return sorted(tuple(r)[1:] for r in quantiles(df, keys, shards).collect())


def shard_plan(df: DataFrame, key: str, shards: int, accuracy: int = 10_000) -> DataFrame:
    """Key ranges with about equal numbers of rows: (shard, low, high), low exclusive and high inclusive, NULL for open ends.

    Numbers and dates are split by a sketch over all rows, other types at :func:`split_points`.
    """
    kind = df.schema[key].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        ends = df.agg(F.array_distinct(F.percentile_approx(key, [i / shards for i in range(1, shards)], accuracy)).alias("cuts"))
    else:
        cuts = [p[0] for p in split_points(df, [key], shards)]
        ends = df.sparkSession.createDataFrame([(cuts,)], T.StructType([T.StructField("cuts", T.ArrayType(kind))]))
    none = F.array(F.lit(None).cast(kind))
    rows = F.arrays_zip(F.concat(none, "cuts").alias("low"), F.concat(F.col("cuts"), none).alias("high"))
    return ends.select(F.posexplode(rows).alias("shard", "r")).select("shard", "r.low", "r.high")


def in_shard(key: str, low, high):
    """Filter for one shard; plain comparisons reach the source. Rows without a key belong to the first shard."""
    tests = []
    if low is not None:
        tests.append(F.col(key) > low)
    if high is not None:
        tests.append(F.col(key) <= high if low is not None else (F.col(key) <= high) | F.col(key).isNull())
    return reduce(lambda a, b: a & b, tests, F.lit(True))
