"""Column profiles out of sketches that are stored by shard and merged, so that a new or changed shard costs one pass over that shard.

Counts, extremes and longest values merge without loss. The distinct count comes from a HyperLogLog sketch (about 2 percent off), quantiles
from a KLL sketch (about 1.5 percent of the rows off), frequent values from a sketch of items whose counts are too high by at most what it
had no room for. All of them are Spark's own aggregates, and a row of sketches takes some kilobytes whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.operators.mapping import field_for, problem

TRACKED, TOP, HLL_BITS = 4096, 10, 12
QUANTILES = [0.25, 0.5, 0.75]
_EXTREMES = {"whole": "bigint", "decimal": "decimal(38,18)", "double": "double", "time": "timestamp_ntz", "text": "string"}


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, T.IntegralType):
        return "whole"
    if isinstance(t, T.DecimalType):
        return "decimal" if t.precision - t.scale <= 20 else "double"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text" if isinstance(t, T.StringType) else None


def overflow(df: DataFrame, column: str, target: str) -> Column:
    """How many values the target type does not take as they are, by the tests that :func:`mapping.conform` rejects rows with."""
    return F.count_if(problem(df, field_for(column, target.upper()))[1].isNotNull())


def sketch_columns(df: DataFrame, target: dict[str, str] | None = None) -> DataFrame:
    """A row of figures and sketches for each column, in one pass."""
    target, aggs, items = target or {}, [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f"`{f.name}`"), _kind(f.dataType)
        number = c.cast("double") if kind in ("whole", "decimal", "double") else F.char_length(c).cast("double") if kind == "text" else (
            F.unix_micros(c.cast("timestamp")).cast("double") if kind == "time" else F.lit(None).cast("double"))
        text = c.cast("string") if kind else F.lit(None).cast("string")
        made = {"null_count": F.count_if(c.isNull()), "max_length": F.max(F.char_length(c)) if kind == "text" else F.lit(None).cast("int"),
                "overflow_count": overflow(df, f.name, target[f.name]) if f.name in target else F.lit(0).cast("long"),
                "distinct_sketch": F.hll_sketch_agg(text, HLL_BITS), "quantile_sketch": F.kll_sketch_agg_double(F.when(~F.isnan(number), number)),
                "top_sketch": F.expr(f"approx_top_k_accumulate({'cast(`' + f.name.replace('`', '``') + '` as string)' if kind else 'cast(null as string)'}, {TRACKED})")}
        for side, fn in (("min", F.min), ("max", F.max)):
            for name, of in _EXTREMES.items():
                made[f"{side}_{name}"] = fn(c.cast(of)) if kind == name else F.lit(None).cast(of)
        aggs += [a.alias(f"c{i}_{n}") for n, a in made.items()]
        items.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(kind).alias("kind"), F.col("rows").alias("row_count"), *[F.col(f"c{i}_{n}").alias(n) for n in made]))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def store_shard(df: DataFrame, path: str, table: str, shard: str, target: dict[str, str] | None = None) -> None:
    """Keep the sketches of a shard; those of an earlier try are replaced."""
    sketch_columns(df, target).withColumn("table_name", F.lit(table)).coalesce(1).write.mode("overwrite").parquet(f"{path}/{quote(table, safe='')}/shard={quote(str(shard), safe='')}")


def store_shards(shards: Iterable[tuple[str, str, DataFrame]], path: str, targets: dict[str, dict[str, str]] | None = None, concurrency: int = 16) -> None:
    """Keep the sketches of many shards (table, shard, rows) side by side, a Spark job each: a shard ends in one task, in whose time the others use the
    executors. A shard that comes again is stored again, in the order given."""
    chains: dict[tuple[str, str], list[DataFrame]] = {}
    for table, shard, df in shards:
        chains.setdefault((table, shard), []).append(df)

    def one(key: tuple[str, str]) -> None:
        for df in chains[key]:
            store_shard(df, path, *key, (targets or {}).get(key[0]))

    with ThreadPoolExecutor(concurrency) as pool:
        list(pool.map(one, sorted(chains, key=lambda key: -len(chains[key]))))  # the longest first


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One row of sketches for each table and column."""
    ends = [fn(f"{side}_{n}").alias(f"{side}_{n}") for side, fn in (("min", F.min), ("max", F.max)) for n in _EXTREMES]
    return sketches.groupBy("table_name", "column_name").agg(
        F.max("kind").alias("kind"), *[F.sum(n).alias(n) for n in ("row_count", "null_count", "overflow_count")], F.max("max_length").alias("max_length"), *ends,
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"))


def figures(merged: DataFrame) -> DataFrame:
    """Profile out of merged sketches: extremes as text, distinct count, quartiles (of a text's lengths, of a time in microseconds), the most
    frequent values."""
    def extreme(side: str) -> Column:
        texts = [F.col(f"{side}_{n}").cast("string") for n in ("whole", "time", "text")]
        decimal = F.col(f"{side}_decimal").cast("string")
        trimmed = F.when(decimal.contains("."), F.regexp_replace(decimal, r"\.?0+$", "")).otherwise(decimal)
        return F.coalesce(*texts, trimmed, F.col(f"{side}_double").cast("string")).alias(f"{side}_value")

    filled = F.kll_sketch_get_n_double("quantile_sketch") > 0
    quartiles = F.when(filled, F.array(*[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)) for q in QUANTILES]))
    return merged.select("table_name", "column_name", "kind", "row_count", "null_count", "overflow_count", "max_length", extreme("min"), extreme("max"),
                         F.when(F.col("kind").isNotNull(), F.hll_sketch_estimate("distinct_sketch")).alias("distinct_count"), quartiles.alias("quartiles"),
                         F.expr(f"approx_top_k_estimate(top_sketch, {TOP})").alias("top_values"))


def stored_profile(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """The profile of tables whose shards are stored; their rows are not read."""
    parts = [spark.read.parquet(f"{path}/{quote(t, safe='')}").drop("shard") for t in tables]
    return figures(merge_sketches(reduce(DataFrame.unionByName, parts)))
