"""Size profiles and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.constants import MYSQL_LOB_TYPES
from crossover.operators.inventory import PAGE_KB, base_tables
from crossover.operators.sketches import overflow

MB = 1024 * 1024


def table_sizes(tables: DataFrame) -> DataFrame:
    """Size per table in MB with two decimals. Sorting is left to the caller who wants a report."""

    def mb(c: Column) -> Column:
        return F.round(c / MB, 2)

    base = base_tables(tables)
    return base.select("source_id", "schema_name", "table_name", "table_rows", mb(F.col("data_length")).alias("data_mb"),
                       mb(F.col("index_length")).alias("index_mb"), mb(F.col("data_length") + F.col("index_length")).alias("total_mb"))


def table_sizes_mssql(stats: DataFrame, tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Sizes from page counts; what is used but holds no row, overflow or large value belongs to indexes."""
    obj = ["source_id", "object_id"]
    data = F.col("in_row_pages") + F.col("lob_pages") + F.col("overflow_pages")
    pages = stats.groupBy(*obj).agg(F.sum("row_count").alias("row_count"), F.sum("reserved_pages").alias("reserved"),
                                    F.sum(data).alias("data"), F.sum("used_pages").alias("used"))

    def mb(c: Column) -> Column:
        return c * PAGE_KB / 1024.0

    return (pages.join(tables.select(*obj, "schema_id", F.col("name").alias("table_name")), obj)
            .join(schemas.select("source_id", "schema_id", F.col("name").alias("schema_name")), ["source_id", "schema_id"])
            .select("source_id", "schema_name", "table_name", "row_count", mb(F.col("reserved")).alias("reserved_mb"),
                    mb(F.col("data")).alias("data_mb"), mb(F.col("used") - F.col("data")).alias("index_mb")))


def profile_totals(sizes: DataFrame) -> DataFrame:
    """Totals per source over the rounded sizes, added as decimals so that the order of rows never shows."""
    def total(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(24,4)")).cast("double")

    rows = "table_rows" if "table_rows" in sizes.columns else "row_count"
    largest = "total_mb" if "total_mb" in sizes.columns else "reserved_mb"
    return sizes.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("table_count"), F.sum(rows).alias("total_rows"), total("data_mb").alias("total_data_mb"),
        total("index_mb").alias("total_index_mb"), F.max("data_mb").alias("largest_data_mb"),
        F.max(largest).alias("largest_table_mb"), F.max(rows).alias("largest_table_rows"))


def lob_columns(columns: DataFrame, types: list[str] | None = None) -> DataFrame:
    return (columns.where(F.lower("data_type").isin(types or MYSQL_LOB_TYPES))
            .select("source_id", "schema_name", "table_name", "column_name", "data_type"))


def largest_tables(sizes: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest tables of each source; ties go by name."""
    w = Window.partitionBy("source_id").orderBy(F.desc("total_mb"), "schema_name", "table_name")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def transfer_hours(total_mb: Column, mbps: float = 100.0) -> Column:
    return F.round(total_mb / (mbps / 8) / 3600, 1)


def lob_max_len(df: DataFrame, columns: list[str], fraction: float | None = None) -> DataFrame:
    """Longest value in bytes per column, over all rows or over a share of them, chosen by a hash of the values and so the same each time."""
    data = df if fraction is None else df.where(F.pmod(F.xxhash64(*columns), F.lit(1_000_000)) < int(fraction * 1_000_000))
    one = data.agg(*[F.max(F.octet_length(c)).alias(c) for c in columns])
    return _long(one, [(c, [F.col(c).alias("max_bytes")]) for c in columns])


def _long(one_row: DataFrame, items: list[tuple[str, list[Column]]]) -> DataFrame:
    """Turn a row of aggregates into one row per column."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column_name"), *cols) for name, cols in items])))


# Largest value the target type of a column takes, for the types whose target is narrower or may be.
TYPE_RANGE = {"tinyint": (0, 255), "smallint": (-32768, 32767), "int": (-2147483648, 2147483647)}


def column_profile(df: DataFrame, distinct: str | None = "approx", target: dict[str, str] | None = None) -> DataFrame:
    """Rows, NULLs, distinct values, least and greatest value and length per column, in one pass.

    ``distinct`` is ``approx`` (a sketch), ``exact`` or None. ``target`` names a target type per column; values out of
    its range, or that it would change, are counted. An exact count groups (column, value) pairs, so that no single task holds a whole column.
    """
    target = target or {}
    aggs, items = [F.count(F.lit(1)).alias("_rows")], []
    for f in df.schema.fields:
        c, n = F.col(f"`{f.name}`"), f.name
        text = isinstance(f.dataType, T.StringType)
        number = isinstance(f.dataType, T.NumericType)
        aggs += [F.count_if(c.isNull()).alias(f"{n}__nulls")]
        cells = [F.col("_rows").alias("row_count"), F.col(f"`{n}__nulls`").alias("null_count")]
        if distinct == "approx":
            aggs.append(F.approx_count_distinct(c).alias(f"{n}__distinct"))
            cells.append(F.col(f"`{n}__distinct`").alias("distinct_count"))
        for name, fn in (("min_number", F.min), ("max_number", F.max)):
            aggs.append((fn(c).cast("double") if number else F.lit(None).cast("double")).alias(f"{n}__{name}"))
            cells.append(F.col(f"`{n}__{name}`").alias(name))
        for name, fn in (("min_text", F.min), ("max_text", F.max)):
            aggs.append((fn(c) if text else F.lit(None).cast("string")).alias(f"{n}__{name}"))
            cells.append(F.col(f"`{n}__{name}`").alias(name))
        # Numbers as doubles lose digits beyond 2**53, and dates are no numbers: the exact extremes as text.
        exact = isinstance(f.dataType, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType))
        for name, fn in (("min_value", F.min), ("max_value", F.max)):
            aggs.append((fn(c).cast("string") if exact else F.lit(None).cast("string")).alias(f"{n}__{name}"))
            cells.append(F.col(f"`{n}__{name}`").alias(name))
        aggs.append((F.max(F.length(c)) if text else F.lit(None).cast("int")).alias(f"{n}__len"))
        cells.append(F.col(f"`{n}__len`").alias("max_length"))
        low, high = TYPE_RANGE.get(target.get(n, "").lower(), (None, None))
        # The three ranges are for numbers; all other targets count what conform would reject.
        over = F.count_if(~c.between(low, high)) if low is not None and number else overflow(df, n, target[n]) if n in target and low is None else F.lit(0).cast("long")
        aggs.append(over.alias(f"{n}__over"))
        cells.append(F.col(f"`{n}__over`").alias("overflow_count"))
        items.append((n, cells))
    out = _long(df.agg(*aggs), items)
    if distinct == "exact":
        values = df.select(F.inline(F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in df.schema.fields])))
        counts = (values.where("value is not null").groupBy("column_name", "value").agg(F.lit(1).alias("one"))
                  .groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count")))
        out = out.join(counts, "column_name", "left").fillna(0, ["distinct_count"])
    return out


def profile_tables(tables: dict[str, DataFrame], **options) -> DataFrame:
    return reduce(DataFrame.unionByName, [column_profile(df, **options).withColumn("table_name", F.lit(n)) for n, df in tables.items()])
