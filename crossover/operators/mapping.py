"""Types, names and collations of the target, and conforming rows to them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.constants import COLLATION_MAP, DEFAULT_COLLATION, MYSQL_SPATIAL_TYPES, TYPE_MAP, UNSUPPORTED_COLLATIONS
from crossover.functions.text import lookup, rows_of

NATIONAL = ["nchar", "nvarchar"]  # the catalog gives their length in bytes, two per character


def target_type(data_type: Column, max_length: Column, precision: Column, scale: Column, bytes_per_national: int = 2) -> Column:
    """Target type of a column with its length, precision and scale."""
    dt = F.lower(F.coalesce(data_type, F.lit("")))
    base = F.coalesce(lookup(TYPE_MAP, dt), F.when(dt == "", "TEXT").otherwise(F.upper(data_type)))
    sized = dt.isin("varchar", "nvarchar", "char", "nchar", "binary", "varbinary")
    length = F.when(dt.isin(NATIONAL), F.floor(max_length / bytes_per_national)).otherwise(max_length).cast("int")
    return (F.when(sized & (max_length > 0), F.format_string("%s(%d)", base, length))
            .when((dt == "varbinary") & (max_length < 0), "LONGBLOB").when(sized & (max_length < 0), "LONGTEXT")
            .when(dt.isin("decimal", "numeric"), F.format_string("DECIMAL(%d,%d)", F.coalesce(precision, F.lit(18)), F.coalesce(scale, F.lit(0))))
            .when(dt == "datetime2", F.format_string("DATETIME(%d)", F.least(F.greatest(F.coalesce(scale, F.lit(6)), F.lit(0)), F.lit(6))))
            .otherwise(base))


def map_types(columns: DataFrame) -> DataFrame:
    """Add ``target_type`` and whether the type was known."""
    c = F.col
    return columns.withColumns({
        "target_type": target_type(c("data_type"), c("max_length"), c("num_precision"), c("num_scale")),
        "known_type": F.lower("data_type").isin(list(TYPE_MAP))})


def map_names(tables: DataFrame, mode: str) -> DataFrame:
    """Target database and table: ``flatten`` drops the schema, ``prefix`` puts it before the name, ``database`` keeps it."""
    if mode not in ("flatten", "prefix", "database"):
        raise ValueError(f"unknown name mapping: {mode}")
    schema, table = F.col("schema_name"), F.col("table_name")
    db = schema if mode == "database" else F.lit(None).cast("string")
    name = F.when(F.lower(schema) == "dbo", table).otherwise(F.concat(schema, F.lit("_"), table)) if mode == "prefix" else table
    return tables.withColumns({"target_db": db, "target_table": name})


def name_collisions(mapped: DataFrame) -> DataFrame:
    """Every table whose target name another table of the source also gets, with the number that share it.

    The sharing tables stay rows; counts of the target names are joined back to them.
    """
    key = ["source_id", "_db", "target_table"]
    tables = (mapped.select("source_id", "schema_name", "table_name", F.coalesce("target_db", F.lit("")).alias("_db"), "target_table").distinct())
    shared = tables.groupBy(*key).agg(F.count(F.lit(1)).alias("tables")).where("tables > 1")
    return tables.join(shared, key).select("source_id", "schema_name", "table_name", "target_table", "tables")


def orphan_tables(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables without any column row."""
    key = ["source_id", "schema_name", "table_name"]
    return tables.select(*key).join(columns.select(*key), key, "left_anti")


def target_schema(columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Ordered columns and primary key per table. A table's column count is bounded by its database."""
    key = ["source_id", "schema_name", "table_name"]
    mapped = map_types(columns)
    fields = F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", "target_type", "is_nullable", "is_identity", "is_computed")))
    pk = indexes.where("is_primary_key").groupBy(*key).agg(F.first("columns").alias("primary_key"))
    return mapped.groupBy(*key).agg(fields.alias("fields")).join(pk, key, "left")


def map_mysql(columns: DataFrame, default_collation: str = DEFAULT_COLLATION) -> DataFrame:
    """Column rules within the MySQL family: spatial becomes JSON, a missing collation the default one, with a note each."""
    spatial = F.lower("data_type").isin(MYSQL_SPATIAL_TYPES)
    bad = F.lower("collation_name").isin(UNSUPPORTED_COLLATIONS)
    return columns.select(
        "*", F.when(spatial, "json").otherwise(F.col("data_type")).alias("target_type"),
        F.when(bad, default_collation).otherwise(F.col("collation_name")).alias("target_collation"),
        F.concat_ws("; ", F.when(spatial, "spatial to json"), F.when(bad, "collation replaced")).alias("notes"))


def map_engines(tables: DataFrame, default_collation: str = DEFAULT_COLLATION) -> DataFrame:
    """One storage engine for all tables, and known collations only."""
    other = F.col("engine").isNotNull() & (F.upper("engine") != "INNODB")
    bad = F.lower("table_collation").isin(UNSUPPORTED_COLLATIONS)
    return tables.select("source_id", "schema_name", "table_name", F.lit("InnoDB").alias("target_engine"), other.alias("engine_changed"),
                         F.when(bad, default_collation).otherwise(F.col("table_collation")).alias("target_collation"))


def target_collation(name: Column) -> Column:
    """By name, else by what the name says: CI compares without case, CS and BIN compare bytes."""
    return F.coalesce(lookup(COLLATION_MAP, name), F.when(F.upper(name).contains("_CI"), "utf8mb4_general_ci")
                      .when(F.upper(name).contains("_CS") | F.upper(name).contains("_BIN"), "utf8mb4_bin"))


def map_collations(columns: DataFrame) -> DataFrame:
    """Collations in use with their target and the number of columns."""
    used = columns.where("collation_name is not null").groupBy("source_id", "collation_name").agg(F.count(F.lit(1)).alias("column_count"))
    return used.withColumn("target_collation", target_collation(F.col("collation_name")))


def plan_indexes(indexes: DataFrame, target: str = "cloud") -> DataFrame:
    """What happens to each index: primary keys come with the table, full-text stays on cloud targets only."""
    fulltext = F.upper("index_type") == "FULLTEXT"
    return indexes.select(
        "source_id", "schema_name", "table_name", "index_name",
        F.when(F.upper("index_name") == "PRIMARY", "with_table").when(fulltext & F.lit(target != "cloud"), "drop")
        .when(F.col("is_unique"), "create_unique").otherwise("create").alias("action"))


def classify_defaults(columns: DataFrame) -> DataFrame:
    """Kind of each default: keyword, number, expression or literal; blank means none."""
    v = F.trim("column_default")
    kind = (F.when(v.isNull() | (v == ""), "none").when(F.upper(v).isin("CURRENT_TIMESTAMP", "NULL"), "keyword")
            .when(v.rlike(r"^-?\d+(\.\d+)?$"), "number").when(v.startswith("(") & v.endswith(")"), "expression").otherwise("literal"))
    return columns.select("source_id", "schema_name", "table_name", "column_name", kind.alias("default_kind"))


def schema_diff(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """Columns added, removed or changed between two catalogs of the same tables."""
    key = ["source_id", "schema_name", "table_name", "column_name"]
    a, b = before.select(*key, F.struct(*fields).alias("a")), after.select(*key, F.struct(*fields).alias("b"))
    change = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
              .when(~F.col("a").eqNullSafe(F.col("b")), "changed"))
    both = a.join(b, key, "full_outer").withColumn("change", change).where("change is not null")
    return both.select(*key, "change", *[F.col(f"a.{f}").alias(f"old_{f}") for f in fields], *[F.col(f"b.{f}").alias(f"new_{f}") for f in fields])


# ---- conforming rows ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    """A target column: Spark type, longest text in characters or bytes, least and greatest number, NULL allowed, digits of a second, digits of a
    number kept as text (total, fraction)."""

    name: str
    type: T.DataType
    max_length: int | None = None
    low: int | None = None
    high: int | None = None
    nullable: bool = True
    second_digits: int | None = None
    digits: tuple[int, int] | None = None


def _narrows(have: T.DataType, want: T.DataType) -> bool:
    """Whether a cast that succeeds can still change the value."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(have, (T.DoubleType, T.FloatType, T.DecimalType)):
        return isinstance(want, whole) or isinstance(have, T.DoubleType) and isinstance(want, T.FloatType)
    if isinstance(have, whole):
        return isinstance(want, (*whole, T.DoubleType, T.FloatType)) and have != want
    return isinstance(have, (T.TimestampType, T.TimestampNTZType)) and isinstance(want, T.DateType)


def problem(df: DataFrame, f: Field) -> tuple[Column, Column]:
    """The converted value and the reason it is rejected, NULL when it is fine."""
    src = F.col(f"`{f.name}`")
    out = src.try_cast(f.type)
    checks = F.when(src.isNotNull() & out.isNull(), "bad_value")
    if isinstance(f.type, T.DecimalType):
        # A cast to a smaller scale rounds; a value that changes by it is not the same value. The wider type has all digits of the
        # target before the point, and as many behind it as there is room for.
        whole = f.type.precision - f.type.scale
        wide = T.DecimalType(38, 38 - whole)
        checks = checks.when(out.isNotNull() & (src.try_cast(wide) != out.cast(wide)), "loses_digits")
    elif isinstance(df.schema[f.name].dataType, T.IntegralType) and isinstance(f.type, (T.DoubleType, T.FloatType)):
        # The cast back saturates at the largest number; halves stay within range and are exact.
        checks = checks.when(out.isNotNull() & ((out.cast("double") / 2 >= 2.0**62) | ~out.try_cast(df.schema[f.name].dataType).eqNullSafe(src)), "loses_digits")
    elif _narrows(df.schema[f.name].dataType, f.type):
        checks = checks.when(out.isNotNull() & (out.cast(df.schema[f.name].dataType) != src), "loses_digits")
    if f.second_digits is not None and f.second_digits < 6:
        checks = checks.when(F.unix_micros(out.cast("timestamp")) % 10 ** (6 - f.second_digits) != 0, "loses_digits")
    if f.digits is not None:
        whole, scale = f.digits[0] - f.digits[1], f.digits[1]
        out = out.cast("string")
        checks = checks.when(~F.rlike(out, F.lit(rf"^[+-]?0*\d{{1,{max(whole, 1)}}}(\.\d*)?$")), "overflow").when(~F.rlike(out, F.lit(rf"^[^.]*(\.\d{{0,{scale}}}0*)?$")), "loses_digits")
    if f.max_length is not None:
        size = F.octet_length(out) if isinstance(f.type, T.BinaryType) else F.char_length(out)
        checks = checks.when(size > f.max_length, "too_long")
    if f.low is not None:
        checks = checks.when(out < f.low, "overflow")
    if f.high is not None:
        checks = checks.when(out > f.high, "overflow")
    if not f.nullable:
        checks = checks.when(src.isNull(), "null_not_allowed")
    return out, checks


def conform(df: DataFrame, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """Rows in the target's types, and the values that do not fit: (good rows, rejects).

    Rejects have the source row's columns plus the column at fault, the value and the reason, one row per bad value.
    Casts never abort the job.
    """
    tested = {f.name: problem(df, f) for f in fields}
    faults = [F.when(bad.isNotNull(), F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").cast("string").alias("value"), bad.alias("reason")))
              for n, (_, bad) in tested.items()]
    fits = reduce(lambda a, b: a & b, [bad.isNull() for _, bad in tested.values()])
    good = df.where(fits).select(*[out.alias(n) for n, (out, _) in tested.items()])
    return good, rows_of(df, df.columns, *faults)


SPARK_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "TINYINT UNSIGNED": T.ShortType(), "TINYINT(1)": T.BooleanType(),
    "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "DATE": T.DateType(), "LONGTEXT": T.StringType(), "JSON": T.StringType(),
    "LONGBLOB": T.BinaryType(), "TIME(6)": T.StringType(), "TEXT": T.StringType(),
}


def field_for(name: str, target: str, nullable: bool = True) -> Field:
    """Field of a target type such as ``VARCHAR(40)`` or ``DECIMAL(10,2)``."""
    base, _, rest = target.partition("(")
    args = [int(x) for x in rest.rstrip(")").split(",")] if rest and rest.rstrip(")").replace(",", "").isdigit() else []
    if target in SPARK_TYPES:
        low, high = (0, 255) if target == "TINYINT UNSIGNED" else (None, None)
        return Field(name, SPARK_TYPES[target], low=low, high=high, nullable=nullable)
    if base == "DECIMAL":
        p, s = args
        if p > 38:  # more than a Spark decimal holds: kept as text, its digits checked
            return Field(name, T.StringType(), nullable=nullable, digits=(p, s))
        return Field(name, T.DecimalType(p, s), nullable=nullable)
    if base == "DATETIME":
        return Field(name, T.TimestampNTZType(), nullable=nullable, second_digits=args[0] if args else 0)
    if base in ("BINARY", "VARBINARY"):
        return Field(name, T.BinaryType(), args[0] if args else None, nullable=nullable)
    return Field(name, T.StringType(), args[0] if args else None, nullable=nullable)
