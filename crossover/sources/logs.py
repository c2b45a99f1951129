"""Run logs and usage logs: JSON lines in many files, bad lines kept apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossover.sources.schemas import REPORT_SECTIONS, REPORT_SUMMARY, RUN_EVENT, USAGE_LINE


def _line_order() -> Column:
    """Position of a line in its file: the start of the block, then the place within the block."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), _line_order().alias("line_no"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files, with the scores taken from their metrics."""
    raw = _read(spark, path, RUN_EVENT)

    def metric(n: str) -> Column:
        return F.try_element_at("metrics", F.lit(n)).try_cast("bigint").alias(n)

    return raw.select("file_name", "line_no", "run_id", "phase", "step", "outcome", F.col("timestamp").alias("ts"), "duration_ms", metric("overall_score"),
                      metric("score"), "metrics", "error", "version", "_corrupt_record")


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all session files and of the helpers below them."""
    u = "message.usage"
    zero = F.lit(0).cast("bigint")
    raw = _read(spark, path, USAGE_LINE)
    return raw.select(
        F.regexp_extract("file_path", r"([^/]+(?:/subagents/[^/]+)?)$", 1).alias("file_name"), "line_no", F.col("type").alias("role"),
        F.col("message.content").alias("content"), F.coalesce("message.model", F.lit("unknown")).alias("model"), F.col(u).isNotNull().alias("has_usage"),
        F.coalesce(f"{u}.input_tokens", zero).alias("input_tokens"), F.coalesce(f"{u}.output_tokens", zero).alias("output_tokens"),
        F.coalesce(f"{u}.cache_creation_input_tokens", zero).alias("cache_write_tokens"),
        F.coalesce(f"{u}.cache_read_input_tokens", zero).alias("cache_read_tokens"), "_corrupt_record")


def _bad_line(log: DataFrame) -> Column:
    """Text of a bad line, else NULL. The reader wants another column read next to it, hence the run or the role."""
    kind = F.coalesce("run_id" if "run_id" in log.columns else "role", F.lit(""))
    return F.concat(kind, "_corrupt_record")


def good_lines(log: DataFrame) -> DataFrame:
    return log.where(_bad_line(log).isNull()).drop("_corrupt_record")


def bad_line_counts(log: DataFrame) -> DataFrame:
    """Lines per file and how many of them are no JSON, so that skipping them is never silent."""
    return log.groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), F.count(_bad_line(log)).alias("bad_lines"))


def read_report(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Scan reports as inventory frames, one for each section, in the names of catalogs. The source id is the host of the report.

    ``modules`` holds routines, triggers, views and events in the form that the text operators read.
    """
    def docs(part: str) -> DataFrame:
        """The documents with one part of them, so that the others are passed over and not built."""
        return spark.read.schema(f"source struct<host string>, {part}").option("multiLine", multiline).json(path)

    host = F.col("source.host").alias("source_id")
    frames = {n: docs(f"schema_inventory struct<{n} array<struct<{fields}>>>").select(host, F.inline(f"schema_inventory.{n}")) for n, fields in REPORT_SECTIONS.items()}
    for n in ("tables", "columns", "indexes"):
        frames[n] = frames[n].withColumn("schema_name", F.coalesce("schema_name", "table_schema")).drop("table_schema")
    named = {"foreign_keys": {"constraint_schema": "schema_name", "constraint_name": "fk_name", "referenced_table_schema": "ref_schema", "referenced_table_name": "ref_table"},
             "partitions": {"table_schema": "schema_name"}, "events": {"event_schema": "schema_name"}}
    for n, names in named.items():
        frames[n] = frames[n].withColumnsRenamed(names)
    yes = F.upper("is_nullable").isin("YES", "TRUE", "1")
    frames["columns"] = frames["columns"].withColumn("is_nullable", yes)
    for n, lists in (("indexes", ["columns"]), ("foreign_keys", ["columns", "ref_columns"])):
        frames[n] = frames[n].withColumns({c: F.split(c, r"\s*,\s*") for c in lists})
    frames["modules"] = _modules(frames)
    frames["summary"] = docs(f"summary struct<{REPORT_SUMMARY}>").select(host, "summary.*")
    return frames


def _modules(frames: dict[str, DataFrame]) -> DataFrame:
    empty = F.lit(None).cast("string")

    def part(section: str, kind: str, schema: str, name: str, definition: str, routine_type: Column = empty, **more: str) -> DataFrame:
        extra = [(F.col(more[c]) if c in more else empty).alias(c) for c in ("action_timing", "event_manipulation", "event_table")]
        return frames[section].select("source_id", F.lit(kind).alias("kind"), F.col(schema).alias("schema_name"), F.col(name).alias("name"), routine_type.alias("routine_type"),
                                      F.col(definition).alias("definition"), *extra)

    parts = [part("routines", "routine", "routine_schema", "routine_name", "routine_definition", F.col("routine_type")), part("views", "view", "table_schema", "table_name", "view_definition"),
             part("triggers", "trigger", "trigger_schema", "trigger_name", "action_statement", action_timing="action_timing", event_manipulation="event_manipulation", event_table="event_object_table"),
             part("events", "event", "schema_name", "event_name", "event_definition")]
    return reduce(DataFrame.unionByName, parts)
