"""Bulk load: which shards are left, run them, and check what arrived."""

from __future__ import annotations

import datetime
import decimal
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crossover.functions.hashing import checksum_aggregates, row_hash
from crossover.sources.schemas import MANIFEST, PUBLISHED

KEY = ["table_name", "shard"]


def record(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append manifest rows (run_token, table_name, shard, row_count, status, message), in a folder of their own so that
    loads running side by side never share an output folder."""
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    full = [(*r[:5], now, r[5]) for r in rows]
    spark.createDataFrame(full, MANIFEST).coalesce(1).write.parquet(f"{path}/entry-{uuid.uuid4().hex}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(path)


def latest(manifest: DataFrame) -> DataFrame:
    """Last word on every shard."""
    rest = [c for c in manifest.columns if c not in KEY]
    return manifest.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "recorded_at").alias("r")).select(*KEY, "r.*")


def of_run(manifest: DataFrame, token: str | None) -> DataFrame:
    """Entries of one run; without ``token`` of the run that wrote to a table last, table by table. A shard number means something only within
    the plan it was made for."""
    if token is not None:
        return manifest.where(F.col("run_token") == token)
    last = manifest.groupBy("table_name").agg(F.max_by("run_token", "recorded_at").alias("run_token"))
    return manifest.join(last, ["table_name", "run_token"], "left_semi")


def pending(plan: DataFrame, manifest: DataFrame, token: str | None = None) -> DataFrame:
    """Shards of ``plan`` that the run ``token`` (or the last one) has not done."""
    manifest = of_run(manifest, token)
    return plan.join(latest(manifest).where("status = 'done'").select(*KEY), KEY, "left_anti")


def load_summary(plan: DataFrame, manifest: DataFrame, excluded: list[str] | None = None, token: str | None = None) -> DataFrame:
    """Per table: shards done and left, rows, and whether it was loaded, failed or skipped."""
    last = latest(of_run(manifest, token)).select(*KEY, "status", "row_count")
    skipped = F.col("table_name").isin(excluded or [])
    state = plan.select(*KEY).join(last, KEY, "left").groupBy("table_name").agg(
        F.count(F.lit(1)).alias("shards"), F.count_if(F.col("status") == "done").alias("shards_done"), F.count_if(F.col("status") == "failed").alias("shards_failed"),
        F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("row_count"))), F.lit(0)).alias("row_count"))
    result = (F.when(skipped, "skipped").when(F.col("shards_failed") > 0, "failed").when(F.col("shards_done") == F.col("shards"), "loaded").otherwise("pending"))
    return state.withColumn("status", result)


def counted_write(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write ``df`` and return the number of rows, counted on the way rather than by reading them again."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def run_load(spark: SparkSession, shards: list[tuple[str, int]], copy: Callable[[str, int], int], manifest_path: str, token: str, concurrency: int = 4) -> None:
    """Copy each shard with ``copy(table, shard) -> rows`` and note the outcome; ``shards`` is one entry per Spark job.

    ``copy`` must replace what an earlier try of the same shard left behind. A failed shard is noted and the rest go on.
    """
    def one(item: tuple[str, int]) -> tuple:
        table, shard = item
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"load-{table}")
        try:
            row = (token, table, shard, copy(table, shard), "done", None)
        except Exception as e:
            row = (token, table, shard, 0, "failed", str(e))
        record(spark, manifest_path, [row])
        return row

    with ThreadPoolExecutor(concurrency) as pool:
        list(pool.map(one, shards))


def load_audit(source_counts: DataFrame, manifest: DataFrame, token: str | None = None) -> DataFrame:
    """Rows of the source against rows written by one run, per table; without ``token`` by the run that wrote to the table last."""
    written = latest(of_run(manifest, token)).where("status = 'done'").groupBy("table_name").agg(F.sum("row_count").alias("written_rows"))
    return source_counts.join(written, "table_name", "left").select(
        "table_name", F.col("row_count").alias("source_rows"), F.coalesce("written_rows", F.lit(0)).alias("written_rows"),
        (F.col("row_count") == F.coalesce("written_rows", F.lit(0))).alias("complete"))


# ---- write, audit, publish ----------------------------------------------------------------------------------------

class LoadMismatch(Exception):
    """What was written is not what the source gave."""


def _figures(row) -> tuple[int, int, int]:
    return row["row_count"], row["hash_xor"] or 0, int(row["hash_sum"] or 0)


def publish_shard(rows: DataFrame, path: str, published: str, token: str, table: str, shard: int, expected: tuple[int, int, int] | None = None) -> int:
    """Write a shard where nobody looks, read it back, and make it visible if count and checksum are those of the source.

    Each try has a folder of its own, so a try that was cut off, or two at a time, leave nothing that could be seen. ``expected`` is the
    source's own (row_count, hash_xor, hash_sum); otherwise they are taken from the rows as they are read. Returns the number of rows.
    """
    spark, folder, seen = rows.sparkSession, f"{quote(table, safe='')}/{shard}/{quote(token, safe='')}-{uuid.uuid4().hex}", Observation()
    rows.observe(seen, *checksum_aggregates(row_hash(rows))).write.parquet(f"{path}/{folder}")
    given = expected or _figures(seen.get)
    there = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
    found = _figures(there.agg(*checksum_aggregates(row_hash(there))).first())
    if found != given:
        raise LoadMismatch(f"{table}/{shard}: {found[0]} rows written, {given[0]} in the source" if found[0] != given[0] else f"{table}/{shard}: rows differ from the source's")
    entry = (token, table, shard, folder, *found[:2], decimal.Decimal(found[2]), datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([entry], PUBLISHED).coalesce(1).write.parquet(f"{published}/entry-{uuid.uuid4().hex}")
    return found[0]


def read_published(spark: SparkSession, published: str, token: str) -> DataFrame:
    """What a run has made visible: the last entry of each shard."""
    rows = spark.read.schema(PUBLISHED).option("recursiveFileLookup", "true").parquet(published)
    return latest(rows.where(F.col("run_token") == token))


def loaded_table(spark: SparkSession, path: str, published: str, token: str, table: str, schema) -> DataFrame:
    """The rows of a table that a run has published; folders come to the driver, one for each shard."""
    folders = [f"{path}/{r['folder']}" for r in read_published(spark, published, token).where(F.col("table_name") == table).select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def run_published_load(spark: SparkSession, plan: DataFrame, rows: Callable[[str, int], DataFrame], path: str, token: str, concurrency: int = 4,
                       expected: Callable[[str, int], tuple[int, int, int]] | None = None) -> DataFrame:
    """Load all shards of ``plan`` (table_name, shard) that the run has not published yet, and return :func:`load_summary`.

    Below ``path``: ``data``, ``published`` and ``manifest``. Started again with the same token it does what is left; whatever an earlier try
    left behind is replaced, since only published folders are the table.
    """
    manifest = f"{path}/manifest"
    record(spark, manifest, [])
    left = [(r["table_name"], r["shard"]) for r in pending(plan, read_manifest(spark, manifest), token).collect()]  # as many as the plan has jobs

    def copy(table: str, shard: int) -> int:
        return publish_shard(rows(table, shard), f"{path}/data", f"{path}/published", token, table, shard, expected(table, shard) if expected else None)

    run_load(spark, left, copy, manifest, token, concurrency)
    return load_summary(plan, read_manifest(spark, manifest), token=token)


def load_events(manifest: DataFrame) -> DataFrame:
    """Manifest rows as run events."""
    return manifest.select(F.col("run_token").alias("run_id"), F.lit("load").alias("phase"), F.concat_ws("/", "table_name", F.col("shard").cast("string")).alias("step"),
                           F.when(F.col("status") == "done", "ok").otherwise("error").alias("outcome"), F.col("recorded_at").alias("ts"),
                           F.col("row_count").alias("rows"), F.col("message").alias("error"))
