"""Change streams: read, clean, apply and follow them with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


SEGMENT = "segment"


def write_log(changes: DataFrame, path: str, span: int, seq: str = "seq") -> None:
    """Append changes to a log in folders of ``span`` positions."""
    changes.withColumn(SEGMENT, F.floor(F.col(seq) / span)).write.mode("append").partitionBy(SEGMENT).parquet(path)


def read_changes(spark: SparkSession, path: str, schema: T.StructType, start=None, seq: str = "seq", fmt: str = "parquet",
                 files_per_batch: int | None = None, glob: str | None = None, columns: list[str] | None = None, span: int | None = None) -> DataFrame:
    """Stream of change events from files. ``columns`` are SQL expressions for the events' columns.

    ``start`` is the last position already applied and matters on the first start; later the checkpoint knows. A log that keeps ``span``
    positions a folder (``segment=<position div span>``, see :func:`write_log`) is opened from the folder of ``start`` on.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if span:
        reader = reader.schema(T.StructType([*schema, T.StructField(SEGMENT, T.LongType())]))
    events = reader.load(path)
    if span:
        events = events.where(F.col(SEGMENT) >= (start + 1) // span).drop(SEGMENT) if start is not None else events.drop(SEGMENT)
    if columns:
        events = events.selectExpr(*columns)
    return events if start is None else events.where(F.col(seq) > start)


def dedupe_changes(changes: DataFrame, keys: list[str], event_time: str = "commit_ts", delay: str = "1 hour") -> DataFrame:
    """Drop repeated deliveries that come within ``delay`` of each other; keys are forgotten after that."""
    kind = changes.schema[event_time].dataType
    return _timed(changes, event_time, delay).dropDuplicatesWithinWatermark(keys).withColumn(event_time, F.col(event_time).cast(kind))


def _timed(df: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Watermark on streams. Event time has to be an instant; a local time counts in the session's zone."""
    if not df.isStreaming:
        return df
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)


def keep_batches(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
                 mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Write each micro-batch to a folder of its own and stop when the input is used up, or go on every ``interval``.

    A batch that is run again after a failure replaces its folder, so nothing is applied twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def latest_rows(spark: SparkSession, path: str, keys: list[str], by: str = "batch_id") -> DataFrame:
    """Newest row of each key over all batches. Partial aggregation keeps one row per key and task."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r")).select(*keys, "r.*")


# ---- apply --------------------------------------------------------------------------------------------------------

def newest_per_key(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The change with the highest sequence per key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def apply_changes(changes: DataFrame, store: str, checkpoint: str, keys: list[str], seq: str = "seq", interval: str | None = None) -> StreamingQuery:
    """Keep the newest change per key of every batch. Deletes stay as rows, so an older insert cannot bring a key back."""
    return keep_batches(changes, store, checkpoint, lambda batch: newest_per_key(batch, keys, seq), interval=interval)


def as_changes(base: DataFrame, seq: str = "seq", op: str = "op") -> DataFrame:
    """Rows loaded in bulk as inserts that come before every change."""
    return base.withColumns({seq: F.lit(-(1 << 63)).cast("long"), op: F.lit("I")})


def current_rows(spark: SparkSession, store: str, keys: list[str], seq: str = "seq", op: str = "op", base: DataFrame | None = None) -> DataFrame:
    """State of the table: newest change per key over all batches, deleted keys left out. The order of batches is irrelevant.

    ``base`` holds the rows that were loaded before the stream began; those that never changed stay as they are.
    """
    rows = latest_rows(spark, store, keys, by=seq)
    if base is not None:
        rows = newest_per_key(as_changes(base, seq, op).unionByName(rows), keys, seq)
    return rows.where(F.col(op) != "D")


def fold(spark: SparkSession, snapshot: DataFrame, store: str, target: str, keys: list[str], seq: str = "seq") -> None:
    """The next version of a snapshot: its rows (with their sequence, deletes included) and the changes of ``store``, newest per key.

    Later queries read the version and the changes after it instead of the whole history. A version is never written over.
    """
    changes = latest_rows(spark, store, keys, by=seq)
    newest_per_key(snapshot.select(changes.columns).unionByName(changes), keys, seq).write.parquet(target)


def compact(spark: SparkSession, store: str, target: str, keys: list[str], seq: str = "seq") -> None:
    """Write one row per key, deletes included, as the first batch of a new store.

    Stop the stream first and start it again on ``target`` with the same checkpoint.
    """
    latest_rows(spark, store, keys, by=seq).write.mode("overwrite").parquet(f"{target}/batch_id=-1")


# ---- lag and state ------------------------------------------------------------------------------------------------

def sync_lag(applied: DataFrame, window: str = "1 minute", slide: str | None = None, delay: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Lag in seconds and newest position per window of commit time (and table); sliding when ``slide`` is given.

    Works on batches and on streams.
    """
    lag = F.unix_micros(F.col("applied_ts").cast("timestamp")) - F.unix_micros(F.col("commit_ts").cast("timestamp"))
    timed, kind = _timed(applied, "commit_ts", delay), applied.schema["commit_ts"].dataType
    w = F.window("commit_ts", window, slide) if slide else F.window("commit_ts", window)
    return (timed.groupBy(w.alias("w"), *(by or [])).agg(
        F.max(lag / 1e6).alias("max_lag_seconds"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("changes"))
        .select(F.col("w.start").cast(kind).alias("window_start"), *(by or []), "max_lag_seconds", "max_seq", "changes"))


def activity(changes: DataFrame, gap_seconds: int = 1800, by: list[str] | None = None) -> DataFrame:
    """Bursts of changes, parted by gaps of at least ``gap_seconds``, from a batch of changes.

    Changes are counted per stretch of time as long as the gap first, inside which no gap can lie. Only the stretches
    are put in order, so a busy table takes no more room in a task than a quiet one.
    """
    by = by or []
    micros = F.unix_micros(F.col("commit_ts").cast("timestamp"))
    stretch = F.floor(micros / (gap_seconds * 1_000_000)).alias("_stretch")
    parts = changes.groupBy(*by, stretch).agg(F.min("commit_ts").alias("_from"), F.max("commit_ts").alias("_to"),
                                              F.count(F.lit(1)).alias("_n"), F.max("seq").alias("_seq"))
    w = Window.partitionBy(*by).orderBy("_stretch")
    pause = F.unix_micros(F.col("_from").cast("timestamp")) - F.unix_micros(F.lag("_to").over(w).cast("timestamp"))
    fresh = F.coalesce(pause >= gap_seconds * 1_000_000, F.lit(True)).cast("int")
    numbered = parts.withColumn("_fresh", fresh).withColumn("_burst", F.sum("_fresh").over(w))
    return (numbered.groupBy(*by, "_burst").agg(F.min("_from").alias("started_at"), F.sum("_n").alias("changes"), F.max("_seq").alias("max_seq"))
            .select("started_at", *by, "changes", "max_seq"))


def activity_stream(changes: DataFrame, gap_seconds: int = 1800, delay: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """:func:`activity` on a stream: a burst is given out once the watermark has passed its end by the gap.

    Spark keeps open bursts as state by table and merges those that late changes join.
    """
    timed, kind = _timed(changes, "commit_ts", delay), changes.schema["commit_ts"].dataType
    w = F.session_window("commit_ts", f"{gap_seconds} seconds")
    return (timed.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("changes"), F.max("seq").alias("max_seq"))
            .select(F.col("w.start").cast(kind).alias("started_at"), *(by or []), "changes", "max_seq"))


def sort_deliveries(changes: DataFrame, path: str, checkpoint: str, keys: list[str], event_time: str = "commit_ts", delay_seconds: int = 3600,
                    interval: str | None = None) -> StreamingQuery:
    """Deal a stream into ``on_time``, ``late`` and ``repeated`` below ``path``; each delivered row is in exactly one of them.

    Late are rows more than ``delay_seconds`` older than the newest row of earlier batches; they are kept with the batch that met them. Of a
    key that came within the delay before, or several times in a batch, the further rows are repeats (a late row is late, whether it
    repeats or not). ``marks`` holds the span of time of each batch, so a batch looks for repeats only in those that reach into the
    delay. A batch that is run again replaces what it wrote.
    """
    spark, gap = changes.sparkSession, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_seconds))

    def folder(name: str, batch_id: int) -> str:
        return f"{path}/{name}/batch_id={batch_id}"

    def deal(batch: DataFrame, batch_id: int) -> None:
        whole = folder("delivered", batch_id)
        batch.write.mode("overwrite").parquet(whole)
        rows = spark.read.schema(batch.schema).parquet(whole)
        span = rows.agg(F.min(event_time).alias("low"), F.max(event_time).alias("high"))
        marks = _read_or_none(spark, f"{path}/marks")
        before = marks.where(F.col("batch_id") < batch_id) if marks is not None else None
        mark = before.agg((F.max("high") - gap).alias("w")).first()["w"] if before is not None else None
        is_late = F.col(event_time) < F.lit(mark) if mark is not None else F.lit(False)
        rows.where(is_late).write.mode("overwrite").parquet(folder("late", batch_id))
        fresh = rows.where(~is_late | is_late.isNull())
        if mark is not None:
            recent = [r["batch_id"] for r in before.where(F.col("high") >= F.lit(mark)).select("batch_id").collect()]  # batches within the delay
            known = spark.read.schema(batch.schema).parquet(*[folder("on_time", n) for n in recent]).where(F.col(event_time) >= F.lit(mark)) if recent else fresh.limit(0)
            known = known.select(*keys, F.lit(True).alias(KNOWN)).distinct()
            fresh = fresh.join(known, [fresh[k].eqNullSafe(known[k]) for k in keys], "left").select(*[fresh[c] for c in fresh.columns], KNOWN)
        else:
            fresh = fresh.withColumn(KNOWN, F.lit(None).cast("boolean"))
        # The first of a batch's rows of a key stays; which one is fixed by their content.
        order = Window.partitionBy(*keys).orderBy(event_time, F.xxhash64(*batch.columns))
        dealt = fresh.withColumn(KNOWN, F.coalesce(F.col(KNOWN), F.row_number().over(order) > 1))
        for name, part in (("on_time", ~F.col(KNOWN)), ("repeated", F.col(KNOWN))):
            dealt.where(part).drop(KNOWN).write.mode("overwrite").parquet(folder(name, batch_id))
        span.where("high is not null").coalesce(1).write.mode("overwrite").parquet(folder("marks", batch_id))

    when = {"processingTime": interval} if interval else {"availableNow": True}
    return changes.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(**when).start()


KNOWN = "__known"


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def delivery_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per batch and outcome of :func:`sort_deliveries`."""
    parts = [spark.read.parquet(f"{path}/{n}").groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count")).select("batch_id", F.lit(n).alias("outcome"), "row_count")
             for n in ("delivered", "on_time", "late", "repeated")]
    return reduce(DataFrame.unionByName, parts)


def key_state(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Running state per key: last sequence and operation, counts by operation, deleted or not.

    A plain aggregation: Spark keeps the state, and a hot key is combined before the shuffle.
    """
    op = F.col("op")
    return changes.groupBy(*keys).agg(
        F.max("seq").alias("last_seq"), F.max_by("op", "seq").alias("last_op"), F.count_if(op == "I").alias("inserts"),
        F.count_if(op == "U").alias("updates"), F.count_if(op == "D").alias("deletes")).withColumn("deleted", F.col("last_op") == "D")


# ---- status, re-check, cutover ------------------------------------------------------------------------------------

def sync_status(spark: SparkSession, query: StreamingQuery, strategy: str, store: str | None = None, seq: str = "seq", table: str = "row_key") -> DataFrame:
    """One row about a query as it stands: running or not, last batch, rows, late rows, error; with ``store`` also the newest position
    and the number of tables (key prefixes after ``:``) in what it has kept."""
    p = query.lastProgress
    error = query.exception()
    row = (strategy, query.isActive, p.batchId if p else None, p.numInputRows if p else None, str(p.timestamp) if p else None,
           sum(s.numRowsDroppedByWatermark for s in p.stateOperators) if p else None, str(error) if error else None)
    out = spark.createDataFrame([row], "strategy string, running boolean, batch_id bigint, input_rows bigint, at string, late_rows bigint, error string")
    if store is None:
        return out
    kept = spark.read.parquet(store).agg(F.max(seq).alias("position"), F.count_distinct(F.substring_index(table, ":", -1)).alias("tables"))
    both = out.unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def save_status(status: DataFrame, path: str) -> None:
    status.withColumn("recorded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def last_status(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != "strategy"]
    return rows.groupBy("strategy").agg(F.max_by(F.struct(*rest), "recorded_at").alias("r")).select("strategy", "r.*")


def stop(query: StreamingQuery, seconds: float = 60.0) -> None:
    """End a query between two batches, or after ``seconds`` in any case; the checkpoint lets it go on later without loss."""
    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()


def recheck_keys(source: DataFrame, target: DataFrame, dirty: DataFrame, keys: list[str], **options) -> DataFrame:
    """State of the dirty keys: missing, extraneous, mismatched or clean."""
    from crossover.operators.validate import diff_rows

    wanted = dirty.select(*keys)  # repeated ones are sorted out behind the shuffles, not in a table of each reading task
    # The joins get stages of their own: in one with the comparison, each task would hold the sorts and tables of all of them at once.
    # Spark would leave out a shuffle by the keys themselves, which the joins have made.
    s, t = (df.join(wanted, keys, "left_semi").repartition(F.xxhash64(*[F.col(f"`{k}`") for k in keys])) for df in (source, target))
    found = diff_rows(s, t, keys, **options).select(*[F.col(f"`{k}`").cast(wanted.schema[k].dataType).alias(k) for k in keys], "status")
    # A repeated key can be missing and mismatched at once; all of its findings count. A key without any is clean.
    every = found.unionByName(wanted.withColumn("status", F.lit(None).cast("string"))).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status"))
    return every.withColumn("status", F.when(F.col("status") == "", "clean").otherwise(F.col("status")))


def continuous_check(changes: DataFrame, source: Callable[[], DataFrame], target: Callable[[], DataFrame], store: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Check again what changed, batch by batch. The newest word on a key counts, so a mended key turns clean."""
    return keep_batches(changes, store, checkpoint, lambda batch: recheck_keys(source(), target(), batch, keys))


def tables_to_recheck(previous: DataFrame, counts_before: DataFrame, counts_now: DataFrame) -> DataFrame:
    """Tables with findings in the last run, and tables whose row count moved since."""
    moved = (counts_before.withColumnRenamed("row_count", "a").join(counts_now.withColumnRenamed("row_count", "b"), "table_name", "full_outer")
             .where(~F.col("a").eqNullSafe(F.col("b"))))
    return previous.where("status <> 'verified'").select("table_name").unionByName(moved.select("table_name")).distinct()


def rounds(spark: SparkSession, tables: list[str], check: Callable[[list[str]], Iterator[DataFrame]], counts: Callable[[], DataFrame], n: int,
           wait: Callable[[int], None] | None = None, seconds: float = 300.0) -> DataFrame:
    """Check all tables, then every ``seconds`` again those with findings or with another row count: a row for each round and table.

    ``check(names)`` yields one summary row per table. What comes to the driver is one row per table and round.
    """
    state, before, out, names = {}, counts(), [], tables
    schema = None
    for i in range(n):
        if i:
            (wait or (lambda _: time.sleep(seconds)))(i)
            now = counts()
            previous = spark.createDataFrame(list(state.values()), schema)
            names = sorted(r["table_name"] for r in tables_to_recheck(previous, before, now).collect())
            before = now
        for frame in check(names):
            schema = frame.schema
            row = frame.first()
            state[row["table_name"]] = row
        out.extend((i, *r) for r in state.values())
    return spark.createDataFrame(out, T.StructType([T.StructField("round", T.IntegerType()), *schema.fields]))


def cutover_ready(lag: DataFrame, summary: DataFrame, most_seconds: float, windows: int = 5) -> DataFrame:
    """Ready when the newest ``windows`` of the lag, over all tables of each, stay below a bound and the check passed. One row."""
    last = lag.groupBy("window_start").agg(F.max("max_lag_seconds").alias("max_lag_seconds")).orderBy(F.desc("window_start")).limit(windows)
    steady = last.agg(F.count(F.lit(1)).alias("windows"), F.max("max_lag_seconds").alias("max_lag_seconds"))
    # Two one-row frames, laid on top of each other rather than joined.
    facts = steady.unionByName(summary.select("passed"), allowMissingColumns=True).agg(
        F.max("windows").alias("windows"), F.max("max_lag_seconds").alias("max_lag_seconds"), F.bool_and("passed").alias("passed"))
    calm = (F.col("windows") >= windows) & (F.col("max_lag_seconds") < most_seconds)
    return facts.select("windows", "max_lag_seconds", "passed", (calm & F.col("passed")).alias("ready"))
