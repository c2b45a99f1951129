"""Positions, late rows, bursts and status of streams."""

import time

import pytest
from pyspark.sql import functions as F

from crossover.streaming import changes as ch
from crossover.streaming import status as st
from tests.conftest import rows

SCHEMA = "seq bigint, commit_ts timestamp, k string"


def done(query):
    query.awaitTermination()
    return query


def test_log_is_opened_from_the_start_position(spark, tmp_path):
    log = str(tmp_path / "log")
    changes = spark.range(1000).select(F.col("id").alias("seq"), F.lit("x").alias("k"))
    ch.write_log(changes, log, 100)
    s = ch.read_changes(spark, log, changes.schema, start=549, span=100)
    q = done(ch.keep_batches(s, str(tmp_path / "rows"), str(tmp_path / "cp")))
    assert sum(p["numInputRows"] for p in q.recentProgress) == 500  # folders 0 to 4 were not opened
    ch.write_log(changes.where("seq < 20").withColumn("seq", F.col("seq") + 1000), log, 100)
    q = done(ch.keep_batches(ch.read_changes(spark, log, changes.schema, start=549, span=100), str(tmp_path / "rows"), str(tmp_path / "cp")))
    assert sum(p["numInputRows"] for p in q.recentProgress) == 20
    assert spark.read.parquet(str(tmp_path / "rows")).agg(F.min("seq"), F.max("seq"), F.count("*")).first()[:] == (550, 1019, 470)


def test_late_and_repeated_rows_are_kept_apart(spark, tmp_path):
    path, log = str(tmp_path / "out"), str(tmp_path / "log")
    batches = [[(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 12:00:00", "b"), (2, "2024-01-01 12:00:00", "b")],
               [(3, "2024-01-01 10:30:00", "late"), (1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 12:00:00", "b"), (4, "2024-01-01 11:30:00", "c"), (5, None, "d")],
               [(4, "2024-01-01 11:30:00", "c"), (6, "2024-01-01 11:00:00", "edge")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "seq bigint, t string, k string").select("seq", F.col("t").cast("timestamp").alias("commit_ts"), "k").coalesce(1).write.mode("append").parquet(log)
        stream = ch.read_changes(spark, log, spark.createDataFrame([], SCHEMA).schema)
        assert done(ch.sort_deliveries(stream, path, str(tmp_path / "cp"), ["seq"])).exception() is None
    got = {n: rows(spark.read.parquet(f"{path}/{n}").select("seq", "batch_id")) for n in ("on_time", "late", "repeated")}
    assert got == {"on_time": [(1, 0), (2, 0), (4, 1), (5, 1), (6, 2)], "late": [(1, 1), (3, 1)], "repeated": [(2, 0), (2, 1), (4, 2)]}
    counts = {r["outcome"]: r["n"] for r in ch.delivery_counts(spark, path).groupBy("outcome").agg(F.sum("row_count").alias("n")).collect()}
    assert counts["delivered"] == counts["on_time"] + counts["late"] + counts["repeated"] == 10


def test_bursts_on_a_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    at = F.timestamp_seconds(F.col("id") * 300 + F.when(F.col("id") % 40 < 20, 0).otherwise(1800))
    changes = spark.range(300).select(F.col("id").alias("seq"), at.alias("commit_ts"), (F.col("id") % 2).alias("t"))
    end = changes.agg(F.lit(-1).cast("bigint").alias("seq"), F.expr("max(commit_ts) + interval 3 days").alias("commit_ts"), F.lit(9).cast("bigint").alias("t"))
    for part in (changes.where("seq % 3 = 0 and seq < 250"), changes.where("seq % 3 <> 0 or seq >= 250"), end):
        part.coalesce(1).write.mode("append").parquet(log)
        s = ch.activity_stream(ch.read_changes(spark, log, changes.schema), 900, "1 day", ["t"])
        done(ch.keep_batches(s, str(tmp_path / "rows"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "rows")).drop("batch_id")
    assert rows(got) == rows(ch.activity(changes, 900, ["t"])) and got.count() > 10


def test_status_of_a_query_that_fails(spark, tmp_path):
    path = str(tmp_path / "status")
    log = st.StatusLog(spark, path, ["a", "b", "none"], ["s"])
    spark.range(10).select(F.col("id").alias("seq"), F.when(F.col("id") < 4, "a").otherwise("b").alias("table_name"), F.timestamp_seconds("id").alias("commit_ts"),
                           F.timestamp_seconds(F.col("id") + 2).alias("applied_ts")).coalesce(1).write.parquet(str(tmp_path / "log"))
    schema = spark.read.parquet(str(tmp_path / "log")).schema

    def sink(batch, n):
        batch.count()
        if n == 1:
            raise RuntimeError("broken")

    spark.streams.addListener(log)
    try:
        for _ in range(2):
            s = st.measured(ch.read_changes(spark, str(tmp_path / "log"), schema), ["a", "b", "none"])
            q = s.writeStream.queryName("s").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            except Exception as e:
                assert "broken" in str(e)
            spark.read.parquet(str(tmp_path / "log")).withColumn("seq", F.col("seq") + 100).write.mode("append").parquet(str(tmp_path / "log2"))
            spark.read.parquet(str(tmp_path / "log2")).limit(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
    finally:
        spark.streams.removeListener(log)
    status = st.read_status(spark, path)
    last = st.latest_status(status).first()
    assert last["event"] == "failed" and not last["running"] and "broken" in last["error"] and last["batch_id"] == 0 and last["input_rows"] == 10
    assert rows(st.positions(status)) == [("s", "a", 3, 2.0, 4), ("s", "b", 9, 2.0, 6)]


def test_recheck_joins_apart_from_the_comparison(spark, capsys):
    """No task holds the tables of several joins and of the comparison, and none a table of all dirty keys that it reads."""
    source = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (5, "e")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, "d"), (5, "e")], "k int, v string")
    dirty = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,), (9,)], "k int")
    out = ch.recheck_keys(source, target, dirty, ["k"])
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(xxhash64(") == 2 and "HashAggregate(keys=[k#" not in plan.replace("ObjectHashAggregate", "")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "clean"), (2, "missing"), (3, "mismatched"), (4, "extraneous"), (9, "clean"), (None, "clean")]
