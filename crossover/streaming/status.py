"""Status of running queries, written by Spark's own progress events: position and lag by table, uptime, errors."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "follow"
STATUS = ("query string, event string, at timestamp, started_at timestamp, uptime_seconds double, batch_id bigint, input_rows bigint, rows_per_second double, late_rows bigint, "
          "tables array<struct<table_name: string, position: bigint, lag_seconds: double, row_count: bigint>>, error string")


def measured(changes: DataFrame, tables: list[str], table: str = "table_name", seq: str = "seq", committed: str = "commit_ts", applied: str = "applied_ts") -> DataFrame:
    """``changes`` with position, lag and row count of each table observed on the way; goes before aggregations."""
    lag = (F.unix_micros(F.col(applied).cast("timestamp")) - F.unix_micros(F.col(committed).cast("timestamp"))) / 1e6
    figures = []
    for i, name in enumerate(tables):
        mine = F.col(table) == name
        figures += [F.max(F.when(mine, F.col(seq))).alias(f"position_{i}"), F.max(F.when(mine, lag)).alias(f"lag_{i}"), F.count_if(mine).alias(f"rows_{i}")]
    return changes.observe(METRICS, *figures)


class StatusLog(StreamingQueryListener):
    """Appends a line to the folder for each batch, start and end of the session's queries of ``names`` (all named ones without it).

    Lines are files of their own, made through the file system rather than by Spark jobs, so that the log never waits for the cluster.
    """

    def __init__(self, spark: SparkSession, path: str, tables: list[str], names: list[str] | None = None):
        self.spark, self.path, self.tables, self.names, self.queries = spark, path, tables, names, {}

    def _write(self, run_id, event: str, at: datetime.datetime, **more) -> None:
        name, started = self.queries.get(str(run_id), (None, None))
        if name is None or self.names is not None and name not in self.names:
            return
        line = {"query": name, "event": event, "at": at.isoformat(), "started_at": started.isoformat(), "uptime_seconds": (at - started).total_seconds(), **more}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False)
        out.write(bytearray((json.dumps(line) + "\n").encode()))
        out.close()

    def onQueryStarted(self, event) -> None:
        at = _time(event.timestamp)
        self.queries[str(event.runId)] = (event.name, at)
        self._write(event.runId, "started", at)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(METRICS)
        figures = seen.asDict() if seen is not None else {}
        tables = [{"table_name": t, "position": figures.get(f"position_{i}"), "lag_seconds": figures.get(f"lag_{i}"), "row_count": figures.get(f"rows_{i}")}
                  for i, t in enumerate(self.tables) if figures.get(f"rows_{i}")]
        self._write(p.runId, "batch", datetime.datetime.now(datetime.timezone.utc), batch_id=p.batchId, input_rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond,
                    late_rows=sum(s.numRowsDroppedByWatermark for s in p.stateOperators), tables=tables)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write(event.runId, "failed" if event.exception else "ended", datetime.datetime.now(datetime.timezone.utc), error=event.exception)


def _time(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS).json(path)


def latest_status(log: DataFrame) -> DataFrame:
    """Per query how it stands: state, uptime, last batch, all rows, the last error."""
    last = log.groupBy("query").agg(F.max_by("event", F.struct("at", "event")).alias("event"), F.max("at").alias("at"), F.max_by("uptime_seconds", "at").alias("uptime_seconds"),
                                    F.max("batch_id").alias("batch_id"), F.sum("input_rows").alias("input_rows"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"))
    return last.withColumn("running", ~F.col("event").isin("ended", "failed"))


def positions(log: DataFrame) -> DataFrame:
    """Per query and table the newest position, the lag of the last batch that had rows of it, and its rows."""
    t = log.select("query", "at", F.explode("tables").alias("t"))
    return t.groupBy("query", F.col("t.table_name").alias("table_name")).agg(F.max("t.position").alias("position"), F.max_by("t.lag_seconds", "at").alias("lag_seconds"), F.sum("t.row_count").alias("row_count"))
