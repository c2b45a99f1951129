"""Change-stream queries: the stream runs until its input is used up, then the kept state is read."""

from pyspark.sql import functions as F

from crossover.operators import validate as v
from crossover.queries.registry import query
from crossover.session import run_folder
from crossover.streaming import changes as ch
from crossover.streaming import status as st
from crossover.streaming import versions as vs

CHANGE_COLUMNS = [
    "event_id as seq", "ts as commit_ts", "concat(cast(user_id as string), ':', event_type) as row_key",
    "case when event_id % 10 = 9 then 'D' when event_id % 10 < 3 then 'I' else 'U' end as op", "value",
    "ts + make_dt_interval(0, 0, 0, event_id % 50) as applied_ts", "event_type as table_name",
]


def stream(f, columns=None):
    return ch.read_changes(f.spark, f.folder, f["events"].schema, glob="events.parquet", columns=columns or CHANGE_COLUMNS)


def run(query_):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("cdc_latest", "changes", sql="""SELECT row_key, max(seq) AS seq, arg_max(commit_ts, seq) AS commit_ts, 'x' AS marker, arg_max(value, seq) AS value
FROM changes GROUP BY 1 HAVING arg_max(op, seq) <> 'D'""")
def cdc_latest(f):
    path = run_folder(f.spark, "apply")
    run(ch.apply_changes(stream(f).select("seq", "commit_ts", "row_key", "op", "value"), f"{path}/rows", f"{path}/checkpoint", ["row_key"]))
    return ch.current_rows(f.spark, f"{path}/rows", ["row_key"]).select("row_key", "seq", "commit_ts", F.lit("x").alias("marker"), "value")


@query("cdc_from_position", "changes", sql="SELECT row_key, max(seq) AS seq FROM changes WHERE seq > 500 GROUP BY 1 HAVING arg_max(op, seq) <> 'D'")
def cdc_from_position(f):
    path = run_folder(f.spark, "apply")
    s = ch.read_changes(f.spark, f.folder, f["events"].schema, start=500, glob="events.parquet", columns=CHANGE_COLUMNS)
    run(ch.apply_changes(s, f"{path}/rows", f"{path}/checkpoint", ["row_key"]))
    return ch.current_rows(f.spark, f"{path}/rows", ["row_key"]).select("row_key", "seq")


@query("cdc_dedupe", "changes", sql="SELECT op, count(*) AS n, sum(seq)::bigint AS seqs FROM changes GROUP BY 1")
def cdc_dedupe(f):
    """Every event is delivered twice and counts once."""
    path = run_folder(f.spark, "dedupe")
    twice = stream(f).unionByName(stream(f))
    run(ch.keep_batches(ch.dedupe_changes(twice, ["row_key", "seq"], delay="365 days").select("row_key", "seq", "op"), f"{path}/rows", f"{path}/checkpoint"))
    return f.spark.read.parquet(f"{path}/rows").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


LAG = """SELECT date_trunc('minute', commit_ts) AS window_start, event_type AS table_name, max(event_id % 50)::double AS max_lag_seconds, max(event_id) AS max_seq, count(*) AS changes
FROM (SELECT *, ts AS commit_ts FROM events) GROUP BY 1, 2"""


@query("cdc_lag", sql=LAG)
def cdc_lag(f):
    path = run_folder(f.spark, "lag")
    run(ch.keep_batches(ch.sync_lag(stream(f), by=["table_name"]), f"{path}/rows", f"{path}/checkpoint", mode="update"))
    return ch.latest_rows(f.spark, f"{path}/rows", ["window_start", "table_name"])


@query("cdc_lag_sliding", sql="""WITH e AS (SELECT *, date_trunc('hour', ts) AS h FROM events), w AS (SELECT *, h - to_hours(unnest(range(0, 3))) AS window_start FROM e)
SELECT window_start, max(event_id % 50)::double AS max_lag_seconds, max(event_id) AS max_seq, count(*) AS changes FROM w GROUP BY 1""")
def cdc_lag_sliding(f):
    path = run_folder(f.spark, "lag")
    run(ch.keep_batches(ch.sync_lag(stream(f), "3 hours", "1 hour"), f"{path}/rows", f"{path}/checkpoint", mode="update"))
    return ch.latest_rows(f.spark, f"{path}/rows", ["window_start"])


@query("cdc_activity", sql="""WITH a AS (SELECT event_id, event_type, ts, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::int AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM a)
SELECT min(ts) AS started_at, event_type AS table_name, count(*) AS changes, max(event_id) AS max_seq FROM b GROUP BY event_type, g""")
def cdc_activity(f):
    return ch.activity(f["events"].selectExpr(*CHANGE_COLUMNS), by=["table_name"])


@query("key_state", "changes", sql="""SELECT row_key, max(seq) AS last_seq, arg_max(op, seq) AS last_op, count(*) FILTER (op = 'I') AS inserts, count(*) FILTER (op = 'U') AS updates,
  count(*) FILTER (op = 'D') AS deletes, arg_max(op, seq) = 'D' AS deleted FROM changes GROUP BY 1""")
def key_state(f):
    path = run_folder(f.spark, "state")
    run(ch.keep_batches(ch.key_state(stream(f), ["row_key"]), f"{path}/rows", f"{path}/checkpoint", mode="update"))
    return ch.latest_rows(f.spark, f"{path}/rows", ["row_key"])


@query("dirty_recheck", "orders_tgt", sql="""WITH p AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extraneous'
  WHEN s.o_totalprice <> t.o_totalprice OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'mismatched' ELSE 'clean' END AS status
  FROM orders s FULL JOIN orders_tgt t ON s.o_orderkey = t.o_orderkey)
SELECT e.event_id AS o_orderkey, coalesce(p.status, 'clean') AS status FROM events e LEFT JOIN p ON p.o_orderkey = e.event_id WHERE e.event_type <> 'click'""")
def dirty_recheck(f):
    path = run_folder(f.spark, "recheck")
    dirty = stream(f, ["event_id as o_orderkey", "event_type"]).where("event_type <> 'click'")
    run(ch.continuous_check(dirty, lambda: f["orders"], lambda: f["orders_tgt"], f"{path}/rows", f"{path}/checkpoint", ["o_orderkey"]))
    return ch.latest_rows(f.spark, f"{path}/rows", ["o_orderkey"])


@query("tables_to_recheck", "orders_tgt", "customer_tgt", "lineitem_tgt", sql="SELECT unnest(['orders', 'customer', 'lineitem']) AS table_name")
def tables_to_recheck(f):
    """Orders had findings; customer and lineitem moved; part is neither."""
    previous = v.diff_summary(f["orders"], f["orders_tgt"], ["o_orderkey"], table="orders").unionByName(
        v.diff_summary(f["part"], f["part"], ["p_partkey"], table="part"))
    before = v.table_counts({n: f[n] for n in ("orders", "customer", "lineitem", "part")})
    now = v.table_counts({"orders": f["orders"], "customer": f["customer_tgt"], "lineitem": f["lineitem_tgt"], "part": f["part"]})
    return ch.tables_to_recheck(previous, before, now)


@query("cutover_ready", "orders_tgt", sql="""WITH l AS (SELECT date_trunc('minute', ts) AS w, max(event_id % 50)::double AS m FROM events GROUP BY 1), t AS (SELECT * FROM l ORDER BY w DESC LIMIT 5)
SELECT count(*) AS windows, max(m) AS max_lag_seconds, false AS passed, false AS ready FROM t UNION ALL SELECT count(*), max(m), true, max(m) < 60 FROM t""")
def cutover_ready(f):
    """Once with a damaged copy and once with a true one."""
    lag = ch.sync_lag(f["events"].selectExpr(*CHANGE_COLUMNS))
    bad = v.check_summary(v.diff_summary(f["orders"], f["orders_tgt"], ["o_orderkey"], table="orders"))
    good = v.check_summary(v.diff_summary(f["orders"], f["orders"], ["o_orderkey"], table="orders"))
    return ch.cutover_ready(lag, bad, 60.0).unionByName(ch.cutover_ready(lag, good, 60.0))


@query("sync_status", sql="SELECT 'files' AS strategy, false AS running, 0::bigint AS batch_id, count(*) AS input_rows, NULL::varchar AS error, max(event_id) AS position, count(DISTINCT event_type) AS tables FROM events")
def sync_status(f):
    path = run_folder(f.spark, "status")
    q = ch.apply_changes(stream(f), f"{path}/rows", f"{path}/checkpoint", ["row_key"])
    run(q)
    ch.save_status(ch.sync_status(f.spark, q, "files", f"{path}/rows"), f"{path}/status")
    return ch.last_status(f.spark, f"{path}/status").select("strategy", "running", "batch_id", "input_rows", "error", "position", "tables")


BASE_SQL = """WITH base AS (SELECT DISTINCT row_key, -1.0::double AS value FROM changes UNION ALL SELECT 'base:' || n_nationkey, n_nationkey::double FROM nation),
last AS (SELECT row_key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM changes GROUP BY 1)
SELECT b.row_key, coalesce(l.value, b.value) AS value FROM base b LEFT JOIN last l USING (row_key) WHERE l.op IS NULL OR l.op <> 'D'"""


def base_rows(f):
    """A snapshot that was loaded in bulk: a row for each key that changes later, and rows that never change."""
    untouched = f["nation"].select(F.concat(F.lit("base:"), F.col("n_nationkey").cast("string")).alias("row_key"), F.col("n_nationkey").cast("double").alias("value"))
    return f["changes"].select("row_key", F.lit(-1.0).alias("value")).distinct().unionByName(untouched)


@query("cdc_over_base", "changes", sql=BASE_SQL)
def cdc_over_base(f):
    path = run_folder(f.spark, "apply")
    run(ch.apply_changes(stream(f).select("seq", "row_key", "op", "value"), f"{path}/rows", f"{path}/checkpoint", ["row_key"]))
    return ch.current_rows(f.spark, f"{path}/rows", ["row_key"], base=base_rows(f)).select("row_key", "value")


@query("cdc_fold", "changes", sql=BASE_SQL)
def cdc_fold(f):
    """Two versions of the snapshot: one after the first half of the changes, the next out of it and the rest."""
    path, keys, half = run_folder(f.spark, "fold"), ["row_key"], F.col("seq") % 2
    for i, part in enumerate((half == 0, half == 1)):
        run(ch.apply_changes(stream(f).select("seq", "row_key", "op", "value").where(part), f"{path}/rows-{i}", f"{path}/checkpoint-{i}", keys))
    ch.fold(f.spark, ch.as_changes(base_rows(f)), f"{path}/rows-0", f"{path}/version-1", keys)
    ch.fold(f.spark, f.spark.read.parquet(f"{path}/version-1"), f"{path}/rows-1", f"{path}/version-2", keys)
    return f.spark.read.parquet(f"{path}/version-2").where("op <> 'D'").select("row_key", "value")


@query("continuous_rounds", "orders_tgt", "customer_tgt", sql="""SELECT 0 AS round, 'orders' AS table_name, 'issues_found' AS status UNION ALL SELECT 0, 'customer', 'issues_found' UNION ALL SELECT 0, 'part', 'verified'
UNION ALL SELECT 1, 'orders', 'verified' UNION ALL SELECT 1, 'customer', 'issues_found' UNION ALL SELECT 1, 'part', 'verified'
UNION ALL SELECT 2, 'orders', 'verified' UNION ALL SELECT 2, 'customer', 'verified' UNION ALL SELECT 2, 'part', 'verified'""")
def continuous_rounds(f):
    """Orders are mended before the second round and customers before the third; part is looked at once."""
    keys, now = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}, {"orders": "orders_tgt", "customer": "customer_tgt", "part": "part"}

    def check(names):
        for n in names:
            yield v.diff_summary(f[n], f[now[n]], [keys[n]], table=n)

    def between(i):
        now["orders" if i == 1 else "customer"] = "orders" if i == 1 else "customer"

    found = ch.rounds(f.spark, list(keys), check, lambda: v.table_counts({n: f[t] for n, t in now.items()}), 3, wait=between)
    return found.select("round", "table_name", "status")


def followed(f, name, changes, base, folds=()):
    """A bucket table over ``base`` that took in ``changes`` (a batch frame) as a stream of three files, with a fold after some of them."""
    path = run_folder(f.spark, name)
    table = vs.BucketTable(f.spark, f"{path}/table", ["row_key"], buckets=64)
    table.create(base)
    for i in range(3):
        changes.where(F.col("seq") % 3 == i).write.mode("append").parquet(f"{path}/log")
        run(table.follow(ch.read_changes(f.spark, f"{path}/log", changes.schema), f"{path}/checkpoint"))
        if i in folds:
            table.fold()
    return table


def value_changes(f):
    return f["events"].selectExpr(*CHANGE_COLUMNS).select("seq", "row_key", "op", "value")


@query("cdc_bucket_versions", "changes", sql=BASE_SQL)
def cdc_bucket_versions(f):
    """Two versions and a batch after the second."""
    return followed(f, "versions", value_changes(f), base_rows(f), folds=(0, 1)).current().select("row_key", "value")


@query("cdc_bucket_sums", "changes", sql=f"WITH r AS ({BASE_SQL}) SELECT count(*) AS row_count, true AS same FROM r")
def cdc_bucket_sums(f):
    """Checksums kept up by changes against those over the rows."""
    table = followed(f, "sums", value_changes(f), base_rows(f), folds=(1,))
    rows = table.current()
    fresh = v.bucket_checksums(rows, ["row_key"], 64).select("bucket", F.struct("row_count", "hash_xor", "hash_sum").alias("fresh"))
    kept = table.sums().where("row_count <> 0").select("bucket", F.col("row_count").alias("n"), F.struct("row_count", "hash_xor", "hash_sum").alias("kept"))
    return kept.join(fresh, "bucket", "full_outer").agg(F.sum("n").alias("row_count"), F.bool_and(F.coalesce(F.col("kept") == F.col("fresh"), F.lit(False))).alias("same"))


@query("cdc_bucket_check", "changes", sql="""WITH s AS (SELECT row_key, arg_max(value, seq) AS value FROM changes GROUP BY 1 HAVING arg_max(op, seq) <> 'D'),
t AS (SELECT row_key, arg_max(value, seq) AS value FROM changes WHERE seq % 101 <> 0 GROUP BY 1 HAVING arg_max(op, seq) <> 'D')
SELECT row_key, CASE WHEN t.row_key IS NULL THEN 'missing' WHEN s.row_key IS NULL THEN 'extraneous' ELSE 'mismatched' END AS status, 1::bigint AS row_count
FROM s FULL JOIN t USING (row_key) WHERE s.row_key IS NULL OR t.row_key IS NULL OR s.value IS DISTINCT FROM t.value""")
def cdc_bucket_check(f):
    """The target lost some changes; only buckets whose checksums differ are read."""
    every, none = value_changes(f), base_rows(f).limit(0)
    return vs.check_round(followed(f, "source", every, none, folds=(1,)), followed(f, "target", every.where("seq % 101 <> 0"), none))


@query("cdc_from_position_pruned", "changes", sql="""WITH l AS (SELECT * FROM changes WHERE seq > 500 AND seq < 900000)
SELECT row_key, max(seq) AS seq FROM l GROUP BY 1 HAVING arg_max(op, seq) <> 'D'""")
def cdc_from_position_pruned(f):
    """A log in folders of 250 positions, opened from the folder of the start position on."""
    path = run_folder(f.spark, "log")
    changes = value_changes(f)
    ch.write_log(changes.where("seq < 900000"), f"{path}/log", 250)
    s = ch.read_changes(f.spark, f"{path}/log", changes.schema, start=500, span=250)
    run(ch.apply_changes(s, f"{path}/rows", f"{path}/checkpoint", ["row_key"]))
    return ch.current_rows(f.spark, f"{path}/rows", ["row_key"]).select("row_key", "seq")


@query("cdc_activity_stream", sql="""WITH a AS (SELECT event_id, event_type, ts, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::int AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM a)
SELECT min(ts) AS started_at, event_type AS table_name, count(*) AS changes, max(event_id) AS max_seq FROM b GROUP BY event_type, g""")
def cdc_activity_stream(f):
    """All bursts of the events; a last event of its own, long after them, lets the watermark pass."""
    path = run_folder(f.spark, "activity")
    events = f["events"].selectExpr(*CHANGE_COLUMNS).select("seq", "commit_ts", "table_name")
    later = events.agg(F.lit(-1).cast("bigint").alias("seq"), (F.max("commit_ts") + F.expr("interval 2 days")).alias("commit_ts"), F.lit("end").alias("table_name"))
    for part in (events, later):
        part.write.mode("append").parquet(f"{path}/log")
        bursts = ch.activity_stream(ch.read_changes(f.spark, f"{path}/log", events.schema), by=["table_name"])
        run(ch.keep_batches(bursts, f"{path}/rows", f"{path}/checkpoint"))
    return f.spark.read.parquet(f"{path}/rows").where("table_name <> 'end'").select("started_at", "table_name", "changes", "max_seq")


@query("cdc_deliveries", sql="""WITH d AS (SELECT event_id AS seq, ts, event_id % 4 AS part FROM events UNION ALL SELECT event_id, ts, 3 FROM events WHERE event_id % 10 = 0),
mark AS (SELECT max(ts) FILTER (part < 3) - INTERVAL 1 HOUR AS w FROM d),
x AS (SELECT d.*, part = 3 AND ts < w AS late FROM d, mark), on_time AS (SELECT DISTINCT seq FROM x WHERE NOT late)
SELECT 'delivered' AS outcome, count(*) AS row_count FROM d UNION ALL SELECT 'late', count(*) FILTER (late) FROM x
UNION ALL SELECT 'on_time', count(*) FROM on_time UNION ALL SELECT 'repeated', count(*) FILTER (NOT late) - (SELECT count(*) FROM on_time) FROM x""")
def cdc_deliveries(f):
    """Two batches: three quarters of the events, then the rest with a tenth of all events once more."""
    path = run_folder(f.spark, "deliveries")
    events = f["events"].selectExpr(*CHANGE_COLUMNS).select("seq", "commit_ts", "row_key", "op", "value")
    first, second = events.where("seq % 4 < 3"), events.where("seq % 4 = 3").unionByName(events.where("seq % 10 = 0"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{path}/log")
        run(ch.sort_deliveries(ch.read_changes(f.spark, f"{path}/log", events.schema), f"{path}/out", f"{path}/checkpoint", ["seq"]))
    return ch.delivery_counts(f.spark, f"{path}/out").groupBy("outcome").agg(F.sum("row_count").alias("row_count")).unionByName(
        f.spark.createDataFrame([(n, 0) for n in ("delivered", "on_time", "late", "repeated")], "outcome string, row_count bigint")).groupBy("outcome").agg(F.sum("row_count").alias("row_count"))


@query("sync_positions", sql="SELECT event_type AS table_name, max(event_id) AS position, max(event_id % 50)::double AS lag_seconds, count(*) AS row_count FROM events GROUP BY 1")
def sync_positions(f):
    """Position and lag by table, as the query's own progress events told them."""
    path = run_folder(f.spark, "status")
    changes = f["events"].selectExpr(*CHANGE_COLUMNS)
    tables = sorted(r["table_name"] for r in changes.select("table_name").distinct().collect())
    log = st.StatusLog(f.spark, f"{path}/status", tables, names=["follow"])
    f.spark.streams.addListener(log)
    try:
        q = st.measured(stream(f), tables).writeStream.queryName("follow").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={n}")).option(
            "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        run(q)
        f.spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # events are told after the query has ended
    finally:
        f.spark.streams.removeListener(log)
    return st.positions(st.read_status(f.spark, f"{path}/status")).drop("query")
