"""Validation queries over the driver tables and damaged copies of them."""

from functools import reduce

from pyspark.sql import functions as F

from crossover.functions.comparing import comparable
from crossover.operators import ranges as rg
from crossover.operators import validate as v
from crossover.plans import runs
from crossover.plans.check import check, run_check
from crossover.queries.registry import query
from crossover.session import run_folder

ORDER_COLUMNS = "o_orderkey, o_custkey, trim(o_orderstatus) as o_orderstatus, o_totalprice, o_orderdate, trim(o_orderpriority) as o_orderpriority"

# Per key: source and target rows side by side, NULL-safe.
ORDER_PAIRS = f"""
s AS (SELECT {ORDER_COLUMNS} FROM orders), t AS (SELECT {ORDER_COLUMNS} FROM orders_tgt),
pairs AS (
  SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
         CASE WHEN t.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extraneous'
              WHEN s.o_custkey IS DISTINCT FROM t.o_custkey OR s.o_orderstatus IS DISTINCT FROM t.o_orderstatus
                OR s.o_totalprice IS DISTINCT FROM t.o_totalprice OR s.o_orderdate IS DISTINCT FROM t.o_orderdate
                OR s.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'mismatched' ELSE 'matched' END AS status
  FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)"""

SUMMARY_COLUMNS = """
count(*) FILTER (status <> 'extraneous') AS source_rows, count(*) FILTER (status <> 'missing') AS target_rows,
count(*) FILTER (status = 'matched') AS rows_matching, count(*) FILTER (status = 'missing') AS rows_missing,
count(*) FILTER (status = 'mismatched') AS rows_mismatched, count(*) FILTER (status = 'extraneous') AS rows_extraneous,
CASE WHEN count(*) FILTER (status <> 'matched') = 0 THEN 'verified' ELSE 'issues_found' END AS status"""


def source_tables(f):
    return {n: f[n] for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")}


def target_tables(f):
    return {"region": f["region"], "nation": f["nation"], "customer": f["customer_tgt"], "part": f["part"],
            "orders": f["orders_tgt"], "lineitem": f["lineitem_tgt"], "documents": f["documents_tgt"],
            "events": f["events"]}


COUNT_ORACLE = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}"
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")
) + "), t AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {r}"
    for n, r in (("region", "region"), ("nation", "nation"), ("customer", "customer_tgt"), ("part", "part"),
                 ("orders", "orders_tgt"), ("lineitem", "lineitem_tgt"), ("documents", "documents_tgt"), ("events", "events"))
) + """), counts AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, s.row_count AS source_count,
  t.row_count AS target_count FROM s FULL JOIN t ON s.table_name = t.table_name) """


@query("check_tables", "cat_tables", sql="""
WITH s AS (SELECT source_id, schema_name, table_name FROM cat_tables WHERE table_type = 'BASE TABLE' AND NOT is_temporal),
t AS (SELECT source_id, schema_name, table_name FROM cat_tables WHERE NOT is_memory_optimized)
SELECT *, 'missing_on_target' AS issue FROM (SELECT * FROM s EXCEPT SELECT * FROM t)
UNION ALL SELECT *, 'extra_on_target' AS issue FROM (SELECT * FROM t EXCEPT SELECT * FROM s)""")
def check_tables(f):
    t = f["cat_tables"]
    return v.compare_tables(t.where("table_type = 'BASE TABLE' and not is_temporal"), t.where("not is_memory_optimized"),
                            ["source_id", "schema_name", "table_name"])


@query("check_counts", "customer_tgt", "orders_tgt", "lineitem_tgt", "documents_tgt", sql=COUNT_ORACLE + """
SELECT table_name, source_count, target_count, target_count - source_count AS delta,
  (target_count - source_count) * 100.0::double / source_count AS delta_pct,
  coalesce(source_count = target_count, false) AS matches FROM counts""")
def check_counts(f):
    return v.compare_counts(v.table_counts(source_tables(f)), v.table_counts(target_tables(f)), ["table_name"])


@query("count_bands", "customer_tgt", "orders_tgt", "lineitem_tgt", "documents_tgt", sql=COUNT_ORACLE + """
SELECT table_name, source_count, target_count,
  CASE WHEN source_count IS NULL THEN 'absent_on_source' WHEN target_count IS NULL THEN 'absent_on_target'
       WHEN source_count = target_count THEN 'count_verified'
       WHEN abs(target_count - source_count) * 100 <= source_count THEN 'within_tolerance'
       WHEN abs(target_count - source_count) * 20 <= source_count THEN 'reload_table' ELSE 'investigate_load' END AS band
FROM counts""")
def count_bands(f):
    counts = v.compare_counts(v.table_counts(source_tables(f)), v.table_counts(target_tables(f)), ["table_name"])
    return v.count_bands(counts.select("table_name", "source_count", "target_count"))


@query("check_columns", "cat_columns", sql="""
WITH s AS (SELECT source_id, schema_name, table_name, column_name, data_type FROM cat_columns WHERE NOT is_filestream),
t AS (SELECT source_id, schema_name, table_name, column_name,
        CASE WHEN max_length % 7 = 0 THEN 'BIGINT' ELSE upper(data_type) END AS data_type FROM cat_columns
      WHERE NOT is_computed AND table_name NOT LIKE '%7'),
p AS (SELECT coalesce(s.source_id, t.source_id) AS source_id, coalesce(s.schema_name, t.schema_name) AS schema_name,
        coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.column_name, t.column_name) AS column_name,
        s.data_type AS source_type, t.data_type AS target_type
      FROM s FULL JOIN t ON s.source_id = t.source_id AND s.schema_name = t.schema_name AND s.table_name = t.table_name
        AND s.column_name = t.column_name)
SELECT * FROM (SELECT source_id, schema_name, table_name, column_name, source_type, target_type,
  CASE WHEN target_type IS NULL THEN 'missing_column' WHEN source_type IS NULL THEN 'extra_column'
       WHEN lower(source_type) <> lower(target_type) THEN
         CASE WHEN source_type = 'tinyint' AND lower(target_type) = 'bigint' THEN 'conditional_match' ELSE 'column_type' END
  END AS issue FROM p
  WHERE (source_id, schema_name, table_name) IN (SELECT (source_id, schema_name, table_name) FROM s)
    AND (source_id, schema_name, table_name) IN (SELECT (source_id, schema_name, table_name) FROM t))
WHERE issue IS NOT NULL""")
def check_columns(f):
    c = f["cat_columns"].select("source_id", "schema_name", "table_name", "column_name", "data_type", "max_length",
                                "is_filestream", "is_computed")
    s = c.where("not is_filestream").drop("max_length")
    t = c.where("not is_computed and table_name not like '%7'").withColumn(
        "data_type", F.when(F.col("max_length") % 7 == 0, "BIGINT").otherwise(F.upper("data_type")))
    pairs = f.spark.createDataFrame([("TINYINT", "bigint")], "source_type string, target_type string")
    return v.compare_columns(s, t, ["source_id", "schema_name", "table_name"], pairs)


@query("diff_rows", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT o_orderkey, status, 1::bigint AS row_count FROM pairs WHERE status <> 'matched'""")
def diff_rows(f):
    return v.diff_rows(f["orders"], f["orders_tgt"], ["o_orderkey"])


@query("diff_rows_digest", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT o_orderkey, status, 1::bigint AS row_count FROM pairs WHERE status <> 'matched'""")
def diff_rows_digest(f):
    return v.diff_rows(f["orders"], f["orders_tgt"], ["o_orderkey"], digest=True)


@query("diff_ranges", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT o_orderkey, status, 1::bigint AS row_count FROM pairs WHERE status <> 'matched'""")
def diff_ranges(f):
    """By key ranges, refined twice at this size."""
    return rg.diff_ranges(f["orders"], f["orders_tgt"], ["o_orderkey"], fan=8, leaf_rows=2000).rows


@query("diff_ranges_composite", "lineitem_tgt", sql="""
WITH s AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey % 50 <> 7 OR l_orderkey > 300 GROUP BY 1, 2), t AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, 'extraneous' AS status, t.n - coalesce(s.n, 0) AS row_count FROM t LEFT JOIN s USING (l_orderkey, l_linenumber) WHERE t.n <> coalesce(s.n, 0)""")
def diff_ranges_composite(f):
    """Damage in one corner of the key: the second level reads little."""
    lost = f["lineitem"].where("l_orderkey % 50 <> 7 or l_orderkey > 300")
    return rg.diff_ranges(lost, f["lineitem"], ["l_orderkey", "l_linenumber"], fan=16, leaf_rows=200).rows


@query("diff_rows_repeated_keys", "lineitem_tgt", sql="""
WITH u AS (SELECT *, 1 AS w FROM lineitem UNION ALL SELECT *, -1 AS w FROM lineitem_tgt),
g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
        l_linestatus, l_shipdate, sum(w) AS w FROM u GROUP BY ALL HAVING sum(w) <> 0),
k AS (SELECT l_orderkey, l_linenumber, sum(greatest(w, 0)) AS a, sum(greatest(-w, 0)) AS b FROM g GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, 'missing' AS status, (a - least(a, b))::bigint AS row_count FROM k WHERE a > b
UNION ALL SELECT l_orderkey, l_linenumber, 'extraneous', (b - least(a, b))::bigint FROM k WHERE b > a
UNION ALL SELECT l_orderkey, l_linenumber, 'mismatched', least(a, b)::bigint FROM k WHERE least(a, b) > 0""")
def diff_rows_repeated_keys(f):
    return v.diff_rows(f["lineitem"], f["lineitem_tgt"], ["l_orderkey", "l_linenumber"])


@query("diff_documents", "documents_tgt", sql="""
SELECT coalesce(s.doc_id, t.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL THEN 'missing' ELSE 'mismatched' END AS status,
  1::bigint AS row_count
FROM documents s LEFT JOIN documents_tgt t ON s.doc_id = t.doc_id WHERE t.doc_id IS NULL OR s.text <> t.text""")
def diff_documents(f):
    return v.diff_rows(f["documents"], f["documents_tgt"], ["doc_id"], trim=False)


@query("diff_cells", "orders_tgt", sql=f"""WITH {ORDER_PAIRS},
m AS (SELECT s.*, t.o_totalprice AS t_price, t.o_orderpriority AS t_priority
      FROM pairs JOIN s USING (o_orderkey) JOIN t USING (o_orderkey) WHERE status = 'mismatched')
SELECT o_orderkey, 'o_totalprice' AS column_name, round(o_totalprice, 2) AS source_number, round(t_price, 2) AS target_number,
  NULL AS source_text, NULL AS target_text FROM m WHERE o_totalprice IS DISTINCT FROM t_price
UNION ALL SELECT o_orderkey, 'o_orderpriority', NULL, NULL, o_orderpriority, t_priority
  FROM m WHERE o_orderpriority IS DISTINCT FROM t_priority""")
def diff_cells(f):
    cells = v.diff_cells(f["orders"], f["orders_tgt"], ["o_orderkey"])
    # Numbers as numbers again, since engines print doubles in different ways.
    number = F.col("column_name") == "o_totalprice"
    values = [F.when(number, F.round(F.col(f"{x}_value").cast("double"), 2)).alias(f"{x}_number") for x in ("source", "target")]
    return cells.select("o_orderkey", "column_name", *values, *[F.when(~number, F.col(f"{x}_value")).alias(f"{x}_text") for x in ("source", "target")])


@query("diff_summary", "orders_tgt", sql=f"WITH {ORDER_PAIRS} SELECT 'orders' AS table_name, {SUMMARY_COLUMNS} FROM pairs")
def diff_summary(f):
    return v.diff_summary(f["orders"], f["orders_tgt"], ["o_orderkey"], table="orders")


@query("diff_sampled", "orders_tgt", sql="SELECT true AS within_full_diff, true AS share_is_near, true AS same_keys_on_both_sides")
def diff_sampled(f):
    """A sampled diff is part of the full one, of about the asked size; int and bigint keys choose alike."""
    key = ["o_orderkey"]
    s, t = v.sample_keys(f["orders"], key, 0.1), v.sample_keys(f["orders_tgt"], key, 0.1)
    part = v.diff_rows(s, t, key).select(*key, "status", F.lit(1).alias("p"))
    full = v.diff_rows(f["orders"], f["orders_tgt"], key).select(*key, "status", F.lit(1).alias("f"))
    within = part.join(full, [*key, "status"], "left").agg(F.count_if(F.col("f").isNull()).alias("outside"))
    share = f["orders"].agg(F.count("*").alias("n")).unionByName(s.agg(F.count("*").alias("m")), allowMissingColumns=True).agg((F.max("m") / F.max("n")).alias("share"))
    narrow = v.sample_keys(f["orders"].select(F.col("o_orderkey").cast("int").alias("o_orderkey")), key, 0.1)
    odd = narrow.select(F.col("o_orderkey").cast("long"), F.lit(1).alias("w")).union(s.select("o_orderkey", F.lit(-1))).groupBy("o_orderkey").agg(F.sum("w").alias("w")).agg(F.count_if(F.col("w") != 0).alias("odd"))
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [within, share, odd]).agg(F.max("outside").alias("outside"), F.max("share").alias("share"), F.max("odd").alias("odd"))
    return facts.select((F.col("outside") == 0).alias("within_full_diff"), F.col("share").between(0.05, 0.15).alias("share_is_near"), (F.col("odd") == 0).alias("same_keys_on_both_sides"))


@query("diff_shards", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT o_orderkey, status, 1::bigint AS row_count FROM pairs WHERE status <> 'matched'""")
def diff_shards(f):
    return v.diff_shards(f["orders"], f["orders_tgt"], ["o_orderkey"], buckets=4096)


# ---- the same tables with other types: what a migration makes of them ------------------------------------------------

def widened(df):
    """Target types: text keys padded, integers as decimals, doubles as decimals, timestamps without a zone."""
    return df.select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"), F.lit("   ")).alias("key"), F.col("o_custkey").cast("decimal(20,0)").alias("cust"),
                     "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"),
                     F.col("o_orderpriority"), (F.col("o_orderkey") % 2).cast("smallint").alias("odd"))


def native(df):
    return df.select(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_custkey").cast("int").alias("cust"), "o_orderstatus",
                     F.col("o_totalprice").cast("decimal(10,2)").alias("price"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority"),
                     (F.col("o_orderkey") % 2 == 1).alias("odd"))


WIDENED_SQL = f"""WITH {ORDER_PAIRS} SELECT 'k' || o_orderkey AS key, status, 1::bigint AS row_count FROM pairs WHERE status <> 'matched'"""


@query("diff_rows_widened", "orders_tgt", sql=WIDENED_SQL)
def diff_rows_widened(f):
    return v.diff_rows(native(f["orders"]), widened(f["orders_tgt"]), ["key"])


@query("diff_shards_widened", "orders_tgt", sql=WIDENED_SQL)
def diff_shards_widened(f):
    return v.diff_shards(native(f["orders"]), widened(f["orders_tgt"]), ["key"], buckets=4096)


@query("diff_multiset_widened", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT status, count(*) AS row_count, count(DISTINCT key) AS keys FROM (
  SELECT 'k' || o_orderkey AS key, 'missing' AS status FROM pairs WHERE status IN ('missing', 'mismatched')
  UNION ALL SELECT 'k' || o_orderkey, 'extraneous' FROM pairs WHERE status IN ('extraneous', 'mismatched')) GROUP BY 1""")
def diff_multiset_widened(f):
    found = v.diff_multiset(native(f["orders"]), widened(f["orders_tgt"]))
    return found.groupBy("status").agg(F.sum("copies").alias("row_count"), F.count_distinct("key").alias("keys"))


@query("compare_checksums_widened", "orders_tgt", sql="""SELECT 'orders' AS table_name, 'checksum' AS issue, (SELECT count(*) FROM orders) AS source_count,
  (SELECT count(*) FROM orders_tgt) AS target_count WHERE EXISTS ((SELECT o_orderkey, o_totalprice FROM orders EXCEPT SELECT o_orderkey, o_totalprice FROM orders_tgt))""")
def compare_checksums_widened(f):
    """A damaged copy and a true one, both with other types."""
    def sums(target):
        s, t, _ = comparable(native(f["orders"]), widened(target))
        return s, t

    (s1, t1), (s2, t2) = sums(f["orders_tgt"]), sums(f["orders"])
    source = v.table_checksum(s1, table="orders").unionByName(v.table_checksum(s2, table="orders_true"))
    target = v.table_checksum(t1, table="orders").unionByName(v.table_checksum(t2, table="orders_true"))
    return v.compare_checksums(source, target, ["table_name"])


@query("diff_cells_keys", "orders_tgt", sql="SELECT 0::bigint AS only_in_rows, 0::bigint AS only_in_cells")
def diff_cells_keys(f):
    """Rows and cells name the same mismatched keys."""
    s, t = native(f["orders"]), widened(f["orders_tgt"])
    a = v.diff_rows(s, t, ["key"]).where("status = 'mismatched'").select("key", F.lit(1).alias("r"), F.lit(0).alias("c"))
    b = v.diff_cells(s, t, ["key"]).select("key", F.lit(0).alias("r"), F.lit(1).alias("c"))
    both = a.union(b).groupBy("key").agg(F.max("r").alias("r"), F.max("c").alias("c"))
    return both.agg(F.count_if((F.col("r") == 1) & (F.col("c") == 0)).alias("only_in_rows"), F.count_if((F.col("r") == 0) & (F.col("c") == 1)).alias("only_in_cells"))


MULTISET_COLUMNS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
                    "l_returnflag, l_linestatus, l_shipdate")


@query("diff_multiset", "lineitem_tgt", sql=f"""
SELECT {MULTISET_COLUMNS}, CASE WHEN sum(w) > 0 THEN 'missing' ELSE 'extraneous' END AS status, abs(sum(w))::bigint AS copies
FROM (SELECT {MULTISET_COLUMNS}, 1 AS w FROM lineitem UNION ALL SELECT {MULTISET_COLUMNS}, -1 FROM lineitem_tgt)
GROUP BY {MULTISET_COLUMNS} HAVING sum(w) <> 0""")
def diff_multiset(f):
    return v.diff_multiset(f["lineitem"], f["lineitem_tgt"])


@query("table_checksum", sql="""SELECT 'lineitem' AS table_name, count(*) AS row_count, true AS same_when_dealt_anew, true AS differs_when_doubled, true AS differs_when_changed FROM lineitem
UNION ALL SELECT 'orders', count(*), true, true, true FROM orders""")
def table_checksum(f):
    """Rows in another order give the same checksum; one doubled or one changed row gives another."""
    def facts(name, change):
        df = f[name]
        cases = {"given": df, "dealt": df.repartition(7), "doubled": df.union(df.orderBy(*df.columns).limit(1)), "changed": df.withColumn(*change)}
        sums = reduce(lambda a, b: a.unionByName(b), [v.table_checksum(d, table=c) for c, d in cases.items()])
        by = {c: F.first(F.when(F.col("table_name") == c, F.struct("row_count", "hash_xor", "hash_sum")), ignorenulls=True) for c in cases}
        return sums.agg(*[x.alias(c) for c, x in by.items()]).select(
            F.lit(name).alias("table_name"), F.col("given.row_count").alias("row_count"), (F.col("given") == F.col("dealt")).alias("same_when_dealt_anew"),
            (F.col("given") != F.col("doubled")).alias("differs_when_doubled"), (F.col("given") != F.col("changed")).alias("differs_when_changed"))

    return facts("lineitem", ("l_tax", F.col("l_tax") + 1)).unionByName(facts("orders", ("o_orderstatus", F.concat("o_orderstatus", F.lit("!")))))


@query("key_checksum", "orders_tgt", sql="SELECT count(*) AS row_count, true AS same_for_other_columns, true AS differs_for_other_keys FROM orders")
def key_checksum(f):
    """Columns beyond the key don't matter; a copy that lost keys does."""
    cases = {"given": f["orders"], "other": f["orders"].withColumn("o_totalprice", F.lit(0.0)), "lost": f["orders_tgt"]}
    sums = reduce(lambda a, b: a.unionByName(b), [v.key_checksum(d, ["o_orderkey"], table=c) for c, d in cases.items()])
    by = [F.first(F.when(F.col("table_name") == c, F.struct("row_count", "hash_xor", "hash_sum")), ignorenulls=True).alias(c) for c in cases]
    return sums.agg(*by).select(F.col("given.row_count").alias("row_count"), (F.col("given") == F.col("other")).alias("same_for_other_columns"),
                                (F.col("given") != F.col("lost")).alias("differs_for_other_keys"))


@query("compare_checksums", "orders_tgt", "lineitem_tgt", "customer_tgt", sql="""
SELECT 'orders' AS table_name, 'checksum' AS issue, (SELECT count(*) FROM orders) AS source_count, (SELECT count(*) FROM orders_tgt) AS target_count
WHERE EXISTS ((SELECT o_orderkey, o_totalprice FROM orders EXCEPT SELECT o_orderkey, o_totalprice FROM orders_tgt))
UNION ALL SELECT 'lineitem', 'checksum', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem_tgt)
WHERE (SELECT count(*) FROM lineitem) <> (SELECT count(*) FROM lineitem_tgt) OR EXISTS ((SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem_tgt))
UNION ALL SELECT 'customer', 'checksum', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer_tgt)
WHERE EXISTS ((SELECT * FROM customer EXCEPT ALL SELECT * FROM customer_tgt))""")
def compare_checksums(f):
    def sums(pairs):
        out = None
        for name, df in pairs:
            one = v.table_checksum(df, table=name)
            out = one if out is None else out.unionByName(one)
        return out

    s = sums([(n, f[n]) for n in ("orders", "lineitem", "customer", "part")])
    t = sums([("orders", f["orders_tgt"]), ("lineitem", f["lineitem_tgt"]), ("customer", f["customer_tgt"]), ("part", f["part"])])
    return v.compare_checksums(s, t, ["table_name"])


@query("mismatch_sample", "orders_tgt", sql=f"""WITH {ORDER_PAIRS}
SELECT o_orderkey, status, 1::bigint AS row_count, rank FROM (
  SELECT o_orderkey, status, row_number() OVER (PARTITION BY status ORDER BY o_orderkey)::int AS rank
  FROM pairs WHERE status <> 'matched') WHERE rank <= 10""")
def mismatch_sample(f):
    return v.mismatch_sample(v.diff_rows(f["orders"], f["orders_tgt"], ["o_orderkey"]), ["o_orderkey"], 10)


@query("check_run", "orders_tgt", "customer_tgt", "documents_tgt", sql=f"""WITH {ORDER_PAIRS},
c AS (SELECT CASE WHEN t.c_custkey IS NULL THEN 'missing' ELSE 'matched' END AS status
      FROM customer s LEFT JOIN customer_tgt t ON s.c_custkey = t.c_custkey),
d AS (SELECT CASE WHEN t.doc_id IS NULL THEN 'missing' WHEN s.text <> t.text THEN 'mismatched' ELSE 'matched' END AS status
      FROM documents s LEFT JOIN documents_tgt t ON s.doc_id = t.doc_id)
SELECT 'orders' AS table_name, {SUMMARY_COLUMNS} FROM pairs
UNION ALL SELECT 'customer', {SUMMARY_COLUMNS} FROM c
UNION ALL SELECT 'documents', {SUMMARY_COLUMNS} FROM d
UNION ALL SELECT 'part', count(*), count(*), count(*), 0, 0, 0, 'verified' FROM part""")
def check_run(f):
    return check({"orders": f["orders"], "customer": f["customer"], "documents": f["documents"], "part": f["part"], "nation": f["nation"]},
                 {"shop_orders": f["orders_tgt"], "customer": f["customer_tgt"], "documents": f["documents_tgt"], "part": f["part"]},
                 keys={"orders": ["o_orderkey"], "customer": ["c_custkey"], "documents": ["doc_id"], "part": ["p_partkey"]},
                 mapping={"orders": "shop_orders"}, exclude=["nation"]).tables


@query("check_full_run", "orders_tgt", "customer_tgt", sql=f"""WITH {ORDER_PAIRS},
c AS (SELECT CASE WHEN t.c_custkey IS NULL THEN 'missing' ELSE 'matched' END AS status
      FROM customer s LEFT JOIN customer_tgt t ON s.c_custkey = t.c_custkey)
SELECT 'orders' AS table_name, {SUMMARY_COLUMNS} FROM pairs UNION ALL SELECT '_customer', {SUMMARY_COLUMNS} FROM c
UNION ALL SELECT 'part', count(*), count(*), count(*), 0, 0, 0, 'verified' FROM part
UNION ALL SELECT 'nation', count(*), NULL, NULL, NULL, NULL, NULL, 'absent_on_target' FROM nation""")
def check_full_run(f):
    """Tables side by side with a mapping, an exclusion, an absent table and a name that starts with _."""
    return run_check({"orders": f["orders"], "_customer": f["customer"], "part": f["part"], "nation": f["nation"], "region": f["region"]},
                     {"shop_orders": f["orders_tgt"], "_customer": f["customer_tgt"], "part": f["part"]},
                     {"orders": ["o_orderkey"], "_customer": ["c_custkey"], "part": ["p_partkey"]}, run_folder(f.spark, "check"), "run 1",
                     mapping={"orders": "shop_orders"}, exclude=["region"])


@query("check_resume", "customer_tgt", sql="""SELECT 'first' AS run, 'customer' AS table_name, 'verified' AS status UNION ALL SELECT 'second', 'customer', 'issues_found'
UNION ALL SELECT 'second', 'part', 'verified' UNION ALL SELECT 'resumed', 'customer', 'verified' UNION ALL SELECT 'resumed', 'part', 'verified'""")
def check_resume(f):
    """The target changes after the first run: a resumed run keeps what it had, a new run sees the change."""
    path, keys = run_folder(f.spark, "check"), {"customer": ["c_custkey"], "part": ["p_partkey"]}
    whole, damaged = {"customer": f["customer"], "part": f["part"]}, {"customer": f["customer_tgt"], "part": f["part"]}
    runs = [("first", {"customer": f["customer"]}, whole, "a"), ("resumed", whole, damaged, "a"), ("second", whole, damaged, "b")]
    found = [run_check(s, t, keys, path, token).select(F.lit(name).alias("run"), "table_name", "status") for name, s, t, token in runs]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("check_summary", "orders_tgt", "customer_tgt", sql=f"""WITH {ORDER_PAIRS},
c AS (SELECT CASE WHEN t.c_custkey IS NULL THEN 'missing' ELSE 'matched' END AS status
      FROM customer s LEFT JOIN customer_tgt t ON s.c_custkey = t.c_custkey),
x AS (SELECT {SUMMARY_COLUMNS} FROM pairs UNION ALL SELECT {SUMMARY_COLUMNS} FROM c
      UNION ALL SELECT count(*), count(*), count(*), 0, 0, 0, 'verified' FROM part)
SELECT count(*) AS tables_checked, count(*) FILTER (status = 'verified') AS tables_matching,
  count(*) FILTER (status <> 'verified') AS tables_with_issues, sum(source_rows)::bigint AS total_rows_checked,
  sum(rows_matching)::bigint AS total_rows_matching, sum(rows_missing)::bigint AS total_rows_missing,
  sum(rows_mismatched)::bigint AS total_rows_mismatched, sum(rows_extraneous)::bigint AS total_rows_extraneous,
  bool_and(status = 'verified') AS passed FROM x""")
def check_summary(f):
    return check({"orders": f["orders"], "customer": f["customer"], "part": f["part"]},
                 {"orders": f["orders_tgt"], "customer": f["customer_tgt"], "part": f["part"]},
                 keys={"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"]}).summary


@query("fk_orphans", "customer_tgt", sql="""
SELECT o_custkey, count(*) AS row_count FROM orders
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer_tgt) GROUP BY o_custkey""")
def fk_orphans(f):
    return v.fk_orphans(f["orders"], f["customer_tgt"], [("o_custkey", "c_custkey")])


@query("key_violations", sql="""
SELECT l_orderkey, l_linenumber, count(*) AS row_count, 'duplicate_key' AS violation
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def key_violations(f):
    return v.key_violations(f["lineitem"], ["l_orderkey", "l_linenumber"])


LOST = """n AS (SELECT o_orderkey AS id, 9007199254740992 + o_orderkey AS v, o_totalprice AS p FROM orders)"""


def wide_numbers(f):
    return f["orders"].select(F.col("o_orderkey").alias("id"), (F.lit(9007199254740992) + F.col("o_orderkey")).alias("v"), F.col("o_totalprice").cast("decimal(15,2)").alias("p"))


@query("diff_rows_lost_digits", sql=f"""WITH {LOST} SELECT 'value' AS kind, v AS k, 'mismatched' AS status FROM n WHERE v::double::hugeint <> v
UNION ALL SELECT 'key', v, 'missing' FROM n WHERE v::double::hugeint <> v""")
def diff_rows_lost_digits(f):
    """Integers beyond 2^53 that became doubles, as values and as keys; prices that became doubles lost nothing."""
    a = wide_numbers(f)
    b = a.withColumn("v", F.col("v").cast("double")).withColumn("p", F.col("p").cast("double"))
    values = v.diff_rows(a, b, ["id"]).join(a, "id").select(F.lit("value").alias("kind"), F.col("v").alias("k"), "status")
    # Keys of both sides are texts by then; those that the doubles fell on are another matter.
    keys = v.diff_rows(a.select("v", "p"), b.select("v", "p"), ["v"]).where("status = 'missing'").select(F.lit("key").alias("kind"), F.col("v").cast("bigint").alias("k"), "status")
    lost = a.where(F.col("v").cast("double").cast("decimal(38,0)") != F.col("v")).select(F.col("v").alias("k"))
    return values.unionByName(keys.join(lost, "k", "left_semi"))


@query("checksums_lost_digits", sql=f"""WITH {LOST} SELECT 'wide' AS table_name, count(*) AS source_count, count(*) AS target_count, bool_and(v::double::hugeint = v) AS matches FROM n
UNION ALL SELECT 'even', count(*), count(*), true FROM n WHERE id % 2 = 0""")
def checksums_lost_digits(f):
    a = wide_numbers(f)
    b = a.select("id", F.col("v").cast("double").alias("v"), F.col("p").cast("double").alias("p"))
    even = F.col("id") % 2 == 0
    return v.checksum_pair(a, b, table="wide").unionByName(v.checksum_pair(a.where(even), b.where(even), table="even"))


@query("check_run_report", "orders_tgt", "customer_tgt", sql=f"""WITH {ORDER_PAIRS},
o AS (SELECT {SUMMARY_COLUMNS} FROM pairs), c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 50 <> 0) AS kept FROM customer),
gone AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer WHERE c_custkey % 50 = 0),
band AS (SELECT CASE WHEN (n - kept) / n::double <= 0.01 THEN 'within_tolerance' WHEN (n - kept) / n::double <= 0.05 THEN 'reload_table' ELSE 'investigate_load' END AS b FROM c),
oband AS (SELECT CASE WHEN source_rows = target_rows THEN NULL WHEN abs(target_rows - source_rows) / source_rows::double <= 0.01 THEN 'within_tolerance'
  WHEN abs(target_rows - source_rows) / source_rows::double <= 0.05 THEN 'reload_table' ELSE 'investigate_load' END AS b FROM o)
SELECT 'finding' AS section, 'nation' AS table_name, 'missing_on_target' AS issue, NULL::varchar AS details
UNION ALL SELECT 'finding', 'part', 'column_order', unnest(['p_size int int', 'p_partkey bigint bigint'])
UNION ALL SELECT 'finding', 'part', 'nullability', 'p_brand string string' UNION ALL SELECT 'finding', 'part', 'column_default', 'p_brand string string'
UNION ALL SELECT 'finding', 'customer', 'row_count', 'source=' || n || ' target=' || kept || ' band=' || b FROM c, band
UNION ALL SELECT 'finding', 'customer', 'checksum', NULL UNION ALL SELECT 'finding', 'customer', 'row_hash', 'missing=' || (n - kept) || ' mismatched=0 extraneous=0' FROM c
UNION ALL SELECT 'finding', 'orders', 'row_count', 'source=' || source_rows || ' target=' || target_rows || ' band=' || b FROM o, oband WHERE b IS NOT NULL
UNION ALL SELECT 'finding', 'orders', 'checksum', NULL
UNION ALL SELECT 'finding', 'orders', 'row_hash', 'missing=' || rows_missing || ' mismatched=' || rows_mismatched || ' extraneous=' || rows_extraneous FROM o
UNION ALL SELECT 'sample', 'customer', 'missing', rank || ' {{"c_custkey":' || c_custkey || '}}' FROM gone WHERE rank <= 3
UNION ALL SELECT 'table', 'part', 'verified', count(*) || ' true' FROM part UNION ALL SELECT 'table', 'nation', 'absent_on_target', count(*)::varchar FROM nation
UNION ALL SELECT 'summary', NULL, 'tables', '4 1 3'
UNION ALL SELECT 'columns', 'part', 'compared', '4' UNION ALL SELECT 'columns', 'orders', 'compared', '6' UNION ALL SELECT 'columns', 'customer', 'compared', '5'""")
def check_run_report(f):
    """All sections of one run as written: part has its first columns swapped, another nullability and a default, but equal rows."""
    columns = ["p_partkey", "p_brand", "p_size", "p_retailprice"]
    source = {"orders": f["orders"].select(f["orders_tgt"].columns), "customer": f["customer"].select(f["customer_tgt"].columns), "part": f["part"].select(columns), "nation": f["nation"]}
    target = {"shop_orders": f["orders_tgt"], "customer": f["customer_tgt"], "part": f["part"].select("p_size", "p_brand", "p_partkey", "p_retailprice")}
    brand = F.col("column_name") == "p_brand"
    there = v.columns_of(f.spark, target).withColumn("is_nullable", F.col("is_nullable") & ~brand).withColumn("column_default", F.when(brand, "'none'").otherwise(F.col("column_default")))
    run = runs.full_run(source, target, {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"]}, run_folder(f.spark, "run"), "run 1",
                        mapping={"orders": "shop_orders"}, sample=3, target_columns=there)
    lines = [run.findings.select(F.lit("finding").alias("section"), "table_name", "issue", "details"),
             run.samples.where("table_name = 'customer'").select(F.lit("sample"), "table_name", "status", F.concat_ws(" ", "rank", "key")),
             run.tables.where("table_name in ('part', 'nation')").select(F.lit("table"), "table_name", "status", F.concat_ws(" ", "source_rows", "checksum_matches")),
             run.summary.select(F.lit("summary"), F.lit(None).cast("string"), F.lit("tables"), F.concat_ws(" ", "tables_checked", "tables_matching", "tables_with_issues")),
             run.columns.where("compared").groupBy("table_name").agg(F.count("*").cast("string").alias("n")).select(F.lit("columns"), "table_name", F.lit("compared"), "n")]
    return reduce(lambda a, b: a.union(b), lines)
