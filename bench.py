"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from crossover.operators import validate
from crossover.queries import all_queries
from crossover.session import build_session

HEADLINE = [
    "diff_rows", "diff_summary", "diff_cells", "diff_shards", "diff_multiset", "diff_rows_repeated_keys", "diff_documents", "table_checksum",
    "check_run", "column_profile", "feature_usages", "feature_counts", "query_issues", "module_complexity", "issues_mssql", "score_mysql", "score_mssql",
    "map_types", "schema_diff", "conform_rejects", "usage_cost_rollup", "cdc_latest", "cdc_lag", "key_state",
]


def source_rate(spark, folder: str, times: int, clean: bool = False) -> int:
    """Source rows a second of a keyed diff over ``orders`` repeated ``times`` over with other keys; ``clean``: by buckets, one row in 100 000 differs."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = (F.col("o_orderkey") * times + F.col("copy")).alias("o_orderkey")
    big = orders.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(key, *[c for c in orders.columns if c != "o_orderkey"])
    odd = F.col("o_orderkey") % (100_000 if clean else 33) == 0
    other = big.withColumn("o_totalprice", F.when(odd, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    rows, begin = orders.count() * times, time.perf_counter()
    (validate.diff_shards(big, other, ["o_orderkey"], 1 << 14) if clean else validate.diff_rows(big, other, ["o_orderkey"])).write.format("noop").mode("overwrite").save()
    return round(rows / (time.perf_counter() - begin))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("crossover-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        begin = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    run("diff_rows")  # starts the JVM's compilers and Spark's own caches
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    rates = {f"diff_rows_per_sec_x{n}": source_rate(spark, folder, n) for n in (4, 16)}
    rates["diff_shards_per_sec_clean_x16"] = source_rate(spark, folder, 16, clean=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
