"""Quantile sketch, split points and the diff by key ranges."""

import pytest
from pyspark.sql import functions as F

from crossover.functions.sketch import quantiles
from crossover.operators import ranges as rg
from crossover.operators import validate as v
from crossover.sources import tables as tb
from tests.conftest import rows


def test_shards_of_composite_text_keys_are_even(spark):
    df = spark.range(300_000).select(F.concat(F.lit("customer#"), F.lpad((F.col("id") % 700).cast("string"), 6, "0")).alias("a.b"), F.col("id").alias("n"), F.lit("x").alias("w"))
    df = df.repartition(6, "n").union(df.limit(1).select(F.lit(None).cast("string"), "n", "w"))
    cuts = tb.split_points(df, ["a.b", "n"], 64)
    key = rg.Keys(["a.b", "n"], df.schema)
    ends = [None, *cuts, None]
    sizes = [r["count"] for r in df.groupBy(key.place([rg.Range(a, b) for a, b in zip(ends, ends[1:])])).count().collect()]
    assert len(sizes) == 64 and sum(sizes) == 300_001 and max(abs(s * 64 / 300_000 - 1) for s in sizes) < 0.1


def test_small_sketches_are_exact(spark):
    df = spark.createDataFrame([(i % 2, f"{i:03d}") for i in range(100)] + [(0, None)], "g int, k string").repartition(5)
    assert rows(quantiles(df, ["k"], 4)) == [(0, "024"), (0, "049"), (0, "074")]
    assert rows(quantiles(df, ["k"], 2, F.col("g"))) == [(0, "048"), (1, "049")]
    assert rows(quantiles(df.limit(0), ["k"], 4)) == []
    assert rows(quantiles(df.where("k = '007'"), ["k"], 4)) == [(0, "007")]


@pytest.mark.parametrize("keys", [["id"], ["t", "id"]])
def test_range_diff_reads_what_differs(spark, tmp_path, keys):
    a = spark.range(40_000).select(F.when(F.col("id") == 9, None).otherwise(F.col("id")).alias("id"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("t"), (F.col("id") * 3).alias("place"))
    wrong = F.col("id").between(20_000, 20_020)
    b = a.withColumn("place", F.when(wrong, 0).otherwise(F.col("place"))).where("id is null or id <> 777").union(spark.range(50_000, 50_002).select("id", F.lit("p0"), F.lit(1)))
    a.orderBy("id").write.parquet(str(tmp_path / "a"))
    a, b = spark.read.parquet(str(tmp_path / "a")), b.select(F.col("id").cast("decimal(20,0)").alias("id"), F.col("t").alias("t"), "place")
    got = rg.diff_ranges(a, b, keys, fan=8, leaf_rows=500)
    assert rows(got.rows) == rows(v.diff_rows(a, b, keys)) and got.rows.count() == 24
    assert got.read[0] > 79_000 and (len(keys) > 1 or got.read[-1] < got.read[0] / 4)
    if len(keys) == 1:
        plan = rg.rows_within(a, rg.Keys(keys, a.schema), got.ranges)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(" in plan and "GreaterThan(id," in plan


def test_range_diff_of_odd_tables(spark):
    one = spark.createDataFrame([(1, "x")] * 50, "k int, v string")
    assert rg.diff_ranges(one, one, ["k"]).rows.count() == 0
    assert rows(rg.diff_ranges(one, one.limit(0), ["k"], leaf_rows=5).rows) == [(1, "missing", 50)]
    assert rows(rg.diff_ranges(one.limit(0), one, ["k"], leaf_rows=5).rows) == [(1, "extraneous", 50)]
    assert rg.diff_ranges(one.limit(0), one.limit(0), ["k"]).rows.count() == 0
    with pytest.raises(ValueError):
        rg.diff_ranges(one, one.withColumn("k", F.lit("1")), ["k"])
