"""Profiles out of merged sketches, overflow of targets, conforming of the largest numbers."""

from threading import Barrier

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.operators import mapping as mp
from crossover.operators import profile as prof
from crossover.operators import sketches as sk


def test_merged_profile_is_that_of_one_pass(spark, tmp_path):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")).alias("n"), F.concat(F.lit("v"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000)).alias("t"),
                                    (F.col("id") / 7).alias("x.y"), F.timestamp_seconds(F.col("id")).alias("at"), F.array("id").alias("list"), (F.col("id") * 1.5).cast("decimal(12,2)").alias("d"))
    for shard in range(4):
        sk.store_shard(df.where(F.col("id" if "id" in df.columns else "at").cast("long") % 4 == shard), str(tmp_path), "t 1", str(shard))
    merged = {r["column_name"]: r for r in sk.stored_profile(spark, str(tmp_path), ["t 1"]).collect()}
    whole = {r["column_name"]: r for r in sk.figures(sk.merge_sketches(sk.sketch_columns(df).withColumn("table_name", F.lit("t 1")))).collect()}
    exact = [c for c in whole["n"].asDict() if c not in ("distinct_count", "quartiles", "top_values")]
    for c in df.columns:
        assert [merged[c][x] for x in exact] == [whole[c][x] for x in exact]
    assert (merged["n"]["min_value"], merged["n"]["max_value"], merged["n"]["null_count"]) == ("1", "39999", 4000)
    assert (merged["d"]["min_value"], merged["d"]["max_value"], merged["list"]["distinct_count"]) == ("0", "59998.5", None)
    assert abs(merged["n"]["distinct_count"] / 36_000 - 1) < 0.06 and abs(merged["t"]["distinct_count"] / 2501 - 1) < 0.06
    for c, q in zip(merged["n"]["quartiles"], (0.25, 0.5, 0.75)):
        assert abs(df.where(F.col("n") <= c).count() / 36_000 - q) < 0.03
    top = merged["t"]["top_values"][0]
    assert top["item"] == "v7" and 20_000 <= top["count"] <= 20_050
    # a changed shard costs that shard alone
    sk.store_shard(df.where("n = 5"), str(tmp_path), "t 1", "3")
    assert sk.stored_profile(spark, str(tmp_path), ["t 1"]).where("column_name = 'n'").first()["row_count"] == 30_001


def test_shards_side_by_side(monkeypatch):
    """Shards are stored at the same time, one that comes again after its first time."""
    both, done = Barrier(3), []

    def store(df, path, table, shard, target):
        if df != "again":
            both.wait(20)
        done.append((df, path, table, shard, target))

    monkeypatch.setattr(sk, "store_shard", store)
    sk.store_shards([("a", "0", "x"), ("a", "1", "y"), ("b", "0", "z"), ("a", "0", "again")], "p", {"a": {"c": "int"}})
    assert sorted(d[:1] + d[2:4] for d in done) == [("again", "a", "0"), ("x", "a", "0"), ("y", "a", "1"), ("z", "b", "0")]
    order = [d[0] for d in done]
    assert order.index("x") < order.index("again") and {(d[2], str(d[4])) for d in done} == {("a", "{'c': 'int'}"), ("b", "None")}


def test_overflow_of_every_kind_of_target(spark):
    df = spark.sql("select * from values (1, '123456', 'abc', 'ä', timestamp_ntz'2024-01-01 00:00:00.5'), (2, '12', 'abcd', 'ää', timestamp_ntz'2024-01-01 00:00:01'), "
                   "(300, '1.5', null, null, null) as t(a, d, v, b, t)").withColumn("d", F.col("d").cast("decimal(10,1)"))
    target = {"a": "tinyint", "d": "decimal(5,0)", "v": "varchar(3)", "b": "varbinary(2)", "t": "datetime(0)"}
    got = {r["column_name"]: r["overflow_count"] for r in prof.column_profile(df, target=target).collect()}
    assert got == {"a": 1, "d": 2, "v": 1, "b": 1, "t": 1}
    found = {r["column_name"]: r["overflow_count"] for r in sk.sketch_columns(df, {**target, "a": "tinyint unsigned"}).collect()}
    assert found == got


def test_whole_numbers_to_floats(spark):
    values = [2**63 - 1, 2**62, 2**53 + 1, -(2**63), 5, None]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    good, bad = mp.conform(df, [mp.Field("n", T.DoubleType())])
    assert sorted(r["n"] for r in bad.collect()) == [2**53 + 1, 2**63 - 1] and good.count() == 4
    small, lost = mp.conform(spark.createDataFrame([(2147483647,), (16777217,), (16777216,)], "n int"), [mp.Field("n", T.FloatType())])
    assert sorted(r["n"] for r in lost.collect()) == [16777217, 2147483647] and small.first()["n"] == 16777216.0
