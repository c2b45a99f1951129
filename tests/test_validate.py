"""Row diffs against brute force, with hot keys, repeated rows and NULLs."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from crossover.operators import validate as v
from crossover.plans.check import CheckFailed, check, mismatches, select_names
from tests.conftest import rows

SCHEMA = "k string, a string, b double"


def brute(src, tgt):
    out = {}
    for key in {r[0] for r in src} | {r[0] for r in tgt}:
        s, t = Counter(r for r in src if r[0] == key), Counter(r for r in tgt if r[0] == key)
        left, right = sum((s - t).values()), sum((t - s).values())
        both = min(left, right)
        for status, n in (("missing", left - both), ("extraneous", right - both), ("mismatched", both)):
            if n:
                out[(key, status)] = n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_diff_rows_random(spark, seed):
    rnd = random.Random(seed)

    def row():
        # A third of all rows share one key.
        k = "hot" if rnd.random() < 0.34 else rnd.choice([None, "x", "y", *map(str, range(40))])
        return (k, rnd.choice([None, "p", "q"]), rnd.choice([None, 1.0, 2.5]))

    src = [row() for _ in range(300)]
    tgt = [r for r in src if rnd.random() > 0.1] + [row() for _ in range(30)]
    s, t = spark.createDataFrame(src, SCHEMA), spark.createDataFrame(tgt, SCHEMA)
    got = {(r["k"], r["status"]): r["row_count"] for r in v.diff_rows(s, t, ["k"]).collect()}
    want = brute(src, tgt)
    assert got == want
    sharded = {(r["k"], r["status"]): r["row_count"] for r in v.diff_shards(s, t, ["k"], buckets=7).collect()}
    assert sharded == want
    one = v.diff_summary(s, t, ["k"]).first()
    assert one["source_rows"] == len(src) and one["target_rows"] == len(tgt)
    assert one["rows_matching"] == sum((Counter(src) & Counter(tgt)).values())
    for status in ("missing", "extraneous", "mismatched"):
        assert one[f"rows_{status}"] == sum(n for (_, st), n in want.items() if st == status)
    bag = {(r["k"], r["a"], r["b"], r["status"]): r["copies"] for r in v.diff_multiset(s, t).collect()}
    assert bag == {(*k, "missing"): n for k, n in (Counter(src) - Counter(tgt)).items()} | {(*k, "extraneous"): n for k, n in (Counter(tgt) - Counter(src)).items()}


def test_nulls_do_not_collide(spark):
    s = spark.createDataFrame([("1", None, "a")], "k string, x string, y string")
    t = spark.createDataFrame([("1", "a", None)], "k string, x string, y string")
    assert rows(v.diff_rows(s, t, ["k"])) == [("1", "mismatched", 1)]
    assert rows(v.diff_cells(s, t, ["k"])) == [("1", "x", None, "a"), ("1", "y", "a", None)]


def test_trim_and_zero(spark):
    s = spark.createDataFrame([("1", "a", 0.0)], SCHEMA)
    t = spark.createDataFrame([("1", " a \n", -0.0)], SCHEMA)
    assert v.diff_rows(s, t, ["k"]).count() == 0
    assert v.diff_rows(s, t, ["k"], trim=False).count() == 1


def test_diff_cells_with_repeated_rows(spark):
    same = [("1", "same", 1.0)] * 3
    s = spark.createDataFrame([*same, ("1", "old", 1.0), ("2", "u", 1.0), ("2", "w", 2.0)], SCHEMA)
    t = spark.createDataFrame([*same, ("1", "new", 1.0), ("2", "x", 1.0), ("2", "y", 2.0)], SCHEMA)
    assert rows(v.diff_cells(s, t, ["k"])) == [("1", "a", "old", "new")]
    assert rows(v.diff_rows(s, t, ["k"])) == [("1", "mismatched", 1), ("2", "mismatched", 2)]


def test_checksum_ignores_order_but_not_copies(spark):
    a = spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], SCHEMA)
    b = spark.createDataFrame([("2", "b", 2.0), ("1", "a", 1.0)], SCHEMA)
    pair = spark.createDataFrame([("1", "a", 1.0), ("1", "a", 1.0)], SCHEMA)
    other = spark.createDataFrame([("3", "c", 1.0), ("3", "c", 1.0)], SCHEMA)
    assert v.table_checksum(a).first() == v.table_checksum(b).first()
    assert v.table_checksum(pair).first() != v.table_checksum(other).first()
    same = v.compare_checksums(v.table_checksum(a, table="t"), v.table_checksum(b, table="t"), ["table_name"])
    assert same.count() == 0


def test_sample_keeps_the_same_keys(spark):
    df = spark.range(20000).selectExpr("id as k", "id as a")
    a = v.sample_keys(df, ["k"], 0.1)
    b = v.sample_keys(df.orderBy("k", ascending=False), ["k"], 0.1)
    assert rows(a) == rows(b) and 1700 < a.count() < 2300


def test_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 1)], "a int, b int")
    assert rows(v.key_violations(df, ["a", "b"])) == [(1, 1, 2, "duplicate_key"), (2, None, 1, "null_key")]
    parent = spark.createDataFrame([(1,)], "p int")
    assert rows(v.fk_orphans(df, parent, [("a", "p")])) == [(2, 1), (3, 1)]


def test_count_bands(spark):
    df = spark.createDataFrame([("a", 1000, 1000), ("b", 1000, 995), ("c", 1000, 960), ("d", 1000, 10), ("e", None, 1), ("f", 1, None), ("g", 0, 5)],
                               "t string, source_count long, target_count long")
    assert {r["t"]: r["band"] for r in v.count_bands(df).collect()} == {
        "a": "count_verified", "b": "within_tolerance", "c": "reload_table", "d": "investigate_load", "e": "absent_on_source", "f": "absent_on_target",
        "g": "investigate_load"}


def test_check_modes(spark):
    s = {"a": spark.createDataFrame([("1", "x", 1.0)], SCHEMA), "b": spark.createDataFrame([("1", "x", 1.0)], SCHEMA)}
    t = {"shop_a": s["a"], "c": s["b"]}
    r = check(s, t, {"a": ["k"]}, mapping={"a": "shop_a"})
    assert rows(r.missing_tables) == [("b", "missing_on_target"), ("c", "extra_on_target")]
    assert rows(r.tables.select("table_name", "status")) == [("a", "verified")]
    assert not r.passed()
    assert ("b", "missing_on_target", None) in rows(mismatches(r))
    assert check(s, t, {"a": ["k"]}, mapping={"a": "shop_a"}, include=["a"]).passed()
    assert check(s, t, {}, mapping={"a": "shop_a"}, include=["a"], schema_only=True).summary is None
    with pytest.raises(CheckFailed):
        check(s, t, {}, fail_on_mismatch=True)
    assert select_names(["a", "b", "c"], ["*"], ["b"]) == ["a", "c"]


def test_strict_columns(spark):
    s = v.columns_of(spark, {"t": spark.createDataFrame([], "a int, b string")})
    t = v.columns_of(spark, {"t": spark.createDataFrame([], "b string, a bigint, c int")})
    got = {(r["column_name"], r["issue"]) for r in v.compare_columns(s, t, ["table_name"], strict=True).collect()}
    assert got == {("a", "column_type"), ("a", "column_order"), ("b", "column_order"), ("c", "extra_column")}


def test_run_check_goes_on(spark, tmp_path):
    from crossover.plans.check import CheckFailed, run_check
    a, b = spark.createDataFrame([("1", "x", 1.0)], SCHEMA), spark.createDataFrame([("1", "y", 1.0)], SCHEMA)
    path = str(tmp_path / "run")
    status = lambda *args, **more: rows(run_check(*args, path, **more).select("table_name", "status"))
    assert status({"a": a}, {"a": a}, {"a": ["k"]}, token="one/1") == [("a", "verified")]
    # The same run keeps the figures it has and adds new tables; an absent table and odd names have a row too.
    source, target = {"a": a, "_audit": a, "c": a}, {"a": b, "_audit": b}
    assert status(source, target, {"a": ["k"], "_audit": ["k"]}, token="one/1") == [("_audit", "issues_found"), ("a", "verified"), ("c", "absent_on_target")]
    # Another run looks again, and returns the tables of its call only.
    assert status({"a": a, "c": a}, {"a": b, "d": a}, {"a": ["k"]}, token="two", mapping={"c": "d"}) == [("a", "issues_found"), ("c", "verified")]
    assert status(source, target, {}, token="two", exclude=["_audit", "c"]) == [("a", "issues_found")]
    with pytest.raises(CheckFailed):
        run_check({"a": a}, {"a": b}, {}, path, "three", fail_on_mismatch=True)


def test_run_check_beside_an_earlier_call(spark, tmp_path):
    """Results of two calls with one token in one plan: the later one has all its tables, whatever the order."""
    from crossover.plans.check import run_check

    path, tables, keys = str(tmp_path / "beside"), {n: spark.range(5).toDF("k") for n in ("a", "b c", "_d")}, {n: ["k"] for n in ("a", "b c", "_d")}
    first = run_check({"a": tables["a"]}, tables, keys, path, "one").select(F.lit(1).alias("call"), "table_name", "status")
    second = run_check(tables, tables, keys, path, "one").select(F.lit(2).alias("call"), "table_name", "status")
    want = sorted([(1, "a", "verified"), *[(2, n, "verified") for n in tables]], key=str)
    assert rows(first.unionByName(second)) == want == rows(second.unionByName(first))
    assert rows(run_check(tables, tables, keys, path, "one", include=["none"])) == []


def test_types_may_differ(spark):
    s = spark.sql("""select 5 as k, 'a  ' as name, cast(1.50 as decimal(10,2)) as d, true as flag, timestamp '2024-01-01 10:00:00' as at, cast(1.5 as float) as f,
                     named_struct('m', map('x', 1, 'y', 2), 't', 'q ') as n""")
    t = spark.sql("""select 5L as k, 'a' as name, cast(1.5 as decimal(19,4)) as d, cast(1 as smallint) as flag, timestamp_ntz '2024-01-01 10:00:00' as at, 1.5d as f,
                     named_struct('m', map('y', 2L, 'x', 1L), 't', 'q') as n""")
    assert v.diff_rows(s, t, ["k"]).count() == 0 and v.diff_rows(s, t, ["k", "name"]).count() == 0
    assert v.diff_multiset(s, t).count() == 0 and v.diff_shards(s, t, ["k", "name"], 8).count() == 0 and v.diff_cells(s, t, ["k"]).count() == 0
    worse = t.withColumn("n", F.expr("named_struct('m', map('x', 1L, 'y', 3L), 't', 'q')"))
    assert [(r["k"], r["column_name"]) for r in v.diff_cells(s, worse, ["k"]).collect()] == [(5, "n")]
    assert [r["status"] for r in v.diff_rows(s, worse, ["k"]).collect()] == ["mismatched"]
    with pytest.raises(ValueError):
        v.diff_rows(s, t.drop("flag"), ["k"])


def test_wide_rows_move_only_when_they_differ(spark):
    """No exchange of the whole rows stands below the filter on buckets."""
    s = spark.range(1000).selectExpr("id as k", "repeat('x', 100) as wide")
    t = s.withColumn("wide", F.when(F.col("k") == 7, "y").otherwise(F.col("wide")))
    for df in (v.diff_multiset(s, t), v.diff_cells(s, t, ["k"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_bucket" in plan and "LeftSemi" in plan
    assert {r["status"] for r in v.diff_multiset(s, t).collect()} == {"missing", "extraneous"}
    assert [r["k"] for r in v.diff_cells(s, t, ["k"]).collect()] == [7]


def test_numbers_beside_floats(spark):
    from crossover.functions.comparing import comparable

    a = spark.sql("""select * from values (1, 9007199254740993L, 0.10BD, 5L), (2, 4611686018427387904L, 1234567.125BD, 0L), (3, 9223372036854775807L, 0.00001BD, -7L), (4, 0L, 0.00BD, 1L),
        (5, NULL, 12345678.5BD, 16777217L) as t(k, n, d, f)""").select("k", "n", F.col("d").cast("decimal(30,18)").alias("d"), "f")
    b = a.select("k", F.col("n").cast("double").alias("n"), F.col("d").cast("double").alias("d"), F.col("f").cast("float").alias("f"))
    assert rows(v.diff_cells(a, b, ["k"]).select("k", "column_name")) == [(1, "n"), (3, "n"), (5, "f")]
    s, t, _ = comparable(a, b, ["k"])
    assert [r["d"] for r in t.orderBy("k").collect()] == ["0.1", "1234567.125", "0.00001", "0", "12345678.5"]
    odd = spark.sql("select stack(7, 1e300D, -0.0D, 1.5e20D, double('NaN'), double('Infinity'), 2.5e-30D, -1.25D) as n")
    assert rows(comparable(odd, odd.select(F.lit(1).alias("n")))[0]) == [("-1.25",), ("0",), ("0.0000000000000000000000000000025",), ("1.0E300",), ("150000000000000000000",), ("Infinity",), ("NaN",)]
    assert v.diff_rows(a.select("n"), b.select("n"), ["n"]).where("status = 'missing'").count() == 2
