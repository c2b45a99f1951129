"""Full check runs, and names that a comparison might want for itself."""

import pytest
from pyspark.sql import functions as F

from crossover.operators import ranges as rg
from crossover.operators import validate as v
from crossover.plans import runs
from crossover.plans.check import CheckFailed
from tests.conftest import rows


def tables(spark):
    a = spark.createDataFrame([(i, f"v{i}", i * 1.5) for i in range(50)], "id int, t string, x double")
    b = a.where("id <> 7").withColumn("t", F.when(F.col("id") == 9, "other").otherwise(F.col("t")))
    return a, b


def test_swapped_columns_are_found(spark, tmp_path):
    a, _ = tables(spark)
    run = runs.full_run({"t": a}, {"t": a.select("t", "id", "x")}, {"t": ["id"]}, str(tmp_path), "r")
    assert rows(run.findings) == [("t", "column_order", "id int int"), ("t", "column_order", "t string string")]
    assert run.tables.first()["status"] == "verified" and not run.passed()
    assert runs.full_run({"t": a}, {"t": a.select("t", "id", "x")}, {"t": ["id"]}, str(tmp_path), "r2", strict=False).passed()
    only = runs.full_run({"t": a}, {"t": a.drop("x")}, {"t": ["id"]}, str(tmp_path), "r3", schema_only=True)
    assert rows(only.findings.select("issue")) == [("missing_column",)] and only.summary is None and only.tables.count() == 0


def test_strict_check(spark):
    from crossover.plans.check import check

    a, _ = tables(spark)
    swapped = {"t": a.select("t", "id", "x")}
    assert check({"t": a}, swapped, {"t": ["id"]}).passed()
    assert rows(check({"t": a}, swapped, {"t": ["id"]}, strict=True).column_issues.select("column_name", "issue")) == [("id", "column_order"), ("t", "column_order")]


def test_findings_samples_and_resuming(spark, tmp_path):
    a, b = tables(spark)
    sides = ({"x": a, "gone": a}, {"y": b, "more": b})
    run = runs.full_run(*sides, {"x": ["id"]}, str(tmp_path), "r", mapping={"x": "y"}, sample=2)
    assert rows(run.findings) == [("gone", "missing_on_target", None), ("more", "extra_on_target", None), ("x", "checksum", None), ("x", "row_count", "source=50 target=49 band=reload_table"),
                                  ("x", "row_hash", "missing=1 mismatched=1 extraneous=0")]
    assert rows(run.samples) == [("x", "mismatched", 1, '{"id":9}', 1), ("x", "missing", 1, '{"id":7}', 1)]
    assert run.summary.first()["tables_checked"] == 2
    # a run of the same token keeps its figures; another one looks again
    assert runs.full_run({"x": a}, {"y": a}, {"x": ["id"]}, str(tmp_path), "r", mapping={"x": "y"}).findings.count() == 3
    assert runs.full_run({"x": a}, {"y": a}, {"x": ["id"]}, str(tmp_path), "again", mapping={"x": "y"}).passed()
    with pytest.raises(CheckFailed):
        runs.full_run(*sides, {"x": ["id"]}, str(tmp_path), "fail", exclude=["more"], fail_on_mismatch=True)
    assert rows(runs.read_run(spark, str(tmp_path), "fail").findings.select("table_name", "issue")) == [("gone", "missing_on_target"), ("x", "missing_on_target"), ("y", "extra_on_target")]


def test_names_of_any_kind(spark):
    names = ["_hash", "_s", "_bucket", "a.b", "_k_c0", "place", "c1"]
    a = spark.createDataFrame([(i, i, i, f"v{i}", 0, i, 1) for i in range(20)], ", ".join(f"`{n}` {'string' if n == 'a.b' else 'int'}" for n in names))
    b = a.where("_s <> 3").withColumns({"place": F.when(F.col("_s") == 5, 0).otherwise(F.col("place"))})
    for keys in (["_hash"], ["a.b", "_s"], ["_bucket", "c1"]):
        want = rows(v.diff_rows(a, b, keys))
        assert [r[-2] for r in want] == ["missing", "mismatched"] and v.diff_rows(a, b, keys).columns == [*keys, "status", "row_count"]
        assert rows(v.diff_shards(a, b, keys, 4)) == want
        assert rows(v.diff_cells(a, b, keys).select("column_name", "source_value", "target_value")) == [("place", "5", "0")]
        assert rows(rg.diff_ranges(a, b, keys, fan=4, leaf_rows=2).rows) == want
    assert v.diff_multiset(a, b).columns == [*names, "status", "copies"] and v.diff_multiset(a, b).count() == 3
    assert v.diff_summary(a, b, ["a.b"]).first()["rows_matching"] == 18
