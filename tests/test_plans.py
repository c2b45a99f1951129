"""Scores, automation, sizing and mapping on small cases with known points."""

import pytest
from pyspark.sql import functions as F

from crossover.operators import mapping as mp
from crossover.operators import runlogs as rl
from crossover.plans import automation as auto
from crossover.plans import scoring as sc
from crossover.plans import sizing as sz
from tests.conftest import rows

KEY = "source_id string, schema_name string, name string"


def mysql_frames(spark, **over):
    facts = {"source_id": "db1", "table_count": 3, "total_data_mb": 0.06, "largest_table_mb": 0.05, "has_spatial_columns": False, "longblob_column_count": 0,
             "has_fulltext_indexes": False, "foreign_key_count": 1, "stored_procedure_count": 1, "trigger_count": 1, "event_count": 0,
             "binlog_format": "ROW", "engine_version": "3.07.1", "character_set_server": "utf8mb4", "lower_case_table_names": 0, **over}
    modules = [("db1", "s", "p", "routine", "PROCEDURE")] * 1 + [("db1", "s", "t", "trigger", None)]
    return dict(
        sources=spark.createDataFrame([("db1",)], "source_id string"), checklist=spark.createDataFrame([facts]),
        charsets=spark.createDataFrame([("db1", "utf8mb4", "utf8mb4_0900_ai_ci", 5)], "source_id string, character_set_name string, collation_name string, column_count long"),
        difficulty=spark.createDataFrame([("db1", "s", "p", "routine", "trivial")], KEY + ", kind string, difficulty string"),
        modules=spark.createDataFrame(modules, KEY + ", kind string, routine_type string"),
        jobs=spark.createDataFrame([], "source_id string, job_name string"))


def scores_of(spark, **over):
    f = mysql_frames(spark, **over)
    return {r["category"]: r["score"] for r in sc.scores(f["sources"], sc.deductions_mysql(**f), sc.MYSQL_CATEGORIES).collect()}


def test_small_database(spark):
    # 2 procedure + 2 trigger + 1 key + 1 collation; trivial procedure 1 + trigger 2; no log 2
    assert scores_of(spark) == {"schema_compatibility": 24, "data_complexity": 20, "query_compatibility": 18, "procedural_code": 17, "operational_readiness": 10}


@pytest.mark.parametrize("over,category,score", [
    ({"stored_procedure_count": 9}, "schema_compatibility", 16), ({"trigger_count": 6, "foreign_key_count": 20}, "schema_compatibility", 12),
    ({"has_spatial_columns": True}, "schema_compatibility", 21), ({"event_count": 40}, "schema_compatibility", 0),
    ({"total_data_mb": 501.0 * 1024}, "data_complexity", 18), ({"total_data_mb": 1001.0 * 1024}, "data_complexity", 15), ({"total_data_mb": 5001.0 * 1024}, "data_complexity", 10),
    ({"largest_table_mb": 101.0 * 1024, "table_count": 1001, "longblob_column_count": 7}, "data_complexity", 11),
    ({"binlog_format": "STATEMENT"}, "operational_readiness", 5), ({"engine_version": "2.11"}, "operational_readiness", 8),
    ({"character_set_server": "latin1", "lower_case_table_names": 1}, "operational_readiness", 7)])
def test_points(spark, over, category, score):
    assert scores_of(spark, **over)[category] == score


def test_outside_analysis_wins(spark):
    f = mysql_frames(spark)
    given = spark.createDataFrame([("db1", "s", "p", "complex")], KEY + ", difficulty string")
    lost = sc.deductions_mysql(**f, analysis=given).where("rule = 'procedure'").first()
    assert (lost["points"], lost["detail"]) == (5, "s.p: complex")


def test_log_without_issue_loses_nothing(spark):
    f = mysql_frames(spark)
    log = spark.createDataFrame([("db1",)], "source_id string")
    none = spark.createDataFrame([], "source_id string, construct string")
    lost = sc.deductions_mysql(**f, log=log, issues=none)
    assert lost.where("category = 'query_compatibility'").count() == 0
    some = spark.createDataFrame([("db1", c) for c in ["XA_TRANSACTION"] * 3 + ["GET_LOCK"] * 2 + ["RELEASE_LOCK"] * 2 + ["SPATIAL"] * 12], "source_id string, construct string")
    lost = {r["rule"]: r["points"] for r in sc.deductions_mysql(**f, log=log, issues=some).where("category = 'query_compatibility'").collect()}
    assert lost == {"xa_transactions": 2, "locks": 2, "functions": 10}


@pytest.mark.parametrize("bands,cases", [(sc.MYSQL_BANDS, {90: "excellent", 89: "good", 75: "good", 74: "moderate", 50: "moderate", 25: "challenging", 24: "difficult"}),
                                         (sc.MSSQL_BANDS, {85: "excellent", 70: "good", 69: "moderate", 49: "challenging", 0: "difficult"})])
def test_ratings(spark, bands, cases):
    df = spark.createDataFrame([(str(n), "c", n) for n in cases], "source_id string, category string, score int")
    assert {int(r["source_id"]): r["rating"] for r in sc.ratings(df, bands).collect()} == cases


def test_automation(spark):
    f = mysql_frames(spark)
    none = spark.createDataFrame([], "source_id string, index_type string, data_type string")
    tables = spark.createDataFrame([("db1",)] * 2, "source_id string")
    r = auto.automation_mysql(f["sources"], tables, tables.limit(0), none, f["modules"], f["difficulty"], f["jobs"], none).first()
    # 2 tables 200; procedure 90/10; trigger 80/20 of 400
    assert (r["automatic_pct"], r["assisted_pct"], r["manual_pct"]) == (50.0, 42.5, 7.5)
    empty = auto.automation_mysql(spark.createDataFrame([("none",)], "source_id string"), tables, tables, none, f["modules"], f["difficulty"], f["jobs"], none).first()
    assert (empty["automatic_pct"], empty["assisted_pct"]) == (100.0, 0.0)


def test_strategies(spark):
    cases = [("starter", "auto", 1.0, "cli_import"), ("starter", "dms", 1.0, None), ("essential", "auto", 60.0 * 1024, "dms"), ("essential", "physical_import", 1.0, None),
             ("dedicated", "auto", 600.0 * 1024, "physical_import"), ("dedicated", "auto", 500.0 * 1024, "dms"), ("dedicated", "auto", None, "direct"), ("dedicated", "DIRECT", 1.0, "direct")]
    df = spark.createDataFrame([(str(i), mb, t, c) for i, (t, c, mb, _) in enumerate(cases)], "source_id string, total_data_mb double, tier string, choice string")
    got = {int(r["source_id"]): (r["strategy"], r["reason"] is None) for r in sz.strategy_tier(df).collect()}
    assert got == {i: (s, s is not None) for i, (_, _, _, s) in enumerate(cases)}
    sizes = spark.createDataFrame([("a", 99.0 * 1024), ("b", 100.0 * 1024), ("c", 1024.0 * 1024)], "source_id string, total_data_mb double")
    assert rows(sz.strategy(sizes, "self_hosted").select("source_id", "strategy")) == [("a", "direct"), ("b", "dms"), ("c", "physical_import")]


def test_cost(spark):
    stats = spark.createDataFrame([("a", "ServerlessDatabaseCapacity", 2.0, 9.0), ("a", "VolumeBytesUsed", None, 1073741824.0 * 10), ("a", "VolumeReadIOPs", 1.0, 1.0)],
                                  "source_id string, metric string, average double, maximum double")
    r = sz.source_cost(stats).first()
    assert (r["compute_cost"], r["storage_cost"], r["io_cost"], r["source_monthly"]) == (86.4, 1.0, 0.52, 87.92)
    assert sz.source_cost(stats.where("metric <> 'ServerlessDatabaseCapacity'")).first()["compute_unknown"]


@pytest.mark.parametrize("col,target", [
    (("nvarchar", 100, None, None), "VARCHAR(50)"), (("varchar", 100, None, None), "VARCHAR(100)"), (("nvarchar", -1, None, None), "LONGTEXT"),
    (("varbinary", -1, None, None), "LONGBLOB"), (("DECIMAL", None, None, None), "DECIMAL(18,0)"), (("numeric", None, 10, 2), "DECIMAL(10,2)"),
    (("datetime2", None, None, 7), "DATETIME(6)"), (("datetime2", None, None, 0), "DATETIME(0)"), (("datetime2", None, None, None), "DATETIME(6)"),
    (("money", None, None, None), "DECIMAL(19,4)"), (("odd", None, None, None), "ODD"), (("", None, None, None), "TEXT"), ((None, None, None, None), "TEXT")])
def test_types(spark, col, target):
    df = spark.createDataFrame([col], "data_type string, max_length int, num_precision int, num_scale int")
    assert mp.map_types(df).first()["target_type"] == target


def test_names(spark):
    df = spark.createDataFrame([("db", "DBO", "a"), ("db", "sales", "a")], "source_id string, schema_name string, table_name string")
    assert {r["target_table"] for r in mp.map_names(df, "prefix").collect()} == {"a", "sales_a"}
    assert mp.name_collisions(mp.map_names(df, "flatten")).count() == 2
    assert mp.name_collisions(mp.map_names(df, "database")).count() == 0
    with pytest.raises(ValueError):
        mp.map_names(df, "other")


def test_conform_never_aborts(spark):
    fields = [mp.field_for("a", "TINYINT UNSIGNED"), mp.field_for("b", "VARCHAR(2)", nullable=False), mp.field_for("c", "DECIMAL(5,2)"), mp.field_for("d", "DATETIME(6)")]
    df = spark.createDataFrame([("1", "x", "1.25", "2024-01-01 10:00:00"), ("300", "xyz", "1.255", "never"), ("x", None, "99999", None)], "a string, b string, c string, d string")
    good, bad = mp.conform(df, fields)
    assert good.count() == 1 and good.schema["a"].dataType.simpleString() == "smallint"
    assert sorted((r["column_name"], r["reason"]) for r in bad.collect()) == [
        ("a", "bad_value"), ("a", "overflow"), ("b", "null_not_allowed"), ("b", "too_long"), ("c", "bad_value"), ("c", "loses_digits"), ("d", "bad_value")]


def test_conform_loses_nothing(spark):
    fields = [mp.field_for("a", "BIGINT"), mp.field_for("b", "DATE"), mp.field_for("c", "DATETIME(3)"), mp.field_for("d", "DECIMAL(30,12)"), mp.field_for("e", "DECIMAL(65,30)"),
              mp.field_for("f", "DOUBLE"), mp.field_for("id", "INT")]
    df = spark.createDataFrame([
        (1, 2.0, "2024-01-01 00:00:00", "2024-01-01 10:00:00.123", "0.123456789012", "12345678901234567890123456789012345.5", 5),
        (2, 1.9, "2024-01-01 13:00:00", "2024-01-01 10:00:00.1234", "0.123456789012345678", "1e3", 9007199254740993)],
        "id int, a double, b string, c string, d string, e string, f long").withColumns({"b": F.col("b").cast("timestamp"), "c": F.col("c").cast("timestamp"), "d": F.col("d").cast("decimal(38,18)")})
    good, bad = mp.conform(df, fields)
    assert [r["id"] for r in good.collect()] == [1] and good.first()["e"] == "12345678901234567890123456789012345.5"
    assert sorted((r["id"], r["column_name"], r["reason"]) for r in bad.collect()) == [
        (2, "a", "loses_digits"), (2, "b", "loses_digits"), (2, "c", "loses_digits"), (2, "d", "loses_digits"), (2, "e", "overflow"), (2, "f", "loses_digits")]


@pytest.mark.parametrize("host,label", [("LOCALHOST", "localhost"), ("x::1", "localhost"), ("a.cluster-ro-x.rds.amazonaws.com", "aws-aurora"),
                                        ("a.rds.amazonaws.com", "aws-rds"), ("db.example.org", "other")])
def test_hosts(spark, host, label):
    assert spark.createDataFrame([(host,)], "h string").select(rl.anonymize_host(F.col("h"))).first()[0] == label
