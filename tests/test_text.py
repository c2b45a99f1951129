"""Regex features against Python's own."""

import re

import pytest
from pyspark.sql import functions as F

from crossover.functions.constants import TSQL_PATTERNS
from crossover.functions.text import lines_of_code
from crossover.operators import features as feat
from tests.conftest import rows

TEXTS = [
    "MERGE a merge into #tmp #x scope_identity() value(1) .query (", "x" * 30 + "MERGE" + "y" * 30, "", "no", None,
    "é merge \U0001F600 MERGE\nMERGE\r\n  \x85 a b", "  \n\n a \n\x1c\n b", "émerge merge" * 3,
    "BEGIN TRY begin\ttran SEND ON CONVERSATION pıvot CURſOR hold lock", "PIVOT unpivot NEXT  VALUE\nFOR s option ( output READONLY",
    "select * from a for xml path, FOR XML; nodes (x) exist(y)", "NOLOCK HOLDLOCK rİserror",
]


@pytest.fixture()
def modules(spark):
    return spark.createDataFrame([("db1", "routine", "dbo", str(i), t) for i, t in enumerate(TEXTS)],
                                 "source_id string, kind string, schema_name string, name string, definition string")


def test_contexts(modules):
    want = sorted((f"dbo.{i}", name, t[max(0, m.start() - 20):m.end() + 20]) for i, t in enumerate(TEXTS) if t
                  for name, p in TSQL_PATTERNS.items() for m in re.finditer(p, t, re.I))
    got = rows(feat.scan_features(modules).select("object_name", "pattern_name", "matched_text"))
    assert got == sorted(want, key=str)


def test_counts_with_and_without_word_search(modules):
    want = {(f"dbo.{i}", name): n for i, t in enumerate(TEXTS) if t for name, p in TSQL_PATTERNS.items() if (n := len(re.findall(p, t, re.I)))}
    for patterns in (None, dict(TSQL_PATTERNS)):
        got = {(r["object_name"], r["pattern_name"]): r["match_count"] for r in feat.feature_counts(modules, patterns).collect()}
        assert got == want


def test_lines(modules):
    got = {r[0]: r[1] for r in modules.select("name", lines_of_code(F.coalesce("definition", F.lit("")))).collect()}
    assert got == {str(i): len([x for x in (t or "").splitlines() if x.strip()]) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("end", list("\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") + ["\r\n"])
def test_lines_of_every_end(spark, end):
    text = end.join(["a b", "", " \t\u3000", "c\x1f", "  d"])
    assert routine(spark, text).select(lines_of_code(F.col("definition"))).first()[0] == 3


def test_difficulty_keyword_reads_a_text_once(spark, capsys):
    """Upper case and lines come from a projection below; in one with the level they were worked out for each of its tests."""
    feat.difficulty_keyword(routine(spark, "BEGIN")).explain()
    plan = capsys.readouterr().out
    assert plan.count("upper(") == 1 and plan.count("size(regexp_extract_all(") == 2


def routine(spark, text):
    return spark.createDataFrame([("db1", "routine", "s", "n", text)], "source_id string, kind string, schema_name string, name string, definition string")


@pytest.mark.parametrize("text,level", [
    (None, "simple"), ("BEGIN\nEND", "trivial"), ("CALL p()", "complex"), ("x\n" * 101 + "EXECUTE s", "requires_redesign"), ("DECLARE c CURSOR", "moderate"),
    ("a\n" * 15, "simple"), ("a\n" * 40 + "TEMPORARY", "moderate"), ("a\n" * 40, "simple"), ("IF x WHILE y ", "simple"), ("a\n" * 100, "moderate")])
def test_difficulty_keyword(spark, text, level):
    assert feat.difficulty_keyword(routine(spark, text)).first()["difficulty"] == level


@pytest.mark.parametrize("text,level,points", [
    ("SELECT 1", "trivial", 1), ("SELECT 1\n" * 20, "simple", 2), ("DECLARE a CURSOR\nDECLARE b CURSOR", "moderate", 3),
    ("DECLARE a CURSOR\n" * 6, "complex", 5), ("EXEC dbo.p\n" * 20, "requires_redesign", 5)])
def test_difficulty_tsql(spark, text, level, points):
    r = feat.difficulty_tsql(routine(spark, text)).first()
    assert (r["difficulty"], r["points"]) == (level, points)


def test_query_issues(spark):
    log = spark.createDataFrame([("db1", 1, "xa  start ?", 5), ("db1", 2, " ", 1), ("db1", 3, "SELECT GET_LOCK(?), st_area(x)", 2), ("db1", 4, "SELECT 1", 3), ("db1", 5, None, 3)],
                                "source_id string, digest_id int, digest_text string, count_star long")
    got = {(r["digest_id"], r["construct"]) for r in feat.query_issues(log).collect()}
    assert got == {(1, "XA_TRANSACTION"), (3, "GET_LOCK"), (3, "SPATIAL")}
    share = feat.unmodified_share(log).first()
    assert (share["statements"], share["clean_statements"], share["clean_executions"]) == (3, 1, 3)
    strict = spark.createDataFrame([("db1", 1, "UPDATE t SET a = (SELECT 1)", 1), ("db1", 2, "SAVEPOINT s", 1)], log.schema)
    assert {r["construct"] for r in feat.query_issues(strict, strict=True).collect()} == {"NESTED_DML", "SAVEPOINT"}


def test_function_usage_mysql(spark):
    got = rows(feat.function_usage(routine(spark, "SELECT ST_Area(x), st_area (y), now()"), "mysql").select("function_name", "call_count", "handling"))
    assert got == [("ST_AREA", 2, "redesign")]
