"""A validation run over several tables: structure first, then rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.functions.comparing import comparable
from crossover.operators import validate as v


class CheckFailed(Exception):
    """Raised when a run was asked to fail on mismatches and found some."""


@dataclass
class CheckResult:
    """Frames of one run; all stay lazy. ``tables`` and ``summary`` are None for a run over structure alone."""

    missing_tables: DataFrame
    column_issues: DataFrame
    tables: DataFrame | None
    summary: DataFrame | None

    def passed(self) -> bool:
        """Runs the check. Each part yields a few rows at most."""
        if self.missing_tables.limit(1).count() or self.column_issues.where("issue <> 'conditional_match'").limit(1).count():
            return False
        return self.summary is None or self.summary.first()["passed"]


def select_names(names: list[str], include: list[str] | None, exclude: list[str] | None) -> list[str]:
    """Tables of a run. ``None`` and ``['*']`` mean all; exclusions apply in every case."""
    chosen = names if not include or include == ["*"] else [n for n in names if n in set(include)]
    return [n for n in chosen if n not in set(exclude or [])]


def table_figures(name: str, s: DataFrame, t: DataFrame, key: list[str] | None, sample_rate: float = 1.0, trim: bool = True) -> DataFrame:
    """Row figures of one table over the columns of both sides; a column that one side lacks is an issue of the table."""
    both = [c for c in s.columns if c in t.columns]
    whole = len(both) == len(s.columns) == len(t.columns)
    # Without a key the whole row is the key: leftovers are then missing or extra rows, never mismatches.
    key = key or both
    if sample_rate < 1.0:
        s, t, _ = comparable(s, t, key, both, trim)
        s, t = v.sample_keys(s, key, sample_rate), v.sample_keys(t, key, sample_rate)
    out = v.diff_summary(s, t, key, both, trim=trim, table=name)
    return out if whole else out.withColumn("status", F.lit("issues_found"))


def check(
    source: dict[str, DataFrame],
    target: dict[str, DataFrame],
    keys: dict[str, list[str]],
    mapping: dict[str, str] | None = None,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    schema_only: bool = False,
    sample_rate: float = 1.0,
    trim: bool = True,
    fail_on_mismatch: bool = False,
    conditional: DataFrame | None = None,
    strict: bool = False,
) -> CheckResult:
    """Compare ``source`` and ``target`` table by table; ``strict`` also the order, nullability and defaults of columns.

    ``mapping`` gives the target name of a source table. A table without ``keys`` is compared as a bag of rows.
    """
    mapping = mapping or {}
    spark = next(iter(source.values())).sparkSession
    names = select_names(list(source), include, exclude)
    back = {mapping.get(n, n): n for n in names}
    excluded = set(exclude or [])
    # Target names as the source knows them; tables the run leaves out are left out on both sides.
    renamed = {back.get(n, n): df for n, df in target.items()
               if n in back or (not include or include == ["*"]) and n not in excluded}
    left = {n: source[n] for n in names}

    def catalog(tables: dict[str, DataFrame]) -> DataFrame:
        return v.columns_of(spark, tables)

    s_cols, t_cols = catalog(left), catalog(renamed)
    missing = v.compare_tables(s_cols.select("table_name").distinct(), t_cols.select("table_name").distinct(), ["table_name"])
    columns = v.compare_columns(s_cols, t_cols, ["table_name"], conditional, strict)
    if schema_only:
        result = CheckResult(missing, columns, None, None)
    else:
        parts = []
        for name in names:
            if name not in renamed:
                continue
            parts.append(table_figures(name, left[name], renamed[name], keys.get(name), sample_rate, trim))
        tables = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], v.SUMMARY_SCHEMA)
        result = CheckResult(missing, columns, tables, v.check_summary(tables))
    if fail_on_mismatch and not result.passed():
        raise CheckFailed("source and target differ")
    return result


ABSENT = "absent_on_target"


def run_check(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]], path: str, token: str, concurrency: int = 16,
              trim: bool = True, mapping: dict[str, str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None,
              sample_rate: float = 1.0, fail_on_mismatch: bool = False) -> DataFrame:
    """Check many tables side by side, one Spark job each, and keep every table's figures below ``path``.

    One plan over thousands of tables would be too large. A run that is started again with the same ``token`` goes on with the
    tables that it has not finished; another token is another run. Returns one row for each table of this call, also for those
    that the target lacks.
    """
    mapping = mapping or {}
    spark = next(iter(source.values())).sparkSession
    names = select_names(list(source), include, exclude)
    run = f"{path}/run={quote(token, safe='')}"
    done = _finished(spark, run)

    def one(name: str) -> None:
        s, t = source[name], target.get(mapping.get(name, name))
        if t is None:
            empty = [F.lit(None).cast("bigint").alias(c) for c in ("target_rows", "rows_matching", "rows_missing", "rows_mismatched", "rows_extraneous")]
            row = s.agg(F.count(F.lit(1)).alias("source_rows")).select(F.lit(name).alias("table_name"), "source_rows", *empty, F.lit(ABSENT).alias("status"))
        else:
            row = table_figures(name, s, t, keys.get(name), sample_rate, trim)
        row.coalesce(1).write.mode("overwrite").parquet(f"{run}/table={quote(name, safe='')}")

    with ThreadPoolExecutor(concurrency) as pool:
        list(pool.map(one, [n for n in names if n not in done]))
    # A folder for each table: Spark takes two reads of one folder for the same, and a plan over both would get the first one's files.
    folders = [f"{run}/table={quote(n, safe='')}" for n in names]
    found = spark.read.schema(v.SUMMARY_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders) if folders else spark.createDataFrame([], v.SUMMARY_SCHEMA)
    if fail_on_mismatch and not found.where("status <> 'verified'").isEmpty():
        raise CheckFailed("source and target differ")
    return found


def _finished(spark, run: str) -> set[str]:
    """Tables of a run with figures, read in one job; one name for each."""
    try:
        rows = spark.read.schema(v.SUMMARY_SCHEMA).option("recursiveFileLookup", "true").parquet(run)
        return {r["table_name"] for r in rows.select("table_name").collect()}
    except AnalysisException:
        return set()


def mismatches(result: CheckResult) -> DataFrame:
    """All findings of a run as one long frame (table, issue, details)."""
    out = result.missing_tables.select("table_name", "issue", F.lit(None).cast("string").alias("details"))
    cols = result.column_issues.select(
        "table_name", "issue",
        F.concat_ws(" ", "column_name", F.coalesce("source_type", F.lit("-")), F.coalesce("target_type", F.lit("-"))).alias("details"))
    out = out.unionByName(cols)
    if result.tables is not None:
        rows = result.tables.where("status <> 'verified'").select(
            "table_name", F.lit("row_hash").alias("issue"),
            F.format_string("missing=%d mismatched=%d extraneous=%d", "rows_missing", "rows_mismatched", "rows_extraneous").alias("details"))
        out = out.unionByName(rows)
    return out
