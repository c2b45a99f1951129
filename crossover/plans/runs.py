"""One check run with all its parts: structure, counts, checksums, rows, samples, and a report of them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossover.operators import validate as v
from crossover.plans.check import ABSENT, CheckFailed, select_names, table_figures

FIGURES = v.SUMMARY_SCHEMA + ", checksum_matches boolean"
SAMPLES = "table_name string, status string, rank int, key string, row_count bigint"
FINDINGS = "table_name string, issue string, details string"
COLUMNS = "table_name string, column_name string, source_type string, target_type string, compared boolean"
SECTIONS = {"tables": FIGURES, "findings": FINDINGS, "samples": SAMPLES, "columns": COLUMNS}
#: Findings that do not fail a run.
HARMLESS = ("conditional_match",)


@dataclass
class Run:
    """The written sections of a run, and its totals (None for a run over structure alone)."""

    tables: DataFrame
    findings: DataFrame
    samples: DataFrame
    columns: DataFrame
    summary: DataFrame | None

    def passed(self) -> bool:
        return self.findings.where(~F.col("issue").isin(*HARMLESS)).isEmpty()


def _table(spark: SparkSession, name: str, s: DataFrame, t: DataFrame | None, key: list[str] | None, run: str, sample_rate: float, sample: int, trim: bool) -> None:
    """Figures of one table, written last so that their presence means that the table is done. Equal checksums over all rows settle a
    table without a shuffle; only others are compared row by row."""
    part = f"table={quote(name, safe='')}"
    if t is None:
        empty = [F.lit(None).cast("bigint").alias(c) for c in ("target_rows", "rows_matching", "rows_missing", "rows_mismatched", "rows_extraneous")]
        figures = s.agg(F.count(F.lit(1)).alias("source_rows")).select(F.lit(name).alias("table_name"), "source_rows", *empty, F.lit(ABSENT).alias("status"), F.lit(None).cast("boolean").alias("checksum_matches"))
    else:
        both = [c for c in s.columns if c in t.columns]
        pair = v.checksum_pair(s, t, both, trim).first() if sample_rate >= 1.0 else None
        if pair is not None and pair["matches"] and len(both) == len(s.columns) == len(t.columns):
            n = pair["source_count"]
            figures = spark.createDataFrame([(name, n, n, n, 0, 0, 0, "verified", True)], FIGURES)
        else:
            figures = table_figures(name, s, t, key, sample_rate, trim).withColumn("checksum_matches", F.lit(None if pair is None else pair["matches"]).cast("boolean"))
        if sample and not (pair is not None and pair["matches"]):
            diff = v.diff_rows(s, t, key or both, both, trim)
            first = v.mismatch_sample(diff, key or both, sample)
            first.select(F.lit(name).alias("table_name"), "status", F.col("rank").cast("int").alias("rank"), F.to_json(F.struct(*[F.col(f"`{k}`") for k in key or both])).alias("key"), "row_count").coalesce(1).write.mode(
                "overwrite").parquet(f"{run}/samples/{part}")
    figures.coalesce(1).write.mode("overwrite").parquet(f"{run}/figures/{part}")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def table_findings(figures: DataFrame) -> DataFrame:
    """What the figures of tables say: counts with their band, checksums, rows."""
    there = figures.where(F.col("status") != ABSENT)
    counts = v.count_bands(v.compare_counts(there.select("table_name", F.col("source_rows").alias("row_count")), there.select("table_name", F.col("target_rows").alias("row_count")), ["table_name"]))
    moved = counts.where(~F.col("matches")).select("table_name", F.lit("row_count").alias("issue"),
                                                   F.format_string("source=%d target=%d band=%s", "source_count", "target_count", "band").alias("details"))
    sums = there.where(~F.col("checksum_matches")).select("table_name", F.lit("checksum").alias("issue"), F.lit(None).cast("string").alias("details"))
    wrong = F.col("rows_missing") + F.col("rows_mismatched") + F.col("rows_extraneous")
    rows = there.where(wrong > 0).select("table_name", F.lit("row_hash").alias("issue"),
                                         F.format_string("missing=%d mismatched=%d extraneous=%d", "rows_missing", "rows_mismatched", "rows_extraneous").alias("details"))
    return moved.unionByName(sums).unionByName(rows)


def compared_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every column of tables that both sides have, and whether its values are compared."""
    both = source.select("table_name").distinct().join(target.select("table_name").distinct(), "table_name")
    s = source.select("table_name", "column_name", F.col("data_type").alias("source_type"))
    t = target.select("table_name", "column_name", F.col("data_type").alias("target_type"))
    pairs = s.join(t, ["table_name", "column_name"], "full_outer").join(both, "table_name", "left_semi")
    return pairs.withColumn("compared", F.col("source_type").isNotNull() & F.col("target_type").isNotNull())


def full_run(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]], path: str, token: str, mapping: dict[str, str] | None = None,
             include: list[str] | None = None, exclude: list[str] | None = None, schema_only: bool = False, strict: bool = True, conditional: DataFrame | None = None,
             sample_rate: float = 1.0, sample: int = 10, trim: bool = True, concurrency: int = 16, fail_on_mismatch: bool = False,
             source_columns: DataFrame | None = None, target_columns: DataFrame | None = None) -> Run:
    """Check tables side by side, a few Spark jobs each, and write the report below ``path``.

    Structure: missing and extra tables and columns, types, and with ``strict`` order, nullability and defaults; catalogs other than the frames'
    own schemas may be given (target tables by their own names). Rows: counts, checksums, differences, and the first ``sample`` keys per
    kind of difference. ``schema_only`` stops after structure. Started again with the same token, a run goes on with the tables it has not
    finished.
    """
    mapping, excluded = mapping or {}, set(exclude or [])
    spark = next(iter(source.values())).sparkSession
    names = select_names(list(source), include, exclude)
    back = {mapping.get(n, n): n for n in names}
    every = not include or include == ["*"]
    renamed = {back.get(n, n): df for n, df in target.items() if n in back or every and n not in excluded}
    run = f"{path}/run={quote(token, safe='')}"

    def catalog(given: DataFrame | None, tables: dict[str, DataFrame], names_back: dict[str, str]) -> DataFrame:
        if given is None:
            return v.columns_of(spark, tables)
        names_back = {**{n: n for n in tables}, **names_back}
        known = spark.createDataFrame([(a, b) for a, b in names_back.items() if b in tables] or [("", "")], "table_name string, known string")
        return given.join(known, "table_name").drop("table_name").withColumnRenamed("known", "table_name")

    s_cols, t_cols = catalog(source_columns, {n: source[n] for n in names}, {}), catalog(target_columns, renamed, back)
    missing = v.compare_tables(s_cols.select("table_name").distinct(), t_cols.select("table_name").distinct(), ["table_name"])
    columns = v.compare_columns(s_cols, t_cols, ["table_name"], conditional, strict)
    structure = missing.select("table_name", "issue", F.lit(None).cast("string").alias("details")).unionByName(columns.select(
        "table_name", "issue", F.concat_ws(" ", "column_name", F.coalesce("source_type", F.lit("-")), F.coalesce("target_type", F.lit("-"))).alias("details")))
    if not schema_only:
        done = {r["table_name"] for r in _read(spark, f"{run}/figures", FIGURES).select("table_name").collect()}  # one name for each table of the run
        with ThreadPoolExecutor(concurrency) as pool:
            list(pool.map(lambda n: _table(spark, n, source[n], renamed.get(n), keys.get(n), run, sample_rate, sample, trim), [n for n in names if n not in done]))
    chosen = F.col("table_name").isin(names)
    figures = _read(spark, f"{run}/figures", FIGURES).where(chosen)
    sections = {"tables": figures, "findings": structure.unionByName(table_findings(figures)), "samples": _read(spark, f"{run}/samples", SAMPLES).where(chosen),
                "columns": compared_columns(s_cols, t_cols)}
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{run}/report/{name}")
    result = read_run(spark, path, token)
    if result.summary is not None:
        result.summary.write.mode("overwrite").json(f"{run}/report/summary")
    if fail_on_mismatch and not result.passed():
        raise CheckFailed("source and target differ")
    return result


def read_run(spark: SparkSession, path: str, token: str) -> Run:
    """The report of a run as written."""
    folder = f"{path}/run={quote(token, safe='')}/report"
    sections = {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in SECTIONS.items()}
    return Run(**sections, summary=None if sections["tables"].isEmpty() else v.check_summary(sections["tables"].drop("checksum_matches")))
