"""Reports: a small summary document per source, and the long lists as partitioned JSON lines.

Lists are never collected into a document: a source may hold a third of all objects. They are written next to the
summaries, split by section, and read back as frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.functions.hashing import fingerprint
from crossover.operators.runlogs import anonymize_host


def run_summary(sources: DataFrame, totals: DataFrame, issue_totals: DataFrame, scores: DataFrame, ratings: DataFrame, automation: DataFrame) -> DataFrame:
    """Numbers and classes only, one row per source: fit for sharing."""
    categories = [r for r in ("schema_compatibility", "data_complexity", "query_compatibility", "procedural_code", "code_portability", "operational_readiness")]
    wide = scores.groupBy("source_id").pivot("category", categories).agg(F.first("score"))
    parts = [totals.select("source_id", "table_count", "total_rows", F.round("total_data_mb", 2).alias("total_data_mb")), issue_totals, wide, ratings,
             automation.select("source_id", F.round(F.col("automatic_pct") + F.col("assisted_pct"), 1).alias("automation_pct"))]
    host = [anonymize_host(F.col("host")).alias("source_type")] if "host" in sources.columns else []
    base = sources.select("source_id", fingerprint(F.col("source_id")).alias("database_fingerprint"), *host)
    out = reduce(lambda a, b: a.join(b, "source_id", "left"), parts, base)
    return out.fillna(0, ["table_count", "total_rows", "blocker_count", "warning_count", "info_count"])


def scan_documents(sources: DataFrame, summary: DataFrame, scores: DataFrame, largest: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """One JSON document per source. All parts are bounded: a summary, five scores, the top tables and the cost."""
    per_score = scores.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "category", F.struct("score", F.col("max_score").alias("max"), "deduction_count")))).alias("scores"))
    top = largest.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "rank", F.struct(F.col("schema_name").alias("schema"), F.col("table_name").alias("table"), F.col("table_rows").alias("rows"), "data_mb", "total_mb")))),
        lambda x: x["col2"]).alias("largest_tables"))
    body = summary.select("source_id", F.struct(*[c for c in summary.columns if c != "source_id"]).alias("summary"))
    parts = [body, per_score, top] + ([cost.select("source_id", F.struct(*[c for c in cost.columns if c != "source_id"]).alias("cost_analysis"))] if cost is not None else [])
    doc = reduce(lambda a, b: a.join(b, "source_id", "left"), parts, sources.select("source_id").distinct())
    return doc.select("source_id", F.to_json(F.struct(*doc.columns)).alias("document"))


def write_lists(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Inventory, issues, deductions and the like as JSON lines, one folder per section."""
    for name, df in sections.items():
        df.write.mode(mode).json(f"{path}/{name}")


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)


def write_check(result, path: str, mode: str = "overwrite") -> None:
    """Check report: per-table figures, the totals and the findings. The rows are compared once: totals and findings read the written figures."""
    from crossover.operators.validate import SUMMARY_SCHEMA, check_summary
    from crossover.plans.check import CheckResult, mismatches

    if result.tables is not None:
        result.tables.write.mode(mode).json(f"{path}/tables")
        tables = result.tables.sparkSession.read.schema(SUMMARY_SCHEMA).json(f"{path}/tables")
        result = CheckResult(result.missing_tables, result.column_issues, tables, check_summary(tables))
        result.summary.write.mode(mode).json(f"{path}/summary")
    mismatches(result).write.mode(mode).json(f"{path}/mismatches")
