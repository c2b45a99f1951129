"""How much of a migration runs by itself, with help, or by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.functions.constants import AUTOMATION_WEIGHTS, MYSQL_SPATIAL_TYPES
from crossover.functions.text import lookup


def automation_mysql(sources: DataFrame, tables: DataFrame, fks: DataFrame, indexes: DataFrame, modules: DataFrame,
                     difficulty: DataFrame, jobs: DataFrame, columns: DataFrame, analysis: DataFrame | None = None) -> DataFrame:
    """Shares in percent. Objects are counted per source and class, then weighted; no objects means all automatic."""
    key = ["source_id", "schema_name", "name"]
    procedures = (modules.where("kind = 'routine' and routine_type = 'PROCEDURE'").select(*key)
                  .join(difficulty.where("kind = 'routine'").select(*key, "difficulty"), key, "left"))
    if analysis is not None:
        procedures = (procedures.join(analysis.select(*key, F.col("difficulty").alias("given")), key, "left")
                      .withColumn("difficulty", F.coalesce("given", "difficulty")))
    spatial = columns.where(F.lower("data_type").isin(MYSQL_SPATIAL_TYPES))
    fulltext = indexes.where(F.upper("index_type") == "FULLTEXT")

    def count(df: DataFrame, kind) -> DataFrame:
        return df.groupBy("source_id", kind.alias("object_class")).agg(F.count(F.lit(1)).alias("n"))

    objects = reduce(DataFrame.unionByName, [
        count(tables, F.lit("table")), count(fks, F.lit("foreign_key")), count(fulltext, F.lit("fulltext_index")),
        count(procedures, F.concat(F.lit("procedure_"), "difficulty")), count(modules.where("kind = 'trigger'"), F.lit("trigger")),
        count(jobs, F.lit("event")), count(spatial, F.lit("spatial_column"))])

    def weight(i: int):
        return F.sum(F.col("n") * lookup({k: w[i] for k, w in AUTOMATION_WEIGHTS.items()}, F.col("object_class")))

    w = objects.groupBy("source_id").agg(weight(0).alias("a"), weight(1).alias("b"), weight(2).alias("c"))
    total = F.col("a") + F.col("b") + F.col("c")

    def share(c: str, empty: float):
        return F.coalesce(F.bround(F.try_divide(F.col(c), total) * 100, 1), F.lit(empty))

    return sources.select("source_id").distinct().join(w, "source_id", "left").select(
        "source_id", share("a", 100.0).alias("automatic_pct"), share("b", 0.0).alias("assisted_pct"), share("c", 0.0).alias("manual_pct"))


def automation_mssql(checklist: DataFrame, issue_totals: DataFrame, feature_totals: DataFrame) -> DataFrame:
    """Linear shares with caps; they may add up to more than 100."""
    blockers = issue_totals.select("source_id", "blocker_count")
    uses = feature_totals.groupBy("source_id").agg(F.sum("match_count").alias("uses"))
    facts = checklist.join(blockers, "source_id", "left").join(uses, "source_id", "left").fillna(0, ["blocker_count", "uses"])
    routines = F.col("stored_procedure_count") + F.col("function_count")
    manual = F.least(F.lit(85.0), (F.col("blocker_count") * 2 + F.col("trigger_count") * 3 + F.col("assembly_count") * 4).cast("double"))
    assisted = F.least(F.lit(70.0), (routines + F.floor(F.col("uses") / 5)).cast("double"))
    return facts.select("source_id", F.greatest(F.lit(0.0), F.lit(100.0) - manual - assisted).alias("automatic_pct"),
                        assisted.alias("assisted_pct"), manual.alias("manual_pct"))
