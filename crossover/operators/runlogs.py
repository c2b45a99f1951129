"""Run logs, audit logs and usage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossover.functions.constants import HOST_RULES
from crossover.functions.text import lookup


def runs(events: DataFrame, by: str = "run_id") -> DataFrame:
    """One row per run: first time and phase, last outcome, and the last event's overall score or else its score."""
    first = F.min_by(F.struct("ts", "phase"), "line_no")
    last = F.max_by(F.struct("outcome", F.coalesce("overall_score", "score").alias("score")), "line_no")
    r = events.groupBy(by).agg(first.alias("a"), last.alias("z"), F.count(F.lit(1)).alias("events"))
    return r.select(by, F.col("a.ts").alias("started_at"), F.col("a.phase").alias("phase"), F.col("z.outcome").alias("outcome"),
                    F.col("z.score").alias("score"), "events")


def latest_run(events: DataFrame, by: str = "run_id") -> DataFrame:
    """All events of the run whose name sorts last."""
    return events.join(events.agg(F.max(by).alias(by)), by, "left_semi")


def anonymize_host(host: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """Class of a host name; the first rule with a part that occurs in it wins."""
    low = F.lower(host)
    out = None
    for label, parts in rules or HOST_RULES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


def phase_stats(events: DataFrame) -> DataFrame:
    """Durations and share of errors per phase and step."""
    return events.groupBy("phase", "step").agg(
        F.count(F.lit(1)).alias("events"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.sum("duration_ms").alias("total_ms"), F.percentile_approx("duration_ms", F.lit(0.5)).alias("median_ms"),
        F.avg((F.col("outcome") == "error").cast("double")).alias("error_rate"))


def audit_stats(audit: DataFrame) -> DataFrame:
    return audit.groupBy("tool", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- usage logs ---------------------------------------------------------------------------------------------------

def session_of(file: Column) -> Column:
    """Logs of helpers lie in a folder below the session they belong to."""
    return F.regexp_replace(F.split_part(file, F.lit("/"), F.lit(1)), r"\.jsonl$", "")


def is_sub(file: Column) -> Column:
    return file.contains("/subagents/")


def classify_sessions(log: DataFrame, rules: list[tuple[str, list[str]]], depth: int = 10) -> DataFrame:
    """Label of each session by keywords in its first ``depth`` user messages; the first rule that applies wins.

    The messages are joined by blanks in their order, so a keyword may span two of them.
    """
    own = log.where((F.col("role") == "user") & ~is_sub(F.col("file_name")))
    w = Window.partitionBy("file_name").orderBy("line_no")
    first = own.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= depth)
    parts = F.array_sort(F.collect_list(F.struct("_n", F.lower("content").alias("t"))))
    text = first.groupBy(session_of(F.col("file_name")).alias("session_id")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("t"))
    label = None
    for name, words in rules:
        hit = F.col("t").contains(words[0].lower())
        for word in words[1:]:
            hit = hit | F.col("t").contains(word.lower())
        label = F.when(hit, name) if label is None else label.when(hit, name)
    sessions = log.select(session_of(F.col("file_name")).alias("session_id")).distinct()
    return sessions.join(text, "session_id", "left").select("session_id", F.coalesce(label, F.lit("other")).alias("project"))


TOKENS = ["input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens"]


def usage_by_session(log: DataFrame) -> DataFrame:
    """Tokens and calls per session, its helpers included, with the number of helpers and the models in use."""
    answers = log.where("role = 'assistant'")
    return (answers.groupBy(session_of(F.col("file_name")).alias("session_id")).agg(
        *[F.sum(t).alias(t) for t in TOKENS], F.count(F.lit(1)).alias("api_calls"),
        F.array_sort(F.collect_set("model")).alias("models"))
        .join(log.where(is_sub(F.col("file_name"))).select(session_of(F.col("file_name")).alias("session_id"), "file_name").distinct()
              .groupBy("session_id").agg(F.count(F.lit(1)).alias("sub_sessions")), "session_id", "left")
        .fillna(0, ["sub_sessions"]))


def with_cost(usage: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Cost from prices per million tokens."""
    total = None
    for t in TOKENS:
        part = F.col(t) / 1000000 * prices[t]
        total = part if total is None else total + part
    return usage.withColumn("cost", total)


def usage_rollup(usage: DataFrame, sessions: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Totals per session with a subtotal per project and a grand total."""
    joined = usage.join(sessions, "session_id")
    totals = joined.rollup("project", "session_id").agg(
        F.grouping_id().alias("level"), *[F.sum(t).alias(t) for t in TOKENS], F.sum("api_calls").alias("api_calls"),
        F.sum("sub_sessions").alias("sub_sessions"), F.count(F.lit(1)).alias("sessions"))
    kinds = {0: "session", 1: "project", 3: "total"}
    return with_cost(totals, prices).withColumn("level", lookup(kinds, F.col("level").cast("int")))
