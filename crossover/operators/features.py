"""Constructs in module text and in query logs, found with literal regexes over whole texts.

Every pattern is a literal expression in one projection, so a text is read once and never joined with a pattern table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossover.functions.constants import (
    COMPLEXITY, FUNCTION_MAP, FUNCTIONS_TO_REDESIGN, MYSQL_QUERY_RULES, MYSQL_QUERY_RULES_STRICT, TSQL_PATTERNS, TSQL_WORDS, UNSUPPORTED_FUNCTIONS,
)
from crossover.functions.text import lines_of_code, lookup, match_contexts, match_count, matches, may_match, rows_of, trimmed, with_word_search

OBJECT = ["source_id", "kind", "schema_name", "name"]


def object_name() -> Column:
    return F.concat("schema_name", F.lit("."), "name")


def _words(patterns: dict[str, str] | None) -> dict[str, list[str]]:
    """The search words belong to the default patterns; others are matched without a search."""
    return TSQL_WORDS if patterns is None else {}


def scan_features(modules: DataFrame, patterns: dict[str, str] | None = None, width: int = 20) -> DataFrame:
    """One row per match with its surroundings. The contexts are only worked out for texts that match at all."""
    text, words = F.col("definition"), _words(patterns)
    hits = [F.when(may_match(words.get(name)) & matches(text, p),
                   F.struct(F.lit(name).alias("pattern_name"), match_contexts(text, p, width).alias("contexts")))
            for name, p in (patterns or TSQL_PATTERNS).items()]
    keep = ["source_id", F.col("kind").alias("object_type"), object_name().alias("object_name")]
    found = rows_of(with_word_search(modules, "definition"), keep, *hits)
    return found.select("source_id", "object_type", "object_name", "pattern_name", F.explode("contexts").alias("matched_text"))


def feature_counts(modules: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Number of matches per object and pattern, without contexts."""
    text, words = F.col("definition"), _words(patterns)
    counted = [F.when(may_match(words.get(name)), F.struct(F.lit(name).alias("pattern_name"), match_count(text, p).cast("long").alias("match_count")))
               for name, p in (patterns or TSQL_PATTERNS).items()]
    keep = ["source_id", F.col("kind").alias("object_type"), object_name().alias("object_name")]
    return rows_of(with_word_search(modules, "definition"), keep, *counted).where("match_count > 0")


def feature_totals(counts: DataFrame) -> DataFrame:
    """Matches and objects per source and pattern."""
    return counts.groupBy("source_id", "pattern_name").agg(
        F.sum("match_count").alias("match_count"), F.count(F.lit(1)).alias("object_count"))


# ---- query log ----------------------------------------------------------------------------------------------------

def top_queries(log: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` heaviest statements of each source; each task keeps its own best ``n`` before the shuffle."""
    w = Window.partitionBy("source_id").orderBy(F.desc(by), "digest_id")
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def statements(log: DataFrame) -> DataFrame:
    return log.where(F.length(trimmed(F.coalesce("digest_text", F.lit("")))) > 0)


def _rules(strict: bool) -> list[tuple]:
    return MYSQL_QUERY_RULES + (MYSQL_QUERY_RULES_STRICT if strict else [])


def query_issues(log: DataFrame, rules: list[tuple] | None = None, strict: bool = False) -> DataFrame:
    """One row per statement and construct. Placeholders count as the number 1."""
    text = F.replace("digest_text", F.lit("?"), F.lit("1"))
    hits = [F.when(matches(text, p), F.struct(F.lit(c).alias("construct"), F.lit(sev).alias("severity"), F.lit(advice).alias("advice")))
            for c, p, sev, advice in (rules or _rules(strict))]
    return rows_of(statements(log), ["source_id", "digest_id", "digest_text"], *hits)


def query_issues_mssql(log: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """As above for T-SQL. A statement that cannot be rewritten (``transpile_ok`` is false) makes its issues blockers."""
    text, words = F.col("digest_text"), _words(patterns)
    hits = [F.when(may_match(words.get(name)) & matches(text, p), F.struct(F.lit(name).alias("construct"))) for name, p in (patterns or TSQL_PATTERNS).items()]
    severity = F.when(F.coalesce("transpile_ok", F.lit(True)), "warning").otherwise("blocker").alias("severity")
    keep = ["source_id", "digest_id", F.substring(trimmed(text), 1, 240).alias("query_snippet"), severity]
    return rows_of(with_word_search(statements(log), "digest_text"), keep, *hits)


def unmodified_share(log: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Share of each source's workload without any issue, by statement and by execution."""
    text = F.replace("digest_text", F.lit("?"), F.lit("1"))
    clean = ~F.greatest(*[matches(text, p) for _, p, _, _ in (rules or MYSQL_QUERY_RULES)])
    runs = F.col("count_star")
    totals = statements(log).select("source_id", clean.alias("clean"), runs).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("statements"), F.count_if("clean").alias("clean_statements"),
        F.sum(runs).alias("executions"), F.coalesce(F.sum(F.when(F.col("clean"), runs)), F.lit(0)).alias("clean_executions"))
    return totals.select("*", F.try_divide(F.col("clean_statements") * 1.0, F.col("statements")).cast("double").alias("statement_share"),
                         F.try_divide(F.col("clean_executions") * 1.0, F.col("executions")).cast("double").alias("execution_share"))


# ---- routine complexity -------------------------------------------------------------------------------------------

COMPLEXITY_WORDS = {
    "cursor_count": ["cursor"], "dynamic_sql_count": ["prepare", "execute"], "temp_table_count": ["temporary"],
    "control_flow_count": ["if", "while", "loop", "case"], "nested_calls": ["call"],
    "transaction_statements": ["transaction", "commit", "rollback", "savepoint"],
}


def _count_if_any(text: Column, pattern: str, words: list[str]) -> Column:
    return F.when(may_match(words), match_count(text, pattern)).otherwise(0)


def module_complexity(modules: DataFrame) -> DataFrame:
    """Lines of code and keyword counts per object. Patterns of one counter never overlap, so one alternation counts all."""
    text = F.coalesce("definition", F.lit(""))
    return with_word_search(modules, "definition").select(
        *OBJECT, lines_of_code(text).alias("loc"),
        *[_count_if_any(text, "|".join(ps), COMPLEXITY_WORDS[name]).alias(name) for name, ps in COMPLEXITY.items()])


def difficulty_counts(complexity: DataFrame) -> DataFrame:
    """Difficulty from the counters of :func:`module_complexity`."""
    loc, cursors = F.col("loc"), F.col("cursor_count")
    heavy = (F.col("dynamic_sql_count") > 0) | (F.col("nested_calls") > 0)
    return complexity.withColumn("difficulty", _difficulty(loc, heavy, cursors > 0, F.col("control_flow_count"), F.col("temp_table_count") > 0))


def _difficulty(loc: Column, heavy: Column, has_cursor: Column, control_flow: Column, has_temp: Column) -> Column:
    return (F.when(heavy & (loc > 100), "requires_redesign").when(heavy, "complex")
            .when((loc < 10) & ~has_cursor & (control_flow <= 1), "trivial")
            .when((loc < 30) & ~has_cursor, "simple")
            .when(has_cursor | has_temp | (loc >= 100), "moderate").otherwise("simple"))


def difficulty_keyword(modules: DataFrame) -> DataFrame:
    """Difficulty from plain substrings; control flow counts kinds of keywords, not uses. No text means simple."""
    up, loc = F.col("_up"), F.col("_loc")
    kinds = sum((up.contains(k).cast("int") for k in ("IF ", "WHILE ", "LOOP ", "CASE ")), F.lit(0))
    heavy = up.contains("PREPARE") | up.contains("EXECUTE") | up.contains("CALL ")
    level = _difficulty(loc, heavy, up.contains("CURSOR"), kinds, up.contains("TEMPORARY"))
    # Upper case and lines are worked out once a text, in a projection of their own.
    once = modules.select("*", F.upper("definition").alias("_up"), lines_of_code(F.col("definition")).alias("_loc"))
    return once.select(*OBJECT, F.when(up.isNull(), "simple").otherwise(level).alias("difficulty"))


def difficulty_tsql(modules: DataFrame) -> DataFrame:
    """Weighted T-SQL difficulty with the points it costs."""
    text = F.coalesce("definition", F.lit(""))
    counted = with_word_search(modules, "definition").select(
        *OBJECT, lines_of_code(text).alias("loc"),
        _count_if_any(text, r"\bDECLARE\s+\w+\s+CURSOR\b", ["cursor"]).alias("cursors"),
        _count_if_any(text, r"\bsp_executesql\b|\bEXEC\s*\(", ["exec"]).alias("dynamic"),
        _count_if_any(text, r"#\w+", ["#"]).alias("temp_tables"),
        _count_if_any(text, r"\bEXEC\s+\w+\.\w+", ["exec"]).alias("nested"))
    weight = (F.least(F.floor(F.col("loc") / 10), F.lit(10)) + F.col("cursors") * 5 + F.col("dynamic") * 3
              + F.least(F.col("temp_tables") * 2, F.lit(6)) + F.col("nested") * 3)
    rated = counted.withColumn("weight", weight.cast("int"))
    loc, w = F.col("loc"), F.col("weight")
    level = (F.when((loc < 10) & (w <= 5), "trivial").when((loc < 30) & (F.col("cursors") == 0) & (w <= 12), "simple")
             .when(w <= 25, "moderate").when(w <= 40, "complex").otherwise("requires_redesign"))
    rated = rated.withColumn("difficulty", level)
    points = F.when(F.col("difficulty") == "trivial", 1).when(F.col("difficulty") == "simple", 2).when(F.col("difficulty") == "moderate", 3).otherwise(5)
    return rated.select(*OBJECT, "loc", "weight", "difficulty", points.alias("points"))


def function_usage(modules: DataFrame, dialect: str = "mssql", mapping: dict[str, str] | None = None) -> DataFrame:
    """Calls of known functions per source with the function that takes their place, or none."""
    if dialect == "mssql":
        known = {**(mapping or FUNCTION_MAP), **dict.fromkeys(FUNCTIONS_TO_REDESIGN, "")}
    else:
        known = {f.upper(): "" for f in UNSUPPORTED_FUNCTIONS}
    calls = modules.select("source_id", F.explode(F.regexp_extract_all("definition", F.lit(r"([A-Za-z_@][A-Za-z0-9_@]*)\s*\("), F.lit(1))).alias("fn"))
    counted = (calls.select("source_id", F.upper("fn").alias("function_name")).where(F.col("function_name").isin(list(known)))
               .groupBy("source_id", "function_name").agg(F.count(F.lit(1)).alias("call_count")))
    target = F.nullif(lookup(known, F.col("function_name")), F.lit(""))
    return counted.select("*", target.alias("target_function"),
                          F.when(target.isNull(), "redesign").when(target == F.col("function_name"), "same").otherwise("mapped").alias("handling"))
