"""Readiness scores from deductions.

A deduction is a row (source_id, category, rule, points, detail), so every lost point can be traced and no list has
to fit into one value. A category's score is its maximum less the points, never below zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossover.functions.constants import DIFFICULTY_POINTS, MSSQL_SPATIAL_TYPES, UNSUPPORTED_COLLATIONS
from crossover.functions.text import lookup, matches, rows_of
from crossover.operators.features import object_name

MYSQL_CATEGORIES = {
    "schema_compatibility": 30, "data_complexity": 20, "query_compatibility": 20, "procedural_code": 20, "operational_readiness": 10,
}
MSSQL_CATEGORIES = {
    "schema_compatibility": 25, "code_portability": 25, "query_compatibility": 20, "data_complexity": 20, "operational_readiness": 10,
}
MYSQL_BANDS = [(90, "excellent"), (75, "good"), (50, "moderate"), (25, "challenging")]
MSSQL_BANDS = [(85, "excellent"), (70, "good"), (50, "moderate"), (25, "challenging")]


def _lose(category: str, rule: str, points: Column | int, detail: Column | None = None) -> Column:
    """A deduction when ``points`` is above zero, else NULL. NULL facts deduct nothing."""
    p = (F.lit(points) if isinstance(points, int) else points).cast("int")
    d = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return F.when(p > 0, F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), p.alias("points"), d.alias("detail")))


def _flag(category: str, rule: str, points: int, condition: Column, detail: Column | None = None) -> Column:
    return _lose(category, rule, F.when(condition, points), detail)


def _capped(category: str, rule: str, n: Column, each: int, most: int) -> Column:
    return _lose(category, rule, F.least(F.coalesce(n, F.lit(0)) * each, F.lit(most)), n)


def _rows(df: DataFrame, *deductions: Column) -> DataFrame:
    return rows_of(df, ["source_id"], *deductions)


def _query_facts(log: DataFrame | None, issues: DataFrame | None, groups: dict[str, list[str]]) -> DataFrame | None:
    """One row per source with a log: issues per group of constructs, and ``q_other`` for all the rest."""
    if log is None or issues is None:
        return None
    named = [c for names in groups.values() for c in names]
    counts = issues.groupBy("source_id").agg(
        *[F.count_if(F.col("construct").isin(names)).alias(g) for g, names in groups.items()],
        F.count_if(~F.col("construct").isin(named)).alias("q_other"))
    logged = log.groupBy("source_id").agg(F.lit(True).alias("has_log"))
    return logged.join(counts, "source_id", "left")


def _with_queries(facts: DataFrame, queries: DataFrame | None, groups: dict[str, list[str]]) -> DataFrame:
    if queries is None:
        none = {g: F.lit(0) for g in [*groups, "q_other"]}
        return facts.withColumns({**none, "has_log": F.lit(False)})
    return facts.join(queries, "source_id", "left").fillna(False, ["has_log"])


# ---- MySQL family -------------------------------------------------------------------------------------------------

MYSQL_QUERY_GROUPS = {"q_xa": ["XA_TRANSACTION"], "q_locks": ["GET_LOCK", "RELEASE_LOCK"], "q_calc": ["SQL_CALC_FOUND_ROWS"]}


def deductions_mysql(sources: DataFrame, checklist: DataFrame, charsets: DataFrame, difficulty: DataFrame, modules: DataFrame,
                     jobs: DataFrame, log: DataFrame | None = None, issues: DataFrame | None = None, target: str = "cloud",
                     analysis: DataFrame | None = None) -> DataFrame:
    """All deductions for ``sources``, of which ``checklist`` has one row each.

    All facts of a source are put into one row first, so each input is read once. ``difficulty`` rates the procedures;
    an outside ``analysis`` (source_id, schema_name, name, difficulty) goes before it. A source without a query log is
    taken to lose two points; one with a log and no issue loses none.
    """
    bad = charsets.groupBy("source_id").agg(F.count_if(F.lower("collation_name").isin(UNSUPPORTED_COLLATIONS)).alias("bad_collations"))
    facts = checklist.join(bad, "source_id", "left").fillna(0, ["bad_collations"])
    facts = _with_queries(facts, _query_facts(log, issues, MYSQL_QUERY_GROUPS), MYSQL_QUERY_GROUPS)
    c, gb = F.col, F.col("total_data_mb") / 1024
    binlog, charset = c("binlog_format"), c("character_set_server")
    S, D, Q, O = "schema_compatibility", "data_complexity", "query_compatibility", "operational_readiness"
    per_source = _rows(
        facts,
        _capped(S, "stored_procedures", c("stored_procedure_count"), 2, 10), _capped(S, "triggers", c("trigger_count"), 2, 10),
        _capped(S, "foreign_keys", c("foreign_key_count"), 1, 5), _flag(S, "spatial_columns", 3, c("has_spatial_columns")),
        _flag(S, "fulltext_indexes", 2, c("has_fulltext_indexes") & F.lit(target == "self_hosted")),
        _lose(S, "collations", c("bad_collations"), c("bad_collations")), _lose(S, "events", c("event_count"), c("event_count")),
        _lose(D, "total_size", F.when(gb > 5000, 10).when(gb > 1000, 5).when(gb > 500, 2), F.format_string("%.1f GB", gb)),
        _flag(D, "large_table", 2, c("largest_table_mb") / 1024 > 100), _capped(D, "longblob_columns", c("longblob_column_count"), 1, 5),
        _flag(D, "many_tables", 2, c("table_count") > 1000, c("table_count")),
        _flag(Q, "xa_transactions", 2, c("q_xa") > 0), _capped(Q, "locks", c("q_locks"), 1, 2),
        _flag(Q, "calc_found_rows", 2, c("q_calc") > 0), _capped(Q, "functions", c("q_other"), 1, 10),
        _flag(Q, "no_query_log", 2, ~c("has_log")),
        _flag(O, "binlog_format", 5, (binlog != "") & (F.upper(binlog) != "ROW"), binlog),
        _flag(O, "engine_version", 2, c("engine_version").startswith("2."), c("engine_version")),
        _flag(O, "character_set", 1, (charset != "") & (F.lower(charset) != "utf8mb4"), charset),
        _flag(O, "lower_case_table_names", 2, ~c("lower_case_table_names").isin(0, 2), c("lower_case_table_names")))
    return per_source.unionByName(_procedural(sources, difficulty, modules, jobs, analysis))


def _procedural(sources: DataFrame, difficulty: DataFrame, modules: DataFrame, jobs: DataFrame, analysis: DataFrame | None) -> DataFrame:
    """One deduction per procedure, trigger and event."""
    key, cat = ["source_id", "schema_name", "name"], "procedural_code"
    kinds = modules.where("kind = 'trigger' or (kind = 'routine' and routine_type = 'PROCEDURE')").select(*key, "kind")
    rated = kinds.join(difficulty.where("kind in ('routine', 'trigger')").select(*key, "kind", "difficulty"), [*key, "kind"], "left")
    if analysis is not None:
        rated = (rated.join(analysis.select(*key, F.col("difficulty").alias("given")), key, "left")
                 .withColumn("difficulty", F.coalesce("given", "difficulty")))
    points = lookup(DIFFICULTY_POINTS, F.col("difficulty"))
    code = _rows(rated,
                 F.when(F.col("kind") == "routine", _lose(cat, "procedure", points, F.concat(object_name(), F.lit(": "), "difficulty"))),
                 F.when(F.col("kind") == "trigger", _lose(cat, "trigger", 2, object_name())))
    events = _rows(jobs, _lose(cat, "event", 1, F.col("job_name")))
    return code.unionByName(events).join(sources.select("source_id"), "source_id", "left_semi")


# ---- SQL Server ---------------------------------------------------------------------------------------------------

MSSQL_QUERY_GROUPS = {"q_merge": ["merge"], "q_xml": ["for_xml", "openxml"], "q_apply": ["cross_apply", "outer_apply"],
                      "q_pivot": ["pivot", "unpivot"], "q_nolock": ["nolock"]}


def column_facts(columns: DataFrame) -> DataFrame:
    """Column counts the SQL Server scores need, in one pass."""
    dt = F.lower("data_type")
    computed = F.col("is_computed") & matches(F.col("computed_definition"), r"\b(ISNULL|GETDATE|CONVERT|CAST)\b")
    non_utf8 = dt.isin("nvarchar", "nchar") & (F.col("collation_name") != "") & ~F.upper("collation_name").contains("UTF8")
    return columns.groupBy("source_id").agg(
        F.count_if(dt.isin("image", "ntext")).alias("deprecated"), F.count_if(dt == "hierarchyid").alias("hierarchy"),
        F.count_if(dt.isin(MSSQL_SPATIAL_TYPES)).alias("spatial"), F.count_if(dt == "sql_variant").alias("variant"),
        F.count_if("is_filestream").alias("filestream"), F.count_if(computed).alias("tsql_computed"),
        F.count_if((dt == "image") | ((dt == "varbinary") & (F.col("max_length") < 0))).alias("large_binary"),
        F.count_if(dt.isin("money", "smallmoney")).alias("money"), F.coalesce(F.bool_or(non_utf8), F.lit(False)).alias("non_utf8"))


def deductions_mssql(sources: DataFrame, checklist: DataFrame, columns: DataFrame, schemas: DataFrame, totals: DataFrame,
                     difficulty: DataFrame, modules: DataFrame, meta: DataFrame, log: DataFrame | None = None,
                     issues: DataFrame | None = None, features: DataFrame | None = None, tier: str = "starter",
                     variant: str = "code") -> DataFrame:
    """All deductions. ``variant='doc'`` follows the written method where it differs from the working one; it rates
    queries by the ``features`` found in module text instead of the query log."""
    doc = variant == "doc"
    other = (schemas.select("source_id", F.lower("schema_name").alias("s")).where("s <> 'dbo'").distinct()
             .groupBy("source_id").agg(F.count(F.lit(1)).alias("other_schemas")))
    size = totals.select("source_id", "total_data_mb", "largest_data_mb", "largest_table_mb")
    server = meta.select("source_id", "db_collation", "product_version", "auth_mode")
    facts = (checklist.drop("total_data_mb", "largest_table_mb").join(column_facts(columns), "source_id", "left")
             .join(other, "source_id", "left").join(size, "source_id", "left").join(server, "source_id", "left"))
    if doc:
        facts = facts.join(_feature_facts(modules, features), "source_id", "left")
    else:
        facts = _with_queries(facts, _query_facts(log, issues, MSSQL_QUERY_GROUPS), MSSQL_QUERY_GROUPS)
    facts = facts.fillna(0).fillna(False)
    per_source = _rows(facts, *_schema_mssql(doc), *_code_mssql(), *(_query_doc() if doc else _query_code()),
                       *_data_mssql(tier, doc), *_ops_mssql(tier, doc))
    return per_source.unionByName(_procedures_mssql(sources, difficulty, modules, doc))


def _schema_mssql(doc: bool) -> list[Column]:
    c, S = F.col, "schema_compatibility"
    common = [_flag(S, "temporal_tables", 3, c("has_temporal_tables")), _flag(S, "memory_optimized_tables", 2, c("has_memory_optimized")),
              _flag(S, "filestream_columns", 2, c("filestream") > 0, c("filestream"))]
    if doc:
        return common + [
            _flag(S, "deprecated_columns", 3, c("deprecated") > 0), _flag(S, "hierarchyid_columns", 4, c("hierarchy") > 0),
            _flag(S, "spatial_columns", 4, c("spatial") > 0), _flag(S, "sql_variant_columns", 2, c("variant") > 0),
            _capped(S, "computed_columns", c("computed_column_count"), 1, 3), _capped(S, "other_schemas", c("other_schemas"), 3, 3)]
    return common + [
        _capped(S, "deprecated_columns", c("deprecated"), 1, 3), _capped(S, "hierarchyid_columns", c("hierarchy"), 2, 4),
        _capped(S, "spatial_columns", c("spatial"), 2, 4), _capped(S, "sql_variant_columns", c("variant"), 1, 2),
        _capped(S, "computed_columns", c("tsql_computed"), 1, 3), _capped(S, "other_schemas", c("other_schemas"), 1, 3)]


def _code_mssql() -> list[Column]:
    c, C = F.col, "code_portability"
    return [_capped(C, "triggers", c("trigger_count"), 2, 8), _capped(C, "assemblies", c("assembly_count"), 3, 9),
            _capped(C, "agent_jobs", c("agent_job_count"), 1, 3), _flag(C, "ssis_packages", 5, c("has_ssis"))]


def _procedures_mssql(sources: DataFrame, difficulty: DataFrame, modules: DataFrame, doc: bool) -> DataFrame:
    key = ["source_id", "schema_name", "name"]
    procedures = modules.where("kind = 'routine' and upper(routine_type) like '%PROCEDURE%' and length(definition) > 0").select(*key)
    rated = procedures.join(difficulty.where("kind = 'routine'").select(*key, "difficulty"), key)
    points = lookup({**DIFFICULTY_POINTS, **({"complex": 4} if doc else {})}, F.col("difficulty"))
    lost = _lose("code_portability", "procedure", points, F.concat(object_name(), F.lit(": "), "difficulty"))
    return _rows(rated.join(sources.select("source_id"), "source_id", "left_semi"), lost)


def _query_code() -> list[Column]:
    c, Q = F.col, "query_compatibility"
    return [_capped(Q, "merge", c("q_merge"), 1, 4), _capped(Q, "xml", c("q_xml"), 1, 3), _capped(Q, "apply", c("q_apply"), 1, 3),
            _capped(Q, "pivot", c("q_pivot"), 1, 2), _capped(Q, "nolock", c("q_nolock"), 1, 2), _flag(Q, "no_query_log", 4, ~c("has_log"))]


def _feature_facts(modules: DataFrame, features: DataFrame) -> DataFrame:
    """Written method: constructs in module text, from totals (source_id, pattern_name, match_count)."""
    def n(alias: str, *names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pattern_name").isin(*names), F.col("match_count"))), F.lit(0)).alias(alias)

    counts = features.groupBy("source_id").agg(n("f_merge", "merge"), n("f_xml", "for_xml", "openxml"), n("f_open", "openquery", "openrowset"),
                                               n("f_cursor", "cursor"), n("f_dynamic", "sp_executesql"), n("f_apply", "cross_apply", "unpivot"))
    has_text = modules.where("definition is not null").groupBy("source_id").agg(F.lit(True).alias("has_text"))
    return has_text.join(counts, "source_id", "left")


def _query_doc() -> list[Column]:
    c, Q = F.col, "query_compatibility"
    return [_capped(Q, "merge", c("f_merge"), 4, 4), _capped(Q, "xml", c("f_xml"), 4, 4), _capped(Q, "openquery", c("f_open"), 3, 3),
            _capped(Q, "cursor", c("f_cursor"), 2, 2), _flag(Q, "dynamic_sql", 2, c("f_dynamic") > 0), _capped(Q, "apply", c("f_apply"), 1, 2),
            _flag(Q, "no_definitions", 4, ~c("has_text"))]


def _data_mssql(tier: str, doc: bool) -> list[Column]:
    c, D, gb = F.col, "data_complexity", F.col("total_data_mb") / 1024
    starter = [_lose(D, "starter_size", F.when(gb > 25, 8).when(gb > 20, 3))] if tier == "starter" else []
    if doc:
        essential = [_flag(D, "essential_size", 3, gb > 500)] if tier == "essential" else []
        return [_lose(D, "total_size", F.when(gb > 5000, 10).when(gb > 1000, 5).when(gb > 500, 2)), *starter, *essential,
                _flag(D, "large_table", 2, c("largest_table_mb") / 1024 > 100), _flag(D, "many_tables", 2, c("table_count") > 1000),
                _flag(D, "collations", 2, c("non_standard_collation_count") > 0)]
    steps = [_flag(D, "over_500_gb", 2, gb > 500), _flag(D, "over_1_tb", 5, gb > 1024), _flag(D, "over_5_tb", 10, gb > 5 * 1024)]
    return [*(starter or steps), _flag(D, "large_table", 2, c("largest_data_mb") / 1024 > 100),
            _capped(D, "large_binary_columns", c("large_binary"), 1, 3), _flag(D, "many_tables", 2, c("table_count") > 1000),
            _capped(D, "money_columns", c("money"), 1, 2), _flag(D, "non_utf8_columns", 2, c("non_utf8"))]


def _ops_mssql(tier: str, doc: bool) -> list[Column]:
    c, O, cdc = F.col, "operational_readiness", F.col("is_cdc_enabled")
    if tier == "starter":
        sync = [_flag(O, "cdc_unused", 2, cdc), _lose(O, "no_live_cutover", 2)]
    else:
        sync = [_flag(O, "cdc_disabled", 3 if doc else 5, ~cdc)]
    auth = _flag(O, "windows_auth", 2 if doc else 1, F.lower("auth_mode") == "windows")
    if doc:
        return [*sync, auth]
    major = F.split_part("product_version", F.lit("."), F.lit(1)).try_cast("int")
    return [*sync, auth, _flag(O, "old_version", 2, major < 13, c("product_version")),
            _flag(O, "collation", 1, (c("db_collation") != "") & (F.lower("db_collation") != "utf8mb4_bin"), c("db_collation")),
            _flag(O, "schemas", 2, c("other_schemas") > 0, c("other_schemas"))]


# ---- scores -------------------------------------------------------------------------------------------------------

def scores(sources: DataFrame, deductions: DataFrame, categories: dict[str, int]) -> DataFrame:
    """One row per source and category."""
    grid = sources.select("source_id").distinct().select("source_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("category"), F.lit(m).alias("max_score")) for n, m in categories.items()])))
    lost = deductions.groupBy("source_id", "category").agg(F.sum("points").alias("lost"), F.count(F.lit(1)).alias("deduction_count"))
    return grid.join(lost, ["source_id", "category"], "left").select(
        "source_id", "category", F.greatest(F.col("max_score") - F.coalesce("lost", F.lit(0)), F.lit(0)).cast("int").alias("score"), "max_score",
        F.coalesce("deduction_count", F.lit(0)).alias("deduction_count"))


def ratings(score: DataFrame, bands: list[tuple[int, str]]) -> DataFrame:
    total = score.groupBy("source_id").agg(F.sum("score").cast("int").alias("overall_score"))
    rating = reduce(lambda acc, b: acc.when(F.col("overall_score") >= b[0], b[1]), bands[1:], F.when(F.col("overall_score") >= bands[0][0], bands[0][1]))
    return total.withColumn("rating", rating.otherwise("difficult"))


