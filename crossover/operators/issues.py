"""Compatibility rules: every finding is a row (source_id, type, object_name, severity, message).

Findings about single objects carry the object's name. Findings that sum up many objects carry a count; the objects
themselves are rows of :func:`issue_objects`, so that no source's list has to fit into one value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossover.functions.constants import (
    ACCEPTED_COLLATION, COMPATIBLE_TYPES, FEATURE_TO_RULE, MSSQL_BLOCKERS, MSSQL_SPATIAL_TYPES, MSSQL_STRICT_WARNINGS,
    MSSQL_WARNINGS, MYSQL_RULES, MYSQL_SPATIAL_TYPES, RULE_OF_FINDING, TIER_RULES, TSQL_PATTERNS, TSQL_WORDS, UNSUPPORTED_COLLATIONS,
)
from crossover.functions.text import fixed_rows, lookup, match_count, matches, may_match, rows_of, with_word_search
from crossover.operators.features import object_name

BLOCKER, WARNING, INFO = "blocker", "warning", "info"
COLUMNS = ["source_id", "type", "object_name", "severity", "message"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _issue(rule: str, severity: str, obj: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(rule).alias("type"), obj.alias("object_name"), F.lit(severity).alias("severity"), text.alias("message"))


def _mssql(rule: str, obj: Column) -> Column:
    if rule in MSSQL_BLOCKERS:
        return _issue(rule, BLOCKER, obj, MSSQL_BLOCKERS[rule])
    return _issue(rule, WARNING, obj, {**MSSQL_WARNINGS, **MSSQL_STRICT_WARNINGS}[rule])


def rows_for(df: DataFrame, *issues: Column) -> DataFrame:
    """One row per issue that applies; the frame is read once whatever the number of rules."""
    return rows_of(df, ["source_id"], *issues)


def table_path(*more: str) -> Column:
    return F.concat_ws(".", "schema_name", "table_name", *more)


# ---- MySQL family -------------------------------------------------------------------------------------------------

def module_issues_mysql(modules: DataFrame, strict: bool = False) -> DataFrame:
    """Procedures, functions and triggers. The written rules call them blockers, which ``strict`` follows."""
    sev = BLOCKER if strict else WARNING
    routine = F.col("kind") == "routine"
    fires = F.format_string("The target does not fire triggers; %s %s on %s moves to the application.", "action_timing",
                            "event_manipulation", "event_table")
    issues = [
        F.when(routine & (F.col("routine_type") == "PROCEDURE"),
               _issue("stored_procedure", sev, object_name(), "The target does not run stored procedures.")),
        F.when(routine & (F.col("routine_type") == "FUNCTION"),
               _issue("user_defined_function", sev, object_name(), "The target has no user-defined functions.")),
        F.when(F.col("kind") == "trigger", _issue("trigger", sev, object_name(), fires)),
    ]
    if strict:
        text = F.coalesce("definition", F.lit(""))
        issues += [F.when(matches(text, r"\bSAVEPOINT\b"), _issue("savepoint", WARNING, object_name(), "Savepoints need pessimistic transactions.")),
                   F.when(routine & matches(text, r"\bTEMPORARY\b"), _issue("temporary_table", WARNING, object_name(), "Temporary tables leave the routine."))]
    return rows_for(modules, *issues)


def event_issues(jobs: DataFrame, strict: bool = False) -> DataFrame:
    return rows_for(jobs, _issue("event", BLOCKER if strict else WARNING, F.col("job_name"), "The target has no scheduled events."))


def issue_objects(columns: DataFrame, indexes: DataFrame, charsets: DataFrame | None = None) -> DataFrame:
    """The single objects behind the summed-up findings: tables with spatial columns, and full-text indexes."""
    spatial = columns.where(F.lower("data_type").isin(MYSQL_SPATIAL_TYPES)).select(
        "source_id", F.lit("spatial_gis").alias("type"), table_path().alias("object_name")).distinct()
    fulltext = indexes.where(F.upper("index_type") == "FULLTEXT").select(
        "source_id", F.lit("fulltext_index").alias("type"), table_path("index_name").alias("object_name"))
    return spatial.unionByName(fulltext)


def spatial_issues(columns: DataFrame) -> DataFrame:
    """One blocker per source with the number of spatial columns and of the tables that hold them."""
    per_table = (columns.where(F.lower("data_type").isin(MYSQL_SPATIAL_TYPES))
                 .groupBy("source_id", table_path().alias("t")).agg(F.count(F.lit(1)).alias("n")))
    per_source = per_table.groupBy("source_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tables"))
    return rows_for(per_source, _issue("spatial_gis", BLOCKER, F.format_string("%d table(s)", "tables"),
                                       F.format_string("%d spatial column(s) in %d table(s); the target has no spatial types.", "n", "tables")))


def fulltext_issues(indexes: DataFrame) -> DataFrame:
    n = indexes.where(F.upper("index_type") == "FULLTEXT").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return rows_for(n, _issue("fulltext_index", WARNING, F.format_string("%d index(es)", "n"),
                              F.format_string("%d full-text index(es); support on the target is limited.", "n")))


def foreign_key_issues(fks: DataFrame) -> DataFrame:
    n = fks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return rows_for(n, _issue("foreign_key", INFO, F.format_string("%d foreign key(s)", "n"),
                              F.format_string("%d foreign key(s); enforcement depends on the target version.", "n")))


def charset_issues(charsets: DataFrame, unsupported: list[str] | None = None) -> DataFrame:
    """Collations the target lacks, and character sets other than utf8mb4."""
    bad = F.lower("collation_name").isin(unsupported or UNSUPPORTED_COLLATIONS)
    return rows_for(
        charsets,
        F.when(bad, _issue("unsupported_collation", WARNING, F.col("collation_name"),
                           F.format_string("Collation %s on %d column(s) is missing on the target.", "collation_name", "column_count"))),
        F.when(F.lower("character_set_name") != "utf8mb4",
               _issue("charset", INFO, F.concat_ws("/", "character_set_name", "collation_name"),
                      F.format_string("Character set %s on %d column(s); utf8mb4 is the better choice.", "character_set_name", "column_count"))))


def auto_increment_issues(tables: DataFrame) -> DataFrame:
    """Only in the written rules: generated values are unique but not sequential."""
    n = tables.where("auto_increment > 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return rows_for(n, _issue("auto_increment", WARNING, F.format_string("%d table(s)", "n"), "Generated values are not sequential."))


def assess_mysql(modules: DataFrame, jobs: DataFrame, columns: DataFrame, indexes: DataFrame, fks: DataFrame,
                 charsets: DataFrame, tables: DataFrame | None = None, strict: bool = False) -> DataFrame:
    parts = [module_issues_mysql(modules, strict), event_issues(jobs, strict), spatial_issues(columns),
             fulltext_issues(indexes), foreign_key_issues(fks), charset_issues(charsets)]
    if strict and tables is not None:
        parts.append(auto_increment_issues(tables))
    return _union(parts).select(*COLUMNS)


# ---- SQL Server ---------------------------------------------------------------------------------------------------

def module_issues_mssql(modules: DataFrame, strict: bool = False) -> DataFrame:
    routine, trigger = F.col("kind") == "routine", F.col("kind") == "trigger"
    kind = F.upper(F.coalesce("routine_type", F.lit("")))
    procedure = routine & (kind.startswith("SQL_STORED") | kind.endswith("PROCEDURE"))
    issues = [
        F.when(procedure, _mssql("stored_procedure", object_name())),
        F.when(routine & F.col("is_clr"), _mssql("clr", object_name())),
        F.when(trigger, _mssql("trigger", object_name())),
        F.when(trigger & F.col("is_instead_of"), _mssql("instead_of_trigger", object_name())),
    ]
    if strict:
        issues.append(F.when(matches(F.col("definition"), r"\bxp_cmdshell\b"), _mssql("xp_cmdshell", object_name())))
    return rows_for(modules, *issues)


def server_issues(objects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Once per source: assemblies, linked servers and agent jobs."""
    facts = objects.groupBy("source_id").agg(F.bool_or(F.col("kind") == "assembly").alias("asm"),
                                             F.bool_or(F.col("kind") == "linked_server").alias("linked"))
    return _union([
        rows_for(facts, F.when(F.col("asm"), _mssql("clr", F.lit("assemblies"))), F.when(F.col("linked"), _mssql("linked_server", F.lit("sys.servers")))),
        rows_for(jobs.select("source_id").distinct(), _mssql("agent_job", F.lit("msdb jobs")))])


def table_issues(tables: DataFrame, strict: bool = False) -> DataFrame:
    issues = [F.when(F.col("is_memory_optimized"), _mssql("memory_optimized", table_path())),
              F.when(F.col("is_temporal"), _mssql("temporal", table_path()))]
    if strict:
        issues.append(F.when(F.col("is_heap"), _mssql("heap_table", table_path())))
    return rows_for(tables, *issues)


def column_issues(columns: DataFrame, strict: bool = False) -> DataFrame:
    dt, obj = F.lower("data_type"), table_path("column_name")
    issues = [F.when(F.col("is_identity"), _mssql("identity", obj)), F.when(F.col("is_computed"), _mssql("computed_column", obj)),
              F.when(dt.isin(MSSQL_SPATIAL_TYPES), _mssql("spatial", obj)), F.when(dt == "hierarchyid", _mssql("hierarchyid", obj)),
              F.when(dt == "xml", _mssql("xml_type", obj)), F.when(dt == "sql_variant", _mssql("sql_variant", obj))]
    if strict:
        issues += [F.when(dt.isin("image", "text", "ntext"), _mssql("deprecated_type", obj)),
                   F.when(F.col("is_filestream"), _mssql("filestream", obj))]
    return rows_for(columns, *issues)


def index_issues(indexes: DataFrame) -> DataFrame:
    obj = table_path("index_name")
    return rows_for(indexes, F.when(F.length("filter_definition") > 0, _mssql("filtered_index", obj)),
                    F.when(F.upper("index_type").contains("COLUMNSTORE"), _mssql("columnstore", obj)))


def feature_issues(usages: DataFrame) -> DataFrame:
    """One issue per use of a construct that has a rule."""
    rule = lookup(FEATURE_TO_RULE, F.col("pattern_name"))
    texts = {**MSSQL_BLOCKERS, **MSSQL_WARNINGS}
    used = usages.where(F.col("pattern_name").isin(list(FEATURE_TO_RULE))).withColumn("type", rule)
    return used.select("source_id", "type", "object_name",
                       F.when(F.col("type").isin(list(MSSQL_BLOCKERS)), BLOCKER).otherwise(WARNING).alias("severity"),
                       lookup({r: texts[r] for r in set(FEATURE_TO_RULE.values())}, F.col("type")).alias("message"))


def feature_issues_from_text(modules: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """The same issues straight from the texts: a count per pattern, repeated, with no contexts built."""
    text, words = F.col("definition"), TSQL_WORDS if patterns is None else {}
    patterns = TSQL_PATTERNS if patterns is None else patterns
    hits = [F.when(may_match(words.get(name)), F.struct(_mssql(rule, object_name()).alias("issue"), match_count(text, patterns[name]).alias("n")))
            for name, rule in FEATURE_TO_RULE.items() if name in patterns]
    found = rows_of(with_word_search(modules, "definition"), ["source_id"], *hits).where("n > 0")
    return found.select("source_id", "issue.*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def collation_issues(meta: DataFrame) -> DataFrame:
    c = F.col("db_collation")
    return rows_for(meta, F.when((c != "") & (c != ACCEPTED_COLLATION), _mssql("collation", c)))


def tier_issues(totals: DataFrame, meta: DataFrame, tier: str) -> DataFrame:
    """Limits of the target tier. ``totals`` and ``meta`` have one row per source."""
    facts = meta.select("source_id", "cdc_enabled").join(totals.select("source_id", "total_data_mb"), "source_id", "left").fillna(0.0, ["total_data_mb"])
    mb = F.col("total_data_mb")
    size = F.format_string("%.1f GiB", mb / 1024)

    def rule(name: str, severity: str, obj: Column) -> Column:
        return _issue(name, severity, obj, TIER_RULES[name])

    if tier == "starter":
        constant = ["starter_connection_limit", "starter_import_size", "starter_ru_budget", "starter_txn_timeout"]
        return rows_for(facts, F.when(mb > 25 * 1024, rule("starter_storage_limit", BLOCKER, size)),
                        *[rule(n, WARNING, F.lit("Starter tier")) for n in constant],
                        F.when(F.col("cdc_enabled"), rule("starter_no_changefeed", WARNING, F.lit("CDC enabled on source"))))
    if tier == "essential":
        return rows_for(facts, F.when(mb > 500 * 1024, rule("essential_large_data", WARNING, size)))
    return rows_for(facts.where(F.lit(False)), rule("essential_large_data", WARNING, size))


def assess_mssql(modules: DataFrame, objects: DataFrame, jobs: DataFrame, tables: DataFrame, columns: DataFrame,
                 indexes: DataFrame, meta: DataFrame, totals: DataFrame, patterns: dict[str, str] | None = None, tier: str = "starter",
                 strict: bool = False) -> DataFrame:
    parts = [module_issues_mssql(modules, strict), server_issues(objects, jobs), table_issues(tables, strict),
             column_issues(columns, strict), index_issues(indexes), feature_issues_from_text(modules, patterns),
             collation_issues(meta), tier_issues(totals, meta, tier)]
    if strict:
        parts.append(rows_for(meta, F.when(F.col("has_ssis"), _mssql("ssis", F.lit("packages")))))
    return _union([p.select(*COLUMNS) for p in parts])


# ---- summaries ----------------------------------------------------------------------------------------------------

def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("source_id", "severity", "type").agg(F.count(F.lit(1)).alias("issue_count"))


def severity_totals(summary: DataFrame) -> DataFrame:
    """Per source: issues and distinct types by severity. The number of types is bounded by the rules."""
    def n(sev: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("severity") == sev, F.col("issue_count"))), F.lit(0))

    def types(sev: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("severity") == sev, F.col("type"))))

    return summary.groupBy("source_id").agg(n(BLOCKER).alias("blocker_count"), n(WARNING).alias("warning_count"), n(INFO).alias("info_count"),
                                            types(BLOCKER).alias("blocker_types"), types(WARNING).alias("warning_types"))


def enrich(issues: DataFrame, complexity: DataFrame) -> DataFrame:
    """Add difficulty and size of a routine to the issues that name it."""
    about = complexity.where("kind = 'routine'").select("source_id", object_name().alias("object_name"), "difficulty", "loc")
    # Every issue joins by its own object's name, so rows without a routine spread as evenly as the rest.
    ours = F.col("type").isin("stored_procedure", "user_defined_function", "clr")
    joined = issues.join(about, ["source_id", "object_name"], "left")
    return joined.withColumns({c: F.when(ours, F.col(c)) for c in ("difficulty", "loc")})


def rule_counts(issues: DataFrame, query_hits: DataFrame | None = None) -> DataFrame:
    """Findings per source and rule of the MySQL catalogue, from issues and from constructs in the query log."""
    found = issues.groupBy("source_id", F.col("type").alias("finding")).agg(F.count(F.lit(1)).alias("n"))
    if query_hits is not None:
        found = found.unionByName(query_hits.groupBy("source_id", F.col("construct").alias("finding")).agg(F.count(F.lit(1)).alias("n")))
    counts = (found.withColumn("rule", lookup(RULE_OF_FINDING, F.col("finding"))).where("rule is not null")
              .groupBy("source_id", "rule").agg(F.sum("n").alias("finding_count")))
    rules = rule_catalogue(issues.sparkSession, "mysql").select("rule", "severity", F.col("text").alias("feature"))
    return counts.join(rules, "rule").select("source_id", "rule", "severity", "feature", "finding_count")


def rule_counts_mssql(issues: DataFrame) -> DataFrame:
    """Findings per source and rule of the SQL Server catalogue, with the rule's severity and text."""
    counts = issues.groupBy("source_id", F.col("type").alias("rule")).agg(F.count(F.lit(1)).alias("finding_count"))
    rules = rule_catalogue(issues.sparkSession, "mssql").withColumnRenamed("text", "feature")
    return counts.join(rules, "rule").select("source_id", "rule", "severity", "feature", "finding_count")


def rule_catalogue(spark, dialect: str) -> DataFrame:
    if dialect == "mysql":
        rows = [(rid, sev, feature) for rid, (sev, feature) in MYSQL_RULES.items()]
    else:
        rows = [(r, BLOCKER, t) for r, t in MSSQL_BLOCKERS.items()] + [(r, WARNING, t) for r, t in MSSQL_WARNINGS.items()]
    return fixed_rows(spark, "rule string, severity string, text string", rows)


def compatible_features(columns: DataFrame, modules: DataFrame, issues: DataFrame) -> DataFrame:
    """Features in use that need no change: column type families, and views when nothing was found in any of them."""
    family = {t: name for name, types in COMPATIBLE_TYPES.items() for t in types}
    kinds = columns.select("source_id", lookup(family, F.lower("data_type")).alias("feature")).where("feature is not null").distinct()
    views = modules.where("kind = 'view'").select("source_id", object_name().alias("object_name"))
    clean = views.join(issues.select("source_id", "object_name").distinct(), ["source_id", "object_name"], "left_anti")
    return kinds.unionByName(clean.select("source_id", F.lit("views").alias("feature")).distinct())
