"""Queries over module text and query logs."""

from pyspark.sql import functions as F

from crossover.functions.constants import FEATURE_TO_RULE, FUNCTION_MAP, FUNCTIONS_TO_REDESIGN, MSSQL_BLOCKERS, MSSQL_WARNINGS, MYSQL_RULES, MYSQL_QUERY_RULES, MYSQL_QUERY_RULES_STRICT, TSQL_PATTERNS
from crossover.functions.text import lookup
from crossover.operators import features as feat
from crossover.operators import inventory as inv
from crossover.operators import issues as iss
from crossover.operators import profile as prof
from crossover.queries.inventory import SIZES
from crossover.queries.registry import query

LINES = r"'\S[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*'"


def n_matches(pattern, text="definition"):
    return f"len(regexp_extract_all({text}, '(?i){pattern}'))"


def case_of(mapping, column):
    return f"CASE {column} " + " ".join("WHEN '{}' THEN '{}'".format(k, str(v).replace("'", "''")) for k, v in mapping.items()) + " END"


# Offsets from the pieces between matches, as running sums of lengths.
CONTEXTS = "WITH " + "hits AS (" + " UNION ALL ".join(
    f"SELECT source_id, kind, schema_name || '.' || name AS object_name, definition, '{n}' AS pattern_name, "
    f"string_split_regex(definition, '(?i){p}') AS gaps, regexp_extract_all(definition, '(?i){p}') AS hits "
    f"FROM cat_modules WHERE regexp_matches(definition, '(?i){p}')" for n, p in TSQL_PATTERNS.items()
) + """), spots AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hits),
offsets AS (SELECT *, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::bigint AS start FROM spots)
SELECT source_id, kind AS object_type, object_name, pattern_name,
  substring(definition, greatest(start - 20, 0) + 1, start + length(hits[i]) + 20 - greatest(start - 20, 0)) AS matched_text FROM offsets"""


@query("feature_usages", "cat_modules", sql=CONTEXTS)
def feature_usages(f):
    return feat.scan_features(f["cat_modules"])


COUNTS = "counts AS (" + " UNION ALL ".join(
    f"SELECT source_id, kind AS object_type, schema_name || '.' || name AS object_name, '{n}' AS pattern_name, "
    f"{n_matches(p)} AS match_count FROM cat_modules" for n, p in TSQL_PATTERNS.items()) + ")"


@query("feature_counts", "cat_modules", sql=f"WITH {COUNTS} SELECT * FROM counts WHERE match_count > 0")
def feature_counts(f):
    return feat.feature_counts(f["cat_modules"])


@query("feature_totals", "cat_modules", sql=f"""WITH {COUNTS}
SELECT source_id, pattern_name, sum(match_count)::bigint AS match_count, count(*) AS object_count FROM counts
WHERE match_count > 0 GROUP BY 1, 2""")
def feature_totals(f):
    return feat.feature_totals(feat.feature_counts(f["cat_modules"]))


MYSQL_HITS = "issues AS (" + " UNION ALL ".join(
    f"SELECT source_id, digest_id, digest_text, count_star, '{c}' AS construct, '{s}' AS severity, '{a}' AS advice FROM query_log "
    f"WHERE trim(digest_text) <> '' AND regexp_matches(replace(digest_text, '?', '1'), '(?i){p}')" for c, p, s, a in MYSQL_QUERY_RULES) + ")"


@query("query_issues", "query_log", sql=f"WITH {MYSQL_HITS} SELECT source_id, digest_id, digest_text, construct, severity, advice FROM issues")
def query_issues(f):
    return feat.query_issues(f["query_log"])


@query("query_issues_strict", "query_log", sql="WITH i AS (" + " UNION ALL ".join(
    f"SELECT source_id, digest_id, '{c}' AS construct, '{s}' AS severity FROM query_log WHERE trim(digest_text) <> '' AND regexp_matches(replace(digest_text, '?', '1'), '(?i){p}')"
    for c, p, s, _ in MYSQL_QUERY_RULES + MYSQL_QUERY_RULES_STRICT) + ") SELECT * FROM i")
def query_issues_strict(f):
    return feat.query_issues(f["query_log"], strict=True).select("source_id", "digest_id", "construct", "severity")


TSQL_HITS = "issues AS (" + " UNION ALL ".join(
    f"SELECT source_id, digest_id, substring(trim(digest_text), 1, 240) AS query_snippet, '{n}' AS construct, "
    f"CASE WHEN transpile_ok THEN 'warning' ELSE 'blocker' END AS severity FROM tsql_log "
    f"WHERE trim(digest_text) <> '' AND regexp_matches(digest_text, '(?i){p}')" for n, p in TSQL_PATTERNS.items()) + ")"


@query("query_issues_mssql", "tsql_log", sql=f"WITH {TSQL_HITS} SELECT source_id, digest_id, query_snippet, construct, severity FROM issues")
def query_issues_mssql(f):
    return feat.query_issues_mssql(f["tsql_log"])


@query("top_queries", "query_log", sql="""
SELECT source_id, digest_id, digest_text, sum_timer_wait, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY sum_timer_wait DESC, digest_id)::int AS rank FROM query_log) WHERE rank <= 500""")
def top_queries(f):
    return feat.top_queries(f["query_log"], "sum_timer_wait", 500).select("source_id", "digest_id", "digest_text", "sum_timer_wait", "rank")


@query("top_queries_mssql", "tsql_log", sql="""
SELECT source_id, digest_id, digest_text, execution_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id
  ORDER BY execution_count DESC, digest_id)::int AS rank FROM tsql_log) WHERE rank <= 200""")
def top_queries_mssql(f):
    return feat.top_queries(f["tsql_log"], "execution_count", 200).select("source_id", "digest_id", "digest_text", "execution_count", "rank")


@query("unmodified_share", "query_log", sql="""
WITH q AS (SELECT source_id, count_star, NOT (""" + " OR ".join(
    f"regexp_matches(replace(digest_text, '?', '1'), '(?i){p}')" for _, p, _, _ in MYSQL_QUERY_RULES) + """) AS clean
  FROM query_log WHERE trim(digest_text) <> ''),
t AS (SELECT source_id, count(*) AS statements, count(*) FILTER (clean) AS clean_statements, sum(count_star)::bigint AS executions,
  coalesce(sum(count_star) FILTER (clean), 0)::bigint AS clean_executions FROM q GROUP BY 1)
SELECT *, clean_statements::double / statements AS statement_share, clean_executions::double / executions AS execution_share FROM t""")
def unmodified_share(f):
    return feat.unmodified_share(f["query_log"])


def complexity_columns():
    return f"len(regexp_extract_all(definition, {LINES}))::int AS loc, " + ", ".join(
        " + ".join(n_matches(p) for p in ps).join(["(", ")::int AS " + name]) for name, ps in feat.COMPLEXITY.items())


@query("module_complexity", "cat_modules", sql=f"SELECT source_id, kind, schema_name, name, {complexity_columns()} FROM cat_modules")
def module_complexity(f):
    return feat.module_complexity(f["cat_modules"])


LEVEL = """CASE WHEN heavy AND loc > 100 THEN 'requires_redesign' WHEN heavy THEN 'complex'
  WHEN loc < 10 AND NOT cur AND flow <= 1 THEN 'trivial' WHEN loc < 30 AND NOT cur THEN 'simple'
  WHEN cur OR temp OR loc >= 100 THEN 'moderate' ELSE 'simple' END"""


@query("difficulty_counts", "cat_modules", sql=f"""
WITH c AS (SELECT source_id, kind, schema_name, name, {complexity_columns()} FROM cat_modules),
x AS (SELECT *, dynamic_sql_count > 0 OR nested_calls > 0 AS heavy, cursor_count > 0 AS cur, control_flow_count AS flow, temp_table_count > 0 AS temp FROM c)
SELECT source_id, kind, schema_name, name, loc, cursor_count, dynamic_sql_count, temp_table_count, control_flow_count, nested_calls,
  transaction_statements, {LEVEL} AS difficulty FROM x""")
def difficulty_counts(f):
    return feat.difficulty_counts(feat.module_complexity(f["cat_modules"]))


KEYWORD = f"""kw AS (SELECT source_id, kind, routine_type, schema_name, name, len(regexp_extract_all(definition, {LINES})) AS loc,
  contains(upper(definition), 'PREPARE') OR contains(upper(definition), 'EXECUTE') OR contains(upper(definition), 'CALL ') AS heavy,
  contains(upper(definition), 'CURSOR') AS cur, contains(upper(definition), 'TEMPORARY') AS temp,
  contains(upper(definition), 'IF ')::int + contains(upper(definition), 'WHILE ')::int + contains(upper(definition), 'LOOP ')::int
    + contains(upper(definition), 'CASE ')::int AS flow FROM cat_modules),
rated AS (SELECT *, {LEVEL} AS difficulty FROM kw)"""


@query("difficulty_keyword", "cat_modules", sql=f"WITH {KEYWORD} SELECT source_id, kind, schema_name, name, difficulty FROM rated")
def difficulty_keyword(f):
    return feat.difficulty_keyword(f["cat_modules"])


TSQL_RATED = f"""c AS (SELECT source_id, kind, routine_type, schema_name, name, len(regexp_extract_all(definition, {LINES}))::int AS loc,
  {n_matches(r'\bDECLARE\s+\w+\s+CURSOR\b')} AS cur, {n_matches(r'\bsp_executesql\b|\bEXEC\s*\(')} AS dyn, {n_matches(r'#\w+')} AS tmp,
  {n_matches(r'\bEXEC\s+\w+\.\w+')} AS nst FROM cat_modules),
w AS (SELECT *, (least(loc // 10, 10) + cur * 5 + dyn * 3 + least(tmp * 2, 6) + nst * 3)::int AS weight FROM c),
tsql AS (SELECT *, CASE WHEN loc < 10 AND weight <= 5 THEN 'trivial' WHEN loc < 30 AND cur = 0 AND weight <= 12 THEN 'simple'
  WHEN weight <= 25 THEN 'moderate' WHEN weight <= 40 THEN 'complex' ELSE 'requires_redesign' END AS difficulty FROM w),
tsql_points AS (SELECT *, CASE difficulty WHEN 'trivial' THEN 1 WHEN 'simple' THEN 2 WHEN 'moderate' THEN 3 ELSE 5 END AS points FROM tsql)"""


@query("difficulty_tsql", "cat_modules", sql=f"WITH {TSQL_RATED} SELECT source_id, kind, schema_name, name, loc, weight, difficulty, points FROM tsql_points")
def difficulty_tsql(f):
    return feat.difficulty_tsql(f["cat_modules"])


KNOWN = {**FUNCTION_MAP, **dict.fromkeys(FUNCTIONS_TO_REDESIGN, "")}


@query("function_usage", "cat_modules", sql=r"""
WITH calls AS (SELECT source_id, upper(unnest(regexp_extract_all(definition, '([A-Za-z_@][A-Za-z0-9_@]*)\s*\(', 1))) AS function_name FROM cat_modules),
n AS (SELECT source_id, function_name, count(*) AS call_count FROM calls WHERE function_name IN (""" + ", ".join(f"'{k}'" for k in KNOWN) + f""") GROUP BY 1, 2),
m AS (SELECT *, nullif({case_of(KNOWN, 'function_name')}, '') AS target_function FROM n)
SELECT *, CASE WHEN target_function IS NULL THEN 'redesign' WHEN target_function = function_name THEN 'same' ELSE 'mapped' END AS handling FROM m""")
def function_usage(f):
    return feat.function_usage(f["cat_modules"])


# ---- issues -------------------------------------------------------------------------------------------------------

MYSQL_ISSUES = """
cs AS (SELECT source_id, character_set_name, collation_name, count(*) AS n FROM my_columns WHERE character_set_name IS NOT NULL GROUP BY ALL),
ix AS (SELECT DISTINCT source_id, schema_name, table_name, index_name, index_type FROM cat_index_columns),
fk AS (SELECT DISTINCT source_id, schema_name, table_name, fk_name, ref_table FROM cat_fk_columns WHERE ref_table IS NOT NULL),
sp AS (SELECT source_id, count(*) AS n, count(DISTINCT (schema_name, table_name)) AS t FROM my_columns WHERE data_type IN ('point', 'geomcollection') GROUP BY 1),
issues AS (
SELECT source_id, 'stored_procedure' AS type, schema_name || '.' || name AS object_name, 'warning' AS severity,
  'The target does not run stored procedures.' AS message FROM cat_modules WHERE routine_type = 'PROCEDURE'
UNION ALL SELECT source_id, 'user_defined_function', schema_name || '.' || name, 'warning', 'The target has no user-defined functions.'
  FROM cat_modules WHERE routine_type = 'FUNCTION'
UNION ALL SELECT source_id, 'trigger', schema_name || '.' || name, 'warning', 'The target does not fire triggers; ' || action_timing || ' '
  || event_manipulation || ' on ' || event_table || ' moves to the application.' FROM cat_modules WHERE kind = 'trigger'
UNION ALL SELECT source_id, 'event', job_name, 'warning', 'The target has no scheduled events.' FROM cat_jobs
UNION ALL SELECT source_id, 'spatial_gis', t || ' table(s)', 'blocker', n || ' spatial column(s) in ' || t || ' table(s); the target has no spatial types.' FROM sp
UNION ALL SELECT source_id, 'fulltext_index', count(*) || ' index(es)', 'warning', count(*) || ' full-text index(es); support on the target is limited.'
  FROM ix WHERE index_type = 'FULLTEXT' GROUP BY 1
UNION ALL SELECT source_id, 'foreign_key', count(*) || ' foreign key(s)', 'info', count(*) || ' foreign key(s); enforcement depends on the target version.'
  FROM fk GROUP BY 1
UNION ALL SELECT source_id, 'unsupported_collation', collation_name, 'warning', 'Collation ' || collation_name || ' on ' || n || ' column(s) is missing on the target.'
  FROM cs WHERE lower(collation_name) = 'utf8mb4_0900_ai_ci'
UNION ALL SELECT source_id, 'charset', character_set_name || '/' || collation_name, 'info', 'Character set ' || character_set_name || ' on ' || n
  || ' column(s); utf8mb4 is the better choice.' FROM cs WHERE lower(character_set_name) <> 'utf8mb4')"""
MYSQL_FRAMES = ("cat_modules", "cat_jobs", "my_columns", "cat_index_columns", "cat_fk_columns")


def mysql_issues(f, **kw):
    return iss.assess_mysql(f["cat_modules"], f["cat_jobs"], f["my_columns"], inv.indexes(f["cat_index_columns"]),
                            inv.foreign_keys(f["cat_fk_columns"]), inv.charset_usage(f["my_columns"]), f["cat_tables"], **kw)


@query("issues_mysql", *MYSQL_FRAMES, sql=f"WITH {MYSQL_ISSUES} SELECT * FROM issues")
def issues_mysql(f):
    return mysql_issues(f)


@query("issues_mysql_strict", *MYSQL_FRAMES, "cat_tables", sql=rf"""WITH {MYSQL_ISSUES}
SELECT source_id, type, object_name, CASE WHEN type IN ('stored_procedure', 'user_defined_function', 'trigger', 'event') THEN 'blocker' ELSE severity END AS severity,
  message FROM issues
UNION ALL SELECT source_id, 'savepoint', schema_name || '.' || name, 'warning', 'Savepoints need pessimistic transactions.' FROM cat_modules
  WHERE regexp_matches(definition, '(?i)\bSAVEPOINT\b')
UNION ALL SELECT source_id, 'temporary_table', schema_name || '.' || name, 'warning', 'Temporary tables leave the routine.' FROM cat_modules
  WHERE kind = 'routine' AND regexp_matches(definition, '(?i)\bTEMPORARY\b')
UNION ALL SELECT source_id, 'auto_increment', count(*) || ' table(s)', 'warning', 'Generated values are not sequential.' FROM cat_tables
  WHERE auto_increment > 0 GROUP BY 1""")
def issues_mysql_strict(f):
    return mysql_issues(f, strict=True)


@query("issue_objects", "my_columns", "cat_index_columns", sql="""
SELECT DISTINCT source_id, 'spatial_gis' AS type, schema_name || '.' || table_name AS object_name FROM my_columns WHERE data_type IN ('point', 'geomcollection')
UNION ALL SELECT DISTINCT source_id, 'fulltext_index', schema_name || '.' || table_name || '.' || index_name FROM cat_index_columns WHERE index_type = 'FULLTEXT'""")
def issue_objects(f):
    return iss.issue_objects(f["my_columns"], inv.indexes(f["cat_index_columns"]))


FEATURE_HITS = " UNION ALL ".join(
    f"SELECT source_id, '{rule}' AS type, schema_name || '.' || name AS object_name, '{'blocker' if rule in MSSQL_BLOCKERS else 'warning'}' AS severity, "
    f"unnest(regexp_extract_all(definition, '(?i){TSQL_PATTERNS[name]}')) AS hit FROM cat_modules" for name, rule in FEATURE_TO_RULE.items())
MSSQL_ISSUES = f"""{SIZES},
totals AS (SELECT source_id, sum(data_mb::decimal(24,4))::double AS mb FROM sizes GROUP BY 1),
ix AS (SELECT DISTINCT source_id, schema_name, table_name, index_name, index_type, filter_definition FROM cat_index_columns),
so AS (SELECT source_id, bool_or(kind = 'assembly') AS a, bool_or(kind = 'linked_server' AND server_id > 0) AS l FROM cat_server_objects GROUP BY 1),
feats AS ({FEATURE_HITS}),
issues AS (
SELECT source_id, 'stored_procedure' AS type, schema_name || '.' || name AS object_name, 'blocker' AS severity FROM cat_modules WHERE routine_type = 'PROCEDURE'
UNION ALL SELECT source_id, 'clr', schema_name || '.' || name, 'blocker' FROM cat_modules WHERE kind = 'routine' AND is_clr
UNION ALL SELECT source_id, 'trigger', schema_name || '.' || name, 'blocker' FROM cat_modules WHERE kind = 'trigger'
UNION ALL SELECT source_id, 'instead_of_trigger', schema_name || '.' || name, 'warning' FROM cat_modules WHERE kind = 'trigger' AND is_instead_of
UNION ALL SELECT source_id, 'clr', 'assemblies', 'blocker' FROM so WHERE a
UNION ALL SELECT source_id, 'linked_server', 'sys.servers', 'blocker' FROM so WHERE l
UNION ALL SELECT DISTINCT source_id, 'agent_job', 'msdb jobs', 'warning' FROM cat_jobs
UNION ALL SELECT source_id, 'memory_optimized', schema_name || '.' || table_name, 'warning' FROM cat_tables WHERE is_memory_optimized
UNION ALL SELECT source_id, 'temporal', schema_name || '.' || table_name, 'warning' FROM cat_tables WHERE is_temporal
UNION ALL SELECT source_id, 'identity', schema_name || '.' || table_name || '.' || column_name, 'warning' FROM cat_columns WHERE is_identity
UNION ALL SELECT source_id, 'computed_column', schema_name || '.' || table_name || '.' || column_name, 'warning' FROM cat_columns WHERE is_computed
UNION ALL SELECT source_id, CASE data_type WHEN 'geography' THEN 'spatial' WHEN 'xml' THEN 'xml_type' ELSE data_type END,
  schema_name || '.' || table_name || '.' || column_name, 'blocker' FROM cat_columns WHERE data_type IN ('geography', 'hierarchyid', 'xml', 'sql_variant')
UNION ALL SELECT source_id, 'filtered_index', schema_name || '.' || table_name || '.' || index_name, 'warning' FROM ix WHERE filter_definition IS NOT NULL
UNION ALL SELECT source_id, 'columnstore', schema_name || '.' || table_name || '.' || index_name, 'warning' FROM ix WHERE index_type LIKE '%COLUMNSTORE%'
UNION ALL SELECT source_id, type, object_name, severity FROM feats
UNION ALL SELECT source_id, 'collation', db_collation, 'warning' FROM server_meta WHERE db_collation <> 'SQL_Latin1_General_CP1_CI_AS'
UNION ALL SELECT source_id, 'starter_storage_limit', printf('%.1f GiB', mb / 1024), 'blocker' FROM totals WHERE mb > 25600 AND source_id IN (SELECT source_id FROM server_meta)
UNION ALL SELECT source_id, unnest(['starter_connection_limit', 'starter_import_size', 'starter_ru_budget', 'starter_txn_timeout']), 'Starter tier', 'warning' FROM server_meta
UNION ALL SELECT source_id, 'starter_no_changefeed', 'CDC enabled on source', 'warning' FROM server_meta WHERE cdc_enabled)"""
MSSQL_FRAMES = ("cat_modules", "cat_server_objects", "cat_jobs", "cat_tables", "cat_columns", "cat_index_columns", "server_meta")


def mssql_issues(f, tier="starter", **kw):
    return iss.assess_mssql(f["cat_modules"], inv.server_objects(f["cat_server_objects"]), f["cat_jobs"], f["cat_tables"], f["cat_columns"],
                            inv.indexes(f["cat_index_columns"]), f["server_meta"], prof.profile_totals(prof.table_sizes(f["cat_tables"])),
                            tier=tier, **kw)


@query("issues_mssql", *MSSQL_FRAMES, sql=f"WITH {MSSQL_ISSUES} SELECT * FROM issues")
def issues_mssql(f):
    return mssql_issues(f).drop("message")


@query("issues_mssql_strict", *MSSQL_FRAMES, sql=rf"""WITH {MSSQL_ISSUES} SELECT * FROM issues WHERE type NOT LIKE 'starter%'
UNION ALL SELECT source_id, 'heap_table', schema_name || '.' || table_name, 'warning' FROM cat_tables WHERE is_heap
UNION ALL SELECT source_id, 'deprecated_type', schema_name || '.' || table_name || '.' || column_name, 'warning' FROM cat_columns WHERE data_type = 'image'
UNION ALL SELECT source_id, 'filestream', schema_name || '.' || table_name || '.' || column_name, 'blocker' FROM cat_columns WHERE is_filestream
UNION ALL SELECT source_id, 'xp_cmdshell', schema_name || '.' || name, 'blocker' FROM cat_modules WHERE regexp_matches(definition, '(?i)\bxp_cmdshell\b')
UNION ALL SELECT source_id, 'ssis', 'packages', 'warning' FROM server_meta WHERE has_ssis
UNION ALL SELECT source_id, 'essential_large_data', printf('%.1f GiB', mb / 1024), 'warning' FROM totals WHERE mb > 512000""")
def issues_mssql_strict(f):
    return mssql_issues(f, tier="essential", strict=True).drop("message")


@query("feature_issues", "cat_modules", sql=f"SELECT source_id, type, object_name, severity FROM ({FEATURE_HITS})")
def feature_issues(f):
    return iss.feature_issues(feat.scan_features(f["cat_modules"])).drop("message")


@query("issue_summary", *MSSQL_FRAMES, sql=f"WITH {MSSQL_ISSUES} SELECT source_id, severity, type, count(*) AS issue_count FROM issues GROUP BY 1, 2, 3")
def issue_summary(f):
    return iss.issue_summary(mssql_issues(f))


@query("severity_totals", *MYSQL_FRAMES, sql=f"""WITH {MYSQL_ISSUES}
SELECT source_id, count(*) FILTER (severity = 'blocker') AS blocker_count, count(*) FILTER (severity = 'warning') AS warning_count,
  count(*) FILTER (severity = 'info') AS info_count, coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (severity = 'blocker'), '') AS blocker_types,
  coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (severity = 'warning'), '') AS warning_types FROM issues GROUP BY 1""")
def severity_totals(f):
    t = iss.severity_totals(iss.issue_summary(mysql_issues(f)))
    return t.withColumns({n: F.array_join(n, ",") for n in ("blocker_types", "warning_types")})


@query("issues_enriched", *MYSQL_FRAMES, sql=f"""WITH {MYSQL_ISSUES},
c AS (SELECT source_id, kind, schema_name || '.' || name AS object_name, {complexity_columns()} FROM cat_modules WHERE kind = 'routine'),
x AS (SELECT *, dynamic_sql_count > 0 OR nested_calls > 0 AS heavy, cursor_count > 0 AS cur, control_flow_count AS flow, temp_table_count > 0 AS temp FROM c),
r AS (SELECT source_id, object_name, loc, {LEVEL} AS difficulty FROM x)
SELECT i.source_id, i.type, i.object_name, i.severity, i.message, r.difficulty, r.loc FROM issues i
LEFT JOIN r ON r.source_id = i.source_id AND r.object_name = i.object_name AND i.type IN ('stored_procedure', 'user_defined_function')""")
def issues_enriched(f):
    return iss.enrich(mysql_issues(f), feat.difficulty_counts(feat.module_complexity(f["cat_modules"])))


@query("rule_counts", *MYSQL_FRAMES, "query_log", sql=f"""WITH {MYSQL_ISSUES}, {MYSQL_HITS.replace("issues AS", "hits AS", 1)},
x AS (SELECT source_id, type AS finding FROM issues UNION ALL SELECT source_id, construct FROM hits),
y AS (SELECT source_id, {case_of(iss.RULE_OF_FINDING, "finding")} AS rule FROM x)
SELECT source_id, rule, {case_of({r: s for r, (s, _) in MYSQL_RULES.items()}, "rule")} AS severity, {case_of({r: t for r, (_, t) in MYSQL_RULES.items()}, "rule")} AS feature,
  count(*) AS finding_count FROM y WHERE rule IS NOT NULL GROUP BY source_id, rule""")
def rule_counts(f):
    return iss.rule_counts(mysql_issues(f), feat.query_issues(f["query_log"]))


@query("rule_counts_mssql", *MSSQL_FRAMES, sql=f"""WITH {MSSQL_ISSUES}, known AS (SELECT source_id, type AS rule,
  {case_of({r: "blocker" for r in MSSQL_BLOCKERS} | {r: "warning" for r in MSSQL_WARNINGS}, "type")} AS severity, {case_of(MSSQL_BLOCKERS | MSSQL_WARNINGS, "type")} AS feature FROM issues)
SELECT source_id, rule, severity, feature, count(*) AS finding_count FROM known WHERE severity IS NOT NULL GROUP BY ALL""")
def rule_counts_mssql(f):
    return iss.rule_counts_mssql(mssql_issues(f))


@query("compatible_features", *MSSQL_FRAMES, sql=f"""WITH {MSSQL_ISSUES},
fam AS (SELECT source_id, CASE WHEN data_type IN ('bigint', 'tinyint') THEN 'integer types' WHEN data_type = 'decimal' THEN 'decimal types'
  WHEN data_type IN ('nvarchar', 'varchar') THEN 'character types' WHEN data_type = 'datetime2' THEN 'date and time types'
  WHEN data_type = 'varbinary' THEN 'binary types' WHEN data_type = 'bit' THEN 'bit' WHEN data_type = 'money' THEN 'money types' END AS feature FROM cat_columns)
SELECT DISTINCT source_id, feature FROM fam WHERE feature IS NOT NULL
UNION ALL SELECT DISTINCT source_id, 'views' FROM cat_modules m WHERE kind = 'view'
  AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.source_id = m.source_id AND i.object_name = m.schema_name || '.' || m.name)""")
def compatible_features(f):
    return iss.compatible_features(f["cat_columns"], f["cat_modules"], mssql_issues(f))
