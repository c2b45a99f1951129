"""Queries on scores, automation, cost and strategy."""

import re

from pyspark.sql import functions as F

from crossover.functions.constants import AUTOMATION_WEIGHTS
from crossover.operators import features as feat
from crossover.operators import inventory as inv
from crossover.operators import issues as iss
from crossover.operators import profile as prof
from crossover.plans import automation as auto
from crossover.plans import scoring as sc
from crossover.plans import sizing as sz
from crossover.queries.inventory import SIZES
from crossover.queries.registry import query
from crossover.queries.text import COUNTS, KEYWORD, MSSQL_FRAMES, MSSQL_ISSUES, MYSQL_FRAMES, MYSQL_HITS, MYSQL_ISSUES, TSQL_HITS, TSQL_RATED, mssql_issues, mysql_issues

TOTALS = f"""{SIZES}, totals AS (SELECT source_id, count(*) AS table_count, sum(data_mb::decimal(24,4))::double AS total_data_mb, max(data_mb) AS largest_data_mb,
  max(total_mb) AS largest_table_mb, max(table_rows) AS largest_table_rows FROM sizes GROUP BY 1)"""


def totals(f):
    return prof.profile_totals(prof.table_sizes(f["cat_tables"]))


def checklist_mysql(f):
    return inv.checklist_mysql(f["server_meta"], f["cat_tables"], f["my_columns"], inv.indexes(f["cat_index_columns"]), inv.foreign_keys(f["cat_fk_columns"]),
                               f["cat_modules"], f["cat_jobs"], inv.charset_usage(f["my_columns"]), f["server_meta"])


def checklist_mssql(f):
    return inv.checklist_mssql(f["server_meta"], f["cat_tables"], f["cat_columns"], inv.indexes(f["cat_index_columns"]), inv.foreign_keys(f["cat_fk_columns"]),
                               f["cat_modules"], f["cat_jobs"], inv.server_objects(f["cat_server_objects"]), f["server_meta"])


def deductions_mysql(f):
    return sc.deductions_mysql(f["server_meta"], checklist_mysql(f), inv.charset_usage(f["my_columns"]), feat.difficulty_keyword(f["cat_modules"]), f["cat_modules"], f["cat_jobs"],
                               feat.statements(f["query_log"]), feat.query_issues(f["query_log"]), target="self_hosted")


def deductions_mssql(f, tier="starter", variant="code"):
    rated = feat.difficulty_tsql(f["cat_modules"]) if variant == "code" else feat.difficulty_counts(feat.module_complexity(f["cat_modules"]))
    return sc.deductions_mssql(f["server_meta"], checklist_mssql(f), f["cat_columns"], f["cat_tables"], totals(f), rated, f["cat_modules"],
                               f["server_meta"], f["tsql_log"], feat.query_issues_mssql(f["tsql_log"]),
                               feat.feature_totals(feat.feature_counts(f["cat_modules"])), tier, variant)


MYSQL_ALL = (*MYSQL_FRAMES, "cat_tables", "server_meta", "query_log")
MSSQL_ALL = (*MSSQL_FRAMES, "cat_fk_columns", "tsql_log")

MYSQL_LOST = f"""{TOTALS}, {MYSQL_HITS.replace('issues AS', 'hits AS', 1)}, {KEYWORD},
src AS (SELECT * FROM server_meta),
m AS (SELECT source_id, count(*) FILTER (routine_type = 'PROCEDURE') AS sp, count(*) FILTER (kind = 'trigger') AS tr FROM cat_modules GROUP BY 1),
k AS (SELECT source_id, count(DISTINCT (schema_name, table_name, fk_name, ref_table)) AS n FROM cat_fk_columns WHERE ref_table IS NOT NULL GROUP BY 1),
j AS (SELECT source_id, count(*) AS n FROM cat_jobs GROUP BY 1),
u AS (SELECT source_id, count(DISTINCT (character_set_name, collation_name)) AS n FROM my_columns
      WHERE character_set_name IS NOT NULL AND lower(collation_name) = 'utf8mb4_0900_ai_ci' GROUP BY 1),
mc AS (SELECT source_id, bool_or(data_type IN ('point', 'geomcollection')) AS sp, count(*) FILTER (data_type = 'longblob') AS lb FROM my_columns GROUP BY 1),
ft AS (SELECT DISTINCT source_id FROM cat_index_columns WHERE index_type = 'FULLTEXT'),
logged AS (SELECT DISTINCT source_id FROM query_log WHERE trim(digest_text) <> ''),
q AS (SELECT source_id, count(*) FILTER (construct = 'XA_TRANSACTION') AS xa, count(*) FILTER (construct IN ('GET_LOCK', 'RELEASE_LOCK')) AS lk,
  count(*) FILTER (construct = 'SQL_CALC_FOUND_ROWS') AS ca, count(*) FILTER (construct NOT IN ('XA_TRANSACTION', 'GET_LOCK', 'RELEASE_LOCK', 'SQL_CALC_FOUND_ROWS')) AS ot
  FROM hits GROUP BY 1),
lost_all AS (
SELECT source_id, 'schema_compatibility' AS category, 'stored_procedures' AS rule, least(sp * 2, 10) AS points FROM m
UNION ALL SELECT source_id, 'schema_compatibility', 'triggers', least(tr * 2, 10) FROM m
UNION ALL SELECT source_id, 'schema_compatibility', 'foreign_keys', least(n, 5) FROM k
UNION ALL SELECT source_id, 'schema_compatibility', 'spatial_columns', 3 FROM mc WHERE sp
UNION ALL SELECT source_id, 'schema_compatibility', 'fulltext_indexes', 2 FROM ft
UNION ALL SELECT source_id, 'schema_compatibility', 'collations', n FROM u
UNION ALL SELECT source_id, 'schema_compatibility', 'events', n FROM j
UNION ALL SELECT source_id, 'data_complexity', 'total_size', CASE WHEN total_data_mb / 1024 > 5000 THEN 10 WHEN total_data_mb / 1024 > 1000 THEN 5
  WHEN total_data_mb / 1024 > 500 THEN 2 ELSE 0 END FROM totals
UNION ALL SELECT source_id, 'data_complexity', 'large_table', 2 FROM totals WHERE largest_table_mb / 1024 > 100
UNION ALL SELECT source_id, 'data_complexity', 'longblob_columns', least(lb, 5) FROM mc
UNION ALL SELECT source_id, 'data_complexity', 'many_tables', 2 FROM totals WHERE table_count > 1000
UNION ALL SELECT source_id, 'operational_readiness', 'binlog_format', 5 FROM src WHERE upper(binlog_format) <> 'ROW'
UNION ALL SELECT source_id, 'operational_readiness', 'engine_version', 2 FROM src WHERE engine_version LIKE '2.%'
UNION ALL SELECT source_id, 'operational_readiness', 'character_set', 1 FROM src WHERE character_set_server <> 'utf8mb4'
UNION ALL SELECT source_id, 'operational_readiness', 'lower_case_table_names', 2 FROM src WHERE lower_case_table_names NOT IN (0, 2)
UNION ALL SELECT source_id, 'query_compatibility', 'xa_transactions', 2 FROM q WHERE xa > 0
UNION ALL SELECT source_id, 'query_compatibility', 'locks', least(lk, 2) FROM q
UNION ALL SELECT source_id, 'query_compatibility', 'calc_found_rows', 2 FROM q WHERE ca > 0
UNION ALL SELECT source_id, 'query_compatibility', 'functions', least(ot, 10) FROM q
UNION ALL SELECT source_id, 'query_compatibility', 'no_query_log', 2 FROM src WHERE source_id NOT IN (SELECT source_id FROM logged)
UNION ALL SELECT source_id, 'procedural_code', 'procedure', CASE difficulty WHEN 'trivial' THEN 1 WHEN 'simple' THEN 2 WHEN 'moderate' THEN 3 ELSE 5 END
  FROM rated WHERE routine_type = 'PROCEDURE'
UNION ALL SELECT source_id, 'procedural_code', 'trigger', 2 FROM cat_modules WHERE kind = 'trigger'
UNION ALL SELECT source_id, 'procedural_code', 'event', 1 FROM cat_jobs),
lost AS (SELECT source_id, category, rule, points::int AS points FROM lost_all WHERE points > 0 AND source_id IN (SELECT source_id FROM src))"""


def score_sql(categories):
    grid = ", ".join(f"('{n}', {m})" for n, m in categories.items())
    return f"""grid AS (SELECT source_id, category, max_score FROM server_meta, (VALUES {grid}) g(category, max_score)),
sums AS (SELECT source_id, category, sum(points) AS p, count(*) AS n FROM lost GROUP BY 1, 2),
scores AS (SELECT g.source_id, g.category, greatest(max_score - coalesce(p, 0), 0)::int AS score, max_score, coalesce(n, 0) AS deduction_count
  FROM grid g LEFT JOIN sums s ON s.source_id = g.source_id AND s.category = g.category)"""


def rating_sql(bands):
    return "WITHOUT" if not bands else "CASE " + " ".join(f"WHEN overall_score >= {b} THEN '{r}'" for b, r in bands) + " ELSE 'difficult' END"


MYSQL_SCORES = f"{MYSQL_LOST}, {score_sql(sc.MYSQL_CATEGORIES)}"


@query("deductions_mysql", *MYSQL_ALL, sql=f"WITH {MYSQL_LOST} SELECT source_id, category, rule, points FROM lost")
def q_deductions_mysql(f):
    return deductions_mysql(f).drop("detail")


@query("score_mysql", *MYSQL_ALL, sql=f"WITH {MYSQL_SCORES} SELECT * FROM scores")
def score_mysql(f):
    return sc.scores(f["server_meta"], deductions_mysql(f), sc.MYSQL_CATEGORIES)


@query("ratings_mysql", *MYSQL_ALL, sql=f"""WITH {MYSQL_SCORES}, o AS (SELECT source_id, sum(score)::int AS overall_score FROM scores GROUP BY 1)
SELECT *, {rating_sql(sc.MYSQL_BANDS)} AS rating FROM o""")
def ratings_mysql(f):
    return sc.ratings(score_mysql(f), sc.MYSQL_BANDS)


def mssql_lost(tier, variant):
    doc = variant == "doc"
    def one(cat, rule, points, where="true"):
        points = re.sub(r"least\((\w+)", r"least(coalesce(\1, 0)", str(points))
        return f"SELECT source_id, '{cat}' AS category, '{rule}' AS rule, {points} AS points FROM facts WHERE {where}"

    S, C, Q, D, O = "schema_compatibility", "code_portability", "query_compatibility", "data_complexity", "operational_readiness"
    rows = [one(S, "temporal_tables", 3, "te"), one(S, "memory_optimized_tables", 2, "mo"), one(S, "filestream_columns", 2, "fs > 0"),
            one(C, "triggers", "least(tr * 2, 8)"), one(C, "assemblies", "least(asm * 3, 9)"), one(C, "agent_jobs", "least(jobs, 3)"), one(C, "ssis_packages", 5, "has_ssis")]
    if doc:
        rows += [one(S, "deprecated_columns", 3, "dep > 0"), one(S, "hierarchyid_columns", 4, "hi > 0"), one(S, "spatial_columns", 4, "sp > 0"),
                 one(S, "sql_variant_columns", 2, "va > 0"), one(S, "computed_columns", "least(co, 3)"), one(S, "other_schemas", "least(os * 3, 3)"),
                 one(D, "total_size", "CASE WHEN mb / 1024 > 5000 THEN 10 WHEN mb / 1024 > 1000 THEN 5 WHEN mb / 1024 > 500 THEN 2 ELSE 0 END"),
                 one(D, "large_table", 2, "lt / 1024 > 100"), one(D, "many_tables", 2, "nt > 1000"), one(D, "collations", 2, "cl > 0"),
                 one(O, "windows_auth", 2, "auth_mode = 'Windows'"), one(Q, "merge", "least(fm * 4, 4)"), one(Q, "xml", "least(fx * 4, 4)"),
                 one(Q, "openquery", "least(fo * 3, 3)"), one(Q, "cursor", "least(fc * 2, 2)"), one(Q, "dynamic_sql", 2, "fd > 0"), one(Q, "apply", "least(fa, 2)"),
                 one(Q, "no_definitions", 4, "source_id NOT IN (SELECT source_id FROM cat_modules)")]
        if tier == "starter":
            rows.append(one(D, "starter_size", "CASE WHEN mb / 1024 > 25 THEN 8 WHEN mb / 1024 > 20 THEN 3 ELSE 0 END"))
        elif tier == "essential":
            rows.append(one(D, "essential_size", 3, "mb / 1024 > 500"))
    else:
        rows += [one(S, "deprecated_columns", "least(dep, 3)"), one(S, "hierarchyid_columns", "least(hi * 2, 4)"), one(S, "spatial_columns", "least(sp * 2, 4)"),
                 one(S, "sql_variant_columns", "least(va, 2)"), one(S, "computed_columns", "least(tc, 3)"), one(S, "other_schemas", "least(os, 3)"),
                 one(D, "large_table", 2, "ld / 1024 > 100"), one(D, "large_binary_columns", "least(lb, 3)"), one(D, "many_tables", 2, "nt > 1000"),
                 one(D, "money_columns", "least(mn, 2)"), one(D, "non_utf8_columns", 2, "nu"), one(O, "windows_auth", 1, "auth_mode = 'Windows'"),
                 one(O, "old_version", 2, "try_cast(split_part(product_version, '.', 1) AS int) < 13"),
                 one(O, "collation", 1, "db_collation <> 'utf8mb4_bin'"), one(O, "schemas", 2, "os > 0"),
                 one(Q, "merge", "least(qm, 4)"), one(Q, "xml", "least(qx, 3)"), one(Q, "apply", "least(qa, 3)"), one(Q, "pivot", "least(qp, 2)"), one(Q, "nolock", "least(qn, 2)"),
                 one(Q, "no_query_log", 4, "source_id NOT IN (SELECT source_id FROM tsql_log)")]
        if tier == "starter":
            rows.append(one(D, "starter_size", "CASE WHEN mb / 1024 > 25 THEN 8 WHEN mb / 1024 > 20 THEN 3 ELSE 0 END"))
        else:
            rows += [one(D, "over_500_gb", 2, "mb / 1024 > 500"), one(D, "over_1_tb", 5, "mb / 1024 > 1024"), one(D, "over_5_tb", 10, "mb / 1024 > 5120")]
    if tier == "starter":
        rows += [one(O, "cdc_unused", 2, "cdc_enabled"), one(O, "no_live_cutover", 2)]
    else:
        rows.append(one(O, "cdc_disabled", 3 if doc else 5, "NOT cdc_enabled"))
    rows.append(f"SELECT source_id, '{C}', 'procedure', points FROM procs")
    if doc:
        from crossover.queries.text import LEVEL, complexity_columns
        procs = f"""pc AS (SELECT source_id, routine_type, {complexity_columns()} FROM cat_modules),
px AS (SELECT *, dynamic_sql_count > 0 OR nested_calls > 0 AS heavy, cursor_count > 0 AS cur, control_flow_count AS flow, temp_table_count > 0 AS temp FROM pc),
pd AS (SELECT *, {LEVEL} AS difficulty FROM px),
procs AS (SELECT source_id, CASE difficulty WHEN 'trivial' THEN 1 WHEN 'simple' THEN 2 WHEN 'moderate' THEN 3 WHEN 'complex' THEN 4 ELSE 5 END AS points
  FROM pd WHERE routine_type = 'PROCEDURE')"""
    else:
        procs = f"{TSQL_RATED}, procs AS (SELECT source_id, points FROM tsql_points WHERE routine_type = 'PROCEDURE')"
    return f"""{TOTALS}, {COUNTS}, {TSQL_HITS}, {procs},
t2 AS (SELECT source_id, count(*) AS nt, bool_or(is_memory_optimized) AS mo, bool_or(is_temporal) AS te,
  count(DISTINCT schema_name) FILTER (schema_name <> 'dbo') AS os FROM cat_tables GROUP BY 1),
c2 AS (SELECT source_id, count(*) FILTER (data_type = 'image') AS dep, count(*) FILTER (data_type = 'hierarchyid') AS hi, count(*) FILTER (data_type = 'geography') AS sp,
  count(*) FILTER (data_type = 'sql_variant') AS va, count(*) FILTER (is_filestream) AS fs, count(*) FILTER (is_computed) AS co,
  count(*) FILTER (is_computed AND computed_definition LIKE '(isnull%') AS tc, count(*) FILTER (data_type = 'image' OR (data_type = 'varbinary' AND max_length < 0)) AS lb,
  count(*) FILTER (data_type = 'money') AS mn, bool_or(data_type = 'nvarchar') AS nu, count(*) FILTER (collation_name <> 'SQL_Latin1_General_CP1_CI_AS') AS cl
  FROM cat_columns GROUP BY 1),
m2 AS (SELECT source_id, count(*) FILTER (kind = 'trigger') AS tr FROM cat_modules GROUP BY 1),
j2 AS (SELECT source_id, count(*) AS jobs FROM cat_jobs GROUP BY 1),
o2 AS (SELECT source_id, count(*) FILTER (kind = 'assembly') AS asm FROM cat_server_objects GROUP BY 1),
q2 AS (SELECT source_id, count(*) FILTER (construct = 'merge') AS qm, count(*) FILTER (construct IN ('for_xml', 'openxml')) AS qx,
  count(*) FILTER (construct IN ('cross_apply', 'outer_apply')) AS qa, count(*) FILTER (construct IN ('pivot', 'unpivot')) AS qp, count(*) FILTER (construct = 'nolock') AS qn FROM issues GROUP BY 1),
f2 AS (SELECT source_id, sum(match_count) FILTER (pattern_name = 'merge') AS fm, sum(match_count) FILTER (pattern_name IN ('for_xml', 'openxml')) AS fx,
  sum(match_count) FILTER (pattern_name IN ('openquery', 'openrowset')) AS fo, sum(match_count) FILTER (pattern_name = 'cursor') AS fc,
  sum(match_count) FILTER (pattern_name = 'sp_executesql') AS fd, sum(match_count) FILTER (pattern_name IN ('cross_apply', 'unpivot')) AS fa FROM counts GROUP BY 1),
facts AS (SELECT s.*, t2.* EXCLUDE (source_id), c2.* EXCLUDE (source_id), tr, jobs, asm, q2.* EXCLUDE (source_id), f2.* EXCLUDE (source_id),
  total_data_mb AS mb, largest_data_mb AS ld, largest_table_mb AS lt
  FROM server_meta s LEFT JOIN t2 USING (source_id) LEFT JOIN c2 USING (source_id) LEFT JOIN m2 USING (source_id) LEFT JOIN j2 USING (source_id)
  LEFT JOIN o2 USING (source_id) LEFT JOIN q2 USING (source_id) LEFT JOIN f2 USING (source_id) LEFT JOIN totals USING (source_id)),
lost_all AS ({' UNION ALL '.join(rows)}),
lost AS (SELECT source_id, category, rule, points::int AS points FROM lost_all WHERE points > 0)"""


@query("deductions_mssql", *MSSQL_ALL, sql=f"WITH {mssql_lost('starter', 'code')} SELECT source_id, category, rule, points FROM lost")
def q_deductions_mssql(f):
    return deductions_mssql(f).drop("detail")


@query("score_mssql", *MSSQL_ALL, sql=f"WITH {mssql_lost('starter', 'code')}, {score_sql(sc.MSSQL_CATEGORIES)} SELECT * FROM scores")
def score_mssql(f):
    return sc.scores(f["server_meta"], deductions_mssql(f), sc.MSSQL_CATEGORIES)


@query("score_mssql_dedicated", *MSSQL_ALL, sql=f"WITH {mssql_lost('dedicated', 'code')}, {score_sql(sc.MSSQL_CATEGORIES)} SELECT * FROM scores")
def score_mssql_dedicated(f):
    return sc.scores(f["server_meta"], deductions_mssql(f, "dedicated"), sc.MSSQL_CATEGORIES)


@query("score_mssql_doc", *MSSQL_ALL, sql=f"WITH {mssql_lost('essential', 'doc')}, {score_sql(sc.MSSQL_CATEGORIES)} SELECT * FROM scores")
def score_mssql_doc(f):
    return sc.scores(f["server_meta"], deductions_mssql(f, "essential", "doc"), sc.MSSQL_CATEGORIES)


@query("ratings_mssql", *MSSQL_ALL, sql=f"""WITH {mssql_lost('starter', 'code')}, {score_sql(sc.MSSQL_CATEGORIES)},
o AS (SELECT source_id, sum(score)::int AS overall_score FROM scores GROUP BY 1) SELECT *, {rating_sql(sc.MSSQL_BANDS)} AS rating FROM o""")
def ratings_mssql(f):
    return sc.ratings(score_mssql(f), sc.MSSQL_BANDS)


AUTO_VALUES = ", ".join(f"('{c}', {a}::double, {b}::double, {m}::double)" for c, (a, b, m) in AUTOMATION_WEIGHTS.items())


@query("automation", *MYSQL_ALL, sql=f"""WITH {KEYWORD},
w(c, a, b, m) AS (VALUES {AUTO_VALUES}),
o AS (SELECT source_id, 'table' AS c, count(*) AS n FROM cat_tables WHERE table_type = 'BASE TABLE' GROUP BY 1
UNION ALL SELECT source_id, 'foreign_key', count(DISTINCT (schema_name, table_name, fk_name, ref_table)) FROM cat_fk_columns WHERE ref_table IS NOT NULL GROUP BY 1
UNION ALL SELECT source_id, 'fulltext_index', count(DISTINCT (schema_name, table_name, index_name)) FROM cat_index_columns WHERE index_type = 'FULLTEXT' GROUP BY 1
UNION ALL SELECT source_id, 'procedure_' || difficulty, count(*) FROM rated WHERE routine_type = 'PROCEDURE' GROUP BY 1, 2
UNION ALL SELECT source_id, 'trigger', count(*) FROM cat_modules WHERE kind = 'trigger' GROUP BY 1
UNION ALL SELECT source_id, 'event', count(*) FROM cat_jobs GROUP BY 1
UNION ALL SELECT source_id, 'spatial_column', count(*) FROM my_columns WHERE data_type IN ('point', 'geomcollection') GROUP BY 1),
s AS (SELECT source_id, sum(n * a) AS a, sum(n * b) AS b, sum(n * m) AS m FROM o JOIN w ON w.c = o.c GROUP BY 1)
SELECT source_id, coalesce(round_even(a / (a + b + m) * 100, 1)::double, 100) AS automatic_pct, coalesce(round_even(b / (a + b + m) * 100, 1)::double, 0) AS assisted_pct,
  coalesce(round_even(m / (a + b + m) * 100, 1)::double, 0) AS manual_pct FROM server_meta LEFT JOIN s USING (source_id)""")
def automation(f):
    return auto.automation_mysql(f["server_meta"], inv.base_tables(f["cat_tables"]), inv.foreign_keys(f["cat_fk_columns"]), inv.indexes(f["cat_index_columns"]),
                                 f["cat_modules"], feat.difficulty_keyword(f["cat_modules"]), f["cat_jobs"], f["my_columns"])


@query("automation_mssql", *MSSQL_ALL, sql=f"""WITH {MSSQL_ISSUES}, {COUNTS},
b AS (SELECT source_id, count(*) FILTER (severity = 'blocker') AS n FROM issues GROUP BY 1), u AS (SELECT source_id, sum(match_count) AS n FROM counts GROUP BY 1),
m AS (SELECT source_id, count(*) FILTER (kind = 'trigger') AS t, count(*) FILTER (kind = 'routine') AS r FROM cat_modules GROUP BY 1),
a AS (SELECT source_id, count(*) FILTER (kind = 'assembly') AS n FROM cat_server_objects GROUP BY 1),
x AS (SELECT s.source_id, least(85, coalesce(b.n, 0) * 2 + coalesce(t, 0) * 3 + coalesce(a.n, 0) * 4)::double AS manual_pct,
  least(70, coalesce(r, 0) + coalesce(u.n, 0) // 5)::double AS assisted_pct
  FROM server_meta s LEFT JOIN b USING (source_id) LEFT JOIN u USING (source_id) LEFT JOIN m USING (source_id) LEFT JOIN a USING (source_id))
SELECT source_id, greatest(0, 100 - manual_pct - assisted_pct)::double AS automatic_pct, assisted_pct, manual_pct FROM x""")
def automation_mssql(f):
    return auto.automation_mssql(checklist_mssql(f), iss.severity_totals(iss.issue_summary(mssql_issues(f))),
                                 feat.feature_totals(feat.feature_counts(f["cat_modules"])))


@query("tier_fit", "cat_tables", "server_meta", sql=f"""WITH {TOTALS},
x AS (SELECT source_id, cdc_enabled, coalesce(total_data_mb, 0) / 1024 AS gib, coalesce(largest_table_rows, 0) AS n FROM server_meta LEFT JOIN totals USING (source_id))
SELECT source_id, 'starter' AS tier, gib <= 25 AS fits, CASE WHEN gib > 25 THEN printf('%.1f GiB exceed the 25 GiB limit', gib) ELSE '' END AS blockers,
  concat_ws('; ', CASE WHEN gib > 20 AND gib <= 25 THEN printf('%.1f GiB are close to the 25 GiB limit', gib) END,
    CASE WHEN cdc_enabled THEN 'no change feed: cutover with downtime' END, CASE WHEN n > 10000000 THEN 'tables above 10M rows import slowly' END) AS warnings FROM x
UNION ALL SELECT source_id, 'essential', true, '', CASE WHEN gib > 500 THEN printf('%.1f GiB: dedicated may import faster', gib) ELSE '' END FROM x
UNION ALL SELECT source_id, 'dedicated', true, '', '' FROM x""")
def tier_fit(f):
    t = sz.tier_fit(totals(f), f["server_meta"])
    return t.withColumns({n: F.array_join(n, "; ") for n in ("blockers", "warnings")})


HOURLY = "h AS (SELECT source_id, metric, date_trunc('hour', ts) AS hour, avg(value) AS a, max(value) AS m FROM metrics GROUP BY 1, 2, 3)"


@query("metric_hourly", "metrics", sql=f"WITH {HOURLY} SELECT source_id, metric, hour, round(a, 6) AS avg_value, m::double AS max_value FROM h")
def metric_hourly(f):
    return sz.metric_hourly(f["metrics"].withColumn("value", F.col("value").cast("double"))).withColumn("avg_value", F.round("avg_value", 6))


STATS = f"{HOURLY}, st AS (SELECT source_id, metric, round(avg(a), 6) AS average, max(m)::double AS maximum FROM h GROUP BY 1, 2)"


def stats(f):
    return sz.metric_stats(sz.metric_hourly(f["metrics"].withColumn("value", F.col("value").cast("double")))).withColumn("average", F.round("average", 6))


@query("metric_stats", "metrics", sql=f"WITH {STATS} SELECT * FROM st")
def metric_stats(f):
    return stats(f)


COST = f"""{STATS}, v AS (SELECT source_id, max(average) FILTER (metric = 'ServerlessDatabaseCapacity') AS acu, max(average) FILTER (metric = 'VolumeBytesUsed') AS sz,
  max(average) FILTER (metric = 'VolumeReadIOPs') AS rd, max(average) FILTER (metric = 'VolumeWriteIOPs') AS wr FROM st GROUP BY 1),
p AS (SELECT source_id, acu, coalesce(acu * 0.06::double * 720, 0) AS c, coalesce(sz, 0) / 1073741824 * 0.1::double AS s,
  (coalesce(rd, 0) + coalesce(wr, 0)) * 2592000 / 1000000 * 0.2::double AS i FROM v),
cost AS (SELECT source_id, round(c, 2) AS compute_cost, round(s, 2) AS storage_cost, round(i, 2) AS io_cost, round(c + s + i, 2) AS source_monthly, acu IS NULL AS compute_unknown FROM p)"""
RECOMMEND = f"""{TOTALS}, b AS (SELECT source_id, total_data_mb / 1024 AS gb FROM totals),
r AS (SELECT source_id, CASE WHEN gb <= 50 THEN 'Starter' WHEN gb <= 500 THEN 'Essential' ELSE 'Dedicated' END AS tier,
  CASE WHEN gb <= 50 THEN 1 WHEN gb <= 500 THEN 2 ELSE 3 END AS nodes, CASE WHEN gb <= 50 THEN 2 WHEN gb <= 500 THEN 4 ELSE 8 END AS vcpu,
  CASE WHEN gb <= 50 THEN 8 WHEN gb <= 500 THEN 16 ELSE 32 END AS ram_gb, greatest(floor(gb * 2)::bigint, CASE WHEN gb <= 50 THEN 50 ELSE 100 END) AS storage_gb FROM b),
rec AS (SELECT *, round(nodes * vcpu * 0.08::double * 720 + storage_gb * 0.1::double, 2) AS target_monthly FROM r)"""


@query("source_cost", "metrics", sql=f"WITH {COST} SELECT * FROM cost")
def source_cost(f):
    return sz.source_cost(stats(f))


@query("recommend", "cat_tables", sql=f"WITH {RECOMMEND} SELECT * FROM rec")
def recommend(f):
    return sz.recommend(totals(f))


@query("cost_compare", "cat_tables", "metrics", sql=f"""WITH {COST}, {RECOMMEND}
SELECT source_id, source_monthly, target_monthly, tier, CASE WHEN source_monthly > 0
  THEN round_even((source_monthly - target_monthly) / source_monthly * 100, 1)::double ELSE 0 END AS savings_pct FROM cost JOIN rec USING (source_id)""")
def cost_compare(f):
    return sz.cost_compare(sz.source_cost(stats(f)), sz.recommend(totals(f)))


@query("licence_cost", "cat_tables", "server_meta", sql=f"""WITH {TOTALS},
x AS (SELECT source_id, lower(edition) AS e, greatest(cpu_count, 4) AS n, coalesce(total_data_mb, 0) / 1024 AS gib FROM server_meta LEFT JOIN totals USING (source_id))
SELECT source_id, CASE WHEN contains(e, 'enterprise') THEN 'enterprise' WHEN contains(e, 'standard') THEN 'standard' ELSE 'unknown' END AS licence_basis,
  n AS billable_cores, round(n * CASE WHEN contains(e, 'enterprise') THEN 274.0 ELSE 99.0 END::double, 2) AS licence_monthly,
  round(CASE WHEN gib > 25 THEN (gib - 25) * 0.2::double ELSE 0 END, 2) AS target_monthly, CASE WHEN gib > 25 THEN 'essential' ELSE 'starter' END AS recommended_tier FROM x""")
def licence_cost(f):
    return sz.licence_cost(f["server_meta"], totals(f))


@query("strategy", "cat_tables", sql=f"""WITH {TOTALS}
SELECT source_id, CASE WHEN total_data_mb / 1024 < 100 THEN 'direct' WHEN total_data_mb / 1024 < 1024 THEN 'dms' ELSE 'cloud_import' END AS strategy,
  CASE WHEN total_data_mb / 1024 < 100 THEN '< 100 GB' WHEN total_data_mb / 1024 < 1024 THEN '100 GB - 1 TB' ELSE '>= 1 TB' END AS reason FROM totals""")
def strategy(f):
    return sz.strategy(totals(f))


@query("strategy_tier", "cat_tables", "server_meta", sql=f"""WITH {TOTALS},
x AS (SELECT source_id, total_data_mb, CASE cpu_count % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'essential' ELSE 'dedicated' END AS tier,
  CASE lower_case_table_names WHEN 0 THEN 'auto' WHEN 1 THEN 'physical_import' ELSE 'dms' END AS choice FROM server_meta JOIN totals USING (source_id)),
y AS (SELECT *, (tier = 'starter' AND choice IN ('dms', 'physical_import')) OR (tier = 'essential' AND choice = 'physical_import') AS bad FROM x)
SELECT source_id, total_data_mb, tier, choice, CASE WHEN bad THEN NULL WHEN choice <> 'auto' THEN choice WHEN tier = 'starter' THEN 'cli_import'
  WHEN total_data_mb < 51200 THEN 'direct' WHEN tier = 'essential' OR total_data_mb <= 512000 THEN 'dms' ELSE 'physical_import' END AS strategy,
  CASE WHEN bad THEN choice || ' is not available on ' || tier END AS reason FROM y""")
def strategy_tier(f):
    tier = F.when(F.col("cpu_count") % 3 == 0, "starter").when(F.col("cpu_count") % 3 == 1, "essential").otherwise("dedicated")
    choice = F.when(F.col("lower_case_table_names") == 0, "auto").when(F.col("lower_case_table_names") == 1, "physical_import").otherwise("dms")
    plans = f["server_meta"].select("source_id", tier.alias("tier"), choice.alias("choice")).join(totals(f).select("source_id", "total_data_mb"), "source_id")
    return sz.strategy_tier(plans.select("source_id", "total_data_mb", "tier", "choice"))


@query("decisions", *MYSQL_ALL, sql=f"""WITH {MYSQL_SCORES},
o AS (SELECT source_id, sum(score) AS n FROM scores GROUP BY 1),
d AS (SELECT s.source_id, o.n AS overall, coalesce(mc.sp, false) AS blocked, m.sp > 0 AS procs, total_data_mb > 1048576 AS large, binlog_format
  FROM server_meta s LEFT JOIN o USING (source_id) LEFT JOIN mc USING (source_id) LEFT JOIN m USING (source_id) LEFT JOIN totals USING (source_id))
SELECT source_id, 'warn' AS decision, 'difficult_migration' AS topic FROM d WHERE overall < 25
UNION ALL SELECT source_id, 'warn', 'resolve_blockers' FROM d WHERE blocked UNION ALL SELECT source_id, 'ask', 'handle_blockers' FROM d WHERE blocked
UNION ALL SELECT source_id, 'ask', 'generate_code' FROM d WHERE procs UNION ALL SELECT source_id, 'recommend', 'cloud_import' FROM d WHERE large
UNION ALL SELECT source_id, 'warn', 'binlog_format' FROM d WHERE binlog_format <> 'ROW' UNION ALL SELECT source_id, 'recommend', 'free_tier' FROM d""")
def decisions(f):
    return sz.decisions_mysql(checklist_mysql(f), ratings_mysql(f), iss.severity_totals(iss.issue_summary(mysql_issues(f))))


@query("decisions_mssql", *MSSQL_ALL, sql=f"""WITH {mssql_lost('starter', 'code')}, {score_sql(sc.MSSQL_CATEGORIES)},
o AS (SELECT source_id, sum(score) AS n FROM scores GROUP BY 1), p AS (SELECT DISTINCT source_id FROM cat_modules WHERE routine_type = 'PROCEDURE')
SELECT source_id, 'warn' AS decision, 'difficult_migration' AS topic FROM o WHERE n < 25
UNION ALL SELECT source_id, 'ask', 'handle_blockers' FROM facts
UNION ALL SELECT source_id, 'ask', 'generate_code' FROM facts WHERE source_id IN (SELECT source_id FROM p)
UNION ALL SELECT source_id, 'ask', 'trigger_language' FROM facts WHERE tr > 0
UNION ALL SELECT source_id, 'warn', 'clr_rewrite' FROM facts WHERE asm > 0 UNION ALL SELECT source_id, 'warn', 'ssis_redesign' FROM facts WHERE has_ssis
UNION ALL SELECT source_id, 'recommend', 'larger_tier' FROM facts WHERE mb > 25600
UNION ALL SELECT source_id, 'warn', unnest(['cutover_downtime', 'transaction_timeout']) FROM facts""")
def decisions_mssql(f):
    return sz.decisions_mssql(checklist_mssql(f), totals(f), ratings_mssql(f), iss.severity_totals(iss.issue_summary(mssql_issues(f))))
