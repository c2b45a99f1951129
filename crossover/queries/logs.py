"""Queries on run and usage logs."""

from pyspark.sql import functions as F

from crossover.functions.hashing import fingerprint
from crossover.operators import features as feat
from crossover.operators import inventory as inv
from crossover.operators import issues as iss
from crossover.functions.constants import HOST_RULES
from crossover.operators import runlogs as rl
from crossover.plans import automation as auto
from crossover.plans.report import run_summary
from crossover.queries.registry import query
from crossover.queries.scores import MYSQL_ALL, MYSQL_SCORES, automation, ratings_mysql, score_mysql, totals
from crossover.queries.text import MYSQL_ISSUES, mysql_issues

# Session classes for the driver's conversations; a real log brings its own.
SESSION_RULES = [("alpha", ["la le", "une de"]), ("beta", ["der ", "und "]), ("gamma", ["the", "and"])]
PRICES = {"input_tokens": 15.0, "output_tokens": 75.0, "cache_write_tokens": 3.75, "cache_read_tokens": 1.5}
HOSTS = [*HOST_RULES, ("target-cloud", [".target.example"])]


@query("runs", "run_events", sql="""WITH a AS (SELECT run_id, arg_min({'ts': ts, 'phase': phase}, line_no) AS a,
  arg_max({'o': outcome, 's': coalesce(overall_score, score)}, line_no) AS z, count(*) AS events FROM run_events GROUP BY 1)
SELECT run_id, a.ts AS started_at, a.phase AS phase, z.o AS outcome, z.s AS score, events FROM a""")
def runs(f):
    return rl.runs(f["run_events"])


@query("latest_run", "run_events", sql="SELECT run_id, line_no, phase, step, outcome FROM run_events WHERE run_id = (SELECT max(run_id) FROM run_events)")
def latest_run(f):
    return rl.latest_run(f["run_events"].select("run_id", "line_no", "phase", "step", "outcome"))


@query("phase_stats", "run_events", sql="""SELECT phase, step, count(*) AS events, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, sum(duration_ms)::bigint AS total_ms,
  round(count(*) FILTER (outcome = 'error') / count(*), 9) AS error_rate FROM run_events GROUP BY 1, 2""")
def phase_stats(f):
    # The median is a sketch without an equal elsewhere.
    return rl.phase_stats(f["run_events"]).drop("median_ms").withColumn("error_rate", F.round("error_rate", 9))


@query("phase_medians", "run_events", sql="SELECT phase, step, quantile_disc(duration_ms, 0.5) AS median_ms FROM run_events GROUP BY 1, 2")
def phase_medians(f):
    return rl.phase_stats(f["run_events"]).select("phase", "step", "median_ms")


@query("audit_stats", "run_events", sql="SELECT phase AS tool, outcome, count(*) AS n FROM run_events GROUP BY 1, 2")
def audit_stats(f):
    return rl.audit_stats(f["run_events"].withColumnRenamed("phase", "tool"))


@query("anonymize_host", "run_events", sql="""SELECT run_id, line_no, CASE WHEN lower(host) LIKE '%localhost%' OR host LIKE '%::1%' OR host LIKE '%127.0.0.1%' THEN 'localhost'
  WHEN lower(host) LIKE '%.cluster-%' THEN 'aws-aurora' WHEN lower(host) LIKE '%.rds.amazonaws.com%' THEN 'aws-rds' WHEN lower(host) LIKE '%.target.example%' THEN 'target-cloud'
  ELSE 'other' END AS host_class FROM run_events""")
def anonymize_host(f):
    return f["run_events"].select("run_id", "line_no", rl.anonymize_host(F.col("host"), HOSTS).alias("host_class"))


@query("fingerprint", sql="SELECT c_custkey, substring(sha256(c_name), 1, 12) AS fingerprint FROM customer")
def q_fingerprint(f):
    return f["customer"].select("c_custkey", fingerprint(F.col("c_name")).alias("fingerprint"))


@query("run_summary", *MYSQL_ALL, sql=f"""WITH {MYSQL_SCORES}, {MYSQL_ISSUES},
o AS (SELECT source_id, sum(score)::int AS overall_score FROM scores GROUP BY 1),
i AS (SELECT source_id, count(*) FILTER (severity = 'blocker') AS blocker_count, count(*) FILTER (severity = 'warning') AS warning_count,
  count(*) FILTER (severity = 'info') AS info_count FROM issues GROUP BY 1)
SELECT s.source_id, substring(sha256(s.source_id), 1, 12) AS database_fingerprint, coalesce(t.table_count, 0) AS table_count, round(t.total_data_mb, 2) AS total_data_mb,
  coalesce(blocker_count, 0) AS blocker_count, coalesce(warning_count, 0) AS warning_count, coalesce(info_count, 0) AS info_count, overall_score,
  CASE WHEN overall_score >= 90 THEN 'excellent' WHEN overall_score >= 75 THEN 'good' WHEN overall_score >= 50 THEN 'moderate' WHEN overall_score >= 25 THEN 'challenging' ELSE 'difficult' END AS rating
FROM server_meta s LEFT JOIN totals t USING (source_id) LEFT JOIN i USING (source_id) LEFT JOIN o USING (source_id)""")
def q_run_summary(f):
    t = run_summary(f["server_meta"], totals(f), iss.severity_totals(iss.issue_summary(mysql_issues(f))), score_mysql(f), ratings_mysql(f), automation(f))
    return t.select("source_id", "database_fingerprint", "table_count", "total_data_mb", "blocker_count", "warning_count", "info_count", "overall_score", "rating")


SESSION = "split_part(file_name, '/', 1)"


@query("classify_sessions", "usage_log", sql=f"""WITH r AS (SELECT file_name, line_no, lower(content) AS t, row_number() OVER (PARTITION BY file_name ORDER BY line_no) AS n
  FROM usage_log WHERE role = 'user' AND file_name NOT LIKE '%/subagents/%'),
x AS (SELECT {SESSION} AS session_id, string_agg(t, ' ' ORDER BY n) AS t FROM r WHERE n <= 10 GROUP BY 1),
s AS (SELECT DISTINCT {SESSION} AS session_id FROM usage_log)
SELECT s.session_id, CASE WHEN contains(t, 'la le') OR contains(t, 'une de') THEN 'alpha' WHEN contains(t, 'der ') OR contains(t, 'und ') THEN 'beta'
  WHEN contains(t, 'the') OR contains(t, 'and') THEN 'gamma' ELSE 'other' END AS project FROM s LEFT JOIN x USING (session_id)""")
def classify_sessions(f):
    return rl.classify_sessions(f["usage_log"], SESSION_RULES)


SUMS = "sum(input_tokens)::bigint AS input_tokens, sum(output_tokens)::bigint AS output_tokens, sum(cache_write_tokens)::bigint AS cache_write_tokens, sum(cache_read_tokens)::bigint AS cache_read_tokens"
USAGE = f"""u AS (SELECT {SESSION} AS session_id, {SUMS}, count(*) AS api_calls, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM usage_log WHERE role = 'assistant' GROUP BY 1),
b AS (SELECT {SESSION} AS session_id, count(DISTINCT file_name) AS n FROM usage_log WHERE file_name LIKE '%/subagents/%' GROUP BY 1),
usage AS (SELECT u.*, coalesce(n, 0) AS sub_sessions FROM u LEFT JOIN b USING (session_id))"""


@query("usage_by_session", "usage_log", sql=f"WITH {USAGE} SELECT * FROM usage")
def usage_by_session(f):
    return rl.usage_by_session(f["usage_log"]).withColumn("models", F.array_join("models", ","))


@query("usage_cost_rollup", "usage_log", sql=f"""WITH {USAGE},
r AS (SELECT file_name, line_no, lower(content) AS t, row_number() OVER (PARTITION BY file_name ORDER BY line_no) AS n
  FROM usage_log WHERE role = 'user' AND file_name NOT LIKE '%/subagents/%'),
x AS (SELECT {SESSION} AS session_id, string_agg(t, ' ' ORDER BY n) AS t FROM r WHERE n <= 10 GROUP BY 1),
s AS (SELECT DISTINCT {SESSION} AS session_id FROM usage_log),
p AS (SELECT s.session_id, CASE WHEN contains(t, 'la le') OR contains(t, 'une de') THEN 'alpha' WHEN contains(t, 'der ') OR contains(t, 'und ') THEN 'beta'
  WHEN contains(t, 'the') OR contains(t, 'and') THEN 'gamma' ELSE 'other' END AS project FROM s LEFT JOIN x USING (session_id)),
g AS (SELECT project, session_id, grouping(project) * 2 + grouping(session_id) AS lvl, {SUMS}, sum(api_calls)::bigint AS api_calls, sum(sub_sessions)::bigint AS sub_sessions, count(*) AS sessions
  FROM usage JOIN p USING (session_id) GROUP BY ROLLUP (project, session_id))
SELECT project, session_id, CASE lvl WHEN 0 THEN 'session' WHEN 1 THEN 'project' ELSE 'total' END AS level, input_tokens, output_tokens, cache_write_tokens, cache_read_tokens,
  api_calls, sub_sessions, sessions, round(input_tokens / 1000000 * 15.0::double + output_tokens / 1000000 * 75.0::double + cache_write_tokens / 1000000 * 3.75::double
  + cache_read_tokens / 1000000 * 1.5::double, 9) AS cost FROM g""")
def usage_cost_rollup(f):
    out = rl.usage_rollup(rl.usage_by_session(f["usage_log"]), rl.classify_sessions(f["usage_log"], SESSION_RULES), PRICES)
    return out.withColumn("cost", F.round("cost", 9))
