"""Inventory and profile queries."""

from pyspark.sql import functions as F

from crossover.operators import inventory as inv
from crossover.operators import profile as prof
from crossover.operators import sketches as sk
from crossover.queries.registry import query
from crossover.session import run_folder


def arrays_as_text(df, *names):
    for n in names:
        df = df.withColumn(n, F.array_join(n, ","))
    return df


@query("inv_tables", "cat_tables", sql="""
SELECT source_id, schema_name, table_name, coalesce(table_rows, 0) AS table_rows, data_length, index_length,
  coalesce(auto_increment, 0) AS auto_increment FROM cat_tables WHERE table_type = 'BASE TABLE' AND schema_name NOT IN ('mysql', 'sys')""")
def inv_tables(f):
    return inv.base_tables(inv.in_scope(f["cat_tables"])).select(
        "source_id", "schema_name", "table_name", "table_rows", "data_length", "index_length", "auto_increment")


@query("inv_tables_selected", "cat_tables", sql="""
SELECT source_id, schema_name, table_name FROM cat_tables WHERE schema_name = 'hr' AND table_name NOT IN ('t1', 't6')""")
def inv_tables_selected(f):
    t = inv.in_scope(f["cat_tables"], database="hr").select("source_id", "schema_name", "table_name")
    return inv.select_tables(t, ["*"], ["t1", "t6"])


@query("inv_tables_mssql", "sys_schemas", "sys_tables", "sys_partitions", "sys_allocation_units", sql="""
WITH c AS (SELECT source_id, object_id, sum(CASE WHEN index_id IN (0, 1) THEN row_count ELSE 0 END) AS n, bool_or(index_id = 0) AS heap
           FROM sys_partitions GROUP BY 1, 2),
p AS (SELECT p.source_id, p.object_id, sum(total_pages) AS tp, sum(used_pages) AS up FROM sys_partitions p
      JOIN sys_allocation_units a ON a.source_id = p.source_id AND a.container_id = p.partition_id GROUP BY 1, 2)
SELECT t.source_id, s.name AS schema_name, t.name AS table_name, coalesce(n, 0)::bigint AS row_count,
  coalesce(tp * 8 / 1024.0::double, 0) AS total_mb, coalesce(up * 8 / 1024.0::double, 0) AS used_mb, is_memory_optimized,
  temporal_type > 0 AS is_temporal, coalesce(heap, false) AS is_heap
FROM sys_tables t JOIN sys_schemas s ON s.source_id = t.source_id AND s.schema_id = t.schema_id
LEFT JOIN c ON c.source_id = t.source_id AND c.object_id = t.object_id
LEFT JOIN p ON p.source_id = t.source_id AND p.object_id = t.object_id""")
def inv_tables_mssql(f):
    return inv.tables_mssql(f["sys_tables"], f["sys_schemas"], f["sys_partitions"], f["sys_allocation_units"], f["sys_partitions"])


@query("inv_columns_mssql", "sys_columns", "sys_tables", "sys_schemas", "sys_types", "sys_computed_columns", "sys_default_constraints", sql="""
SELECT c.source_id, s.name AS schema_name, t.name AS table_name, c.name AS column_name, c.column_id AS ordinal_position,
  ty.name AS data_type, c.max_length, c.is_nullable, cc.definition IS NOT NULL AS is_computed,
  cc.definition AS computed_definition, dc.definition AS default_definition
FROM sys_columns c JOIN sys_tables t ON t.source_id = c.source_id AND t.object_id = c.object_id
JOIN sys_schemas s ON s.source_id = t.source_id AND s.schema_id = t.schema_id
JOIN sys_types ty ON ty.user_type_id = c.user_type_id
LEFT JOIN sys_computed_columns cc ON cc.source_id = c.source_id AND cc.object_id = c.object_id AND cc.column_id = c.column_id
LEFT JOIN sys_default_constraints dc ON dc.source_id = c.source_id AND dc.object_id = c.object_id AND dc.column_id = c.column_id""")
def inv_columns_mssql(f):
    return inv.columns_mssql(f["sys_columns"], f["sys_tables"], f["sys_schemas"], f["sys_types"], f["sys_computed_columns"],
                             f["sys_default_constraints"])


@query("inv_routines", "sys_objects", "sys_schemas", "sys_sql_modules", "sys_assembly_modules", "sys_assemblies", sql="""
SELECT o.source_id, s.name AS schema_name, o.name AS routine_name, o.type_desc AS routine_type, m.definition,
  am.object_id IS NOT NULL AS is_clr, a.name AS assembly_name
FROM sys_objects o JOIN sys_schemas s ON s.source_id = o.source_id AND s.schema_id = o.schema_id
LEFT JOIN sys_sql_modules m ON m.source_id = o.source_id AND m.object_id = o.object_id
LEFT JOIN sys_assembly_modules am ON am.source_id = o.source_id AND am.object_id = o.object_id
LEFT JOIN sys_assemblies a ON a.source_id = o.source_id AND a.assembly_id = am.assembly_id
WHERE o.type IN ('P', 'FN', 'IF', 'TF')""")
def inv_routines(f):
    return inv.routines_mssql(f["sys_objects"], f["sys_schemas"], f["sys_sql_modules"], f["sys_assembly_modules"], f["sys_assemblies"])


@query("inv_triggers", "sys_objects", "sys_tables", "sys_schemas", "sys_sql_modules", "sys_assembly_modules", sql="""
SELECT o.source_id, coalesce(s.name, 'dbo') AS schema_name, o.name AS trigger_name, t.name AS table_name,
  o.is_instead_of_trigger AS is_instead_of, am.object_id IS NOT NULL AS is_clr, m.definition
FROM sys_objects o LEFT JOIN sys_tables t ON t.source_id = o.source_id AND t.object_id = o.parent_id
LEFT JOIN sys_schemas s ON s.source_id = o.source_id AND s.schema_id = coalesce(t.schema_id, o.schema_id)
LEFT JOIN sys_sql_modules m ON m.source_id = o.source_id AND m.object_id = o.object_id
LEFT JOIN sys_assembly_modules am ON am.source_id = o.source_id AND am.object_id = o.object_id
WHERE o.type = 'TR'""")
def inv_triggers(f):
    return inv.triggers_mssql(f["sys_objects"].where("type = 'TR'"), f["sys_tables"], f["sys_schemas"], f["sys_sql_modules"], f["sys_assembly_modules"])


@query("inv_views", "sys_objects", "sys_schemas", "sys_sql_modules", "sys_indexes", sql="""
SELECT o.source_id, s.name AS schema_name, o.name AS view_name, m.definition, i.object_id IS NOT NULL AS is_indexed,
  coalesce(m.definition ILIKE '%WITH SCHEMABINDING%', false) AS with_schemabinding
FROM sys_objects o JOIN sys_schemas s ON s.source_id = o.source_id AND s.schema_id = o.schema_id
LEFT JOIN sys_sql_modules m ON m.source_id = o.source_id AND m.object_id = o.object_id
LEFT JOIN (SELECT DISTINCT source_id, object_id FROM sys_indexes WHERE index_id > 0) i
  ON i.source_id = o.source_id AND i.object_id = o.object_id
WHERE o.type = 'V'""")
def inv_views(f):
    return inv.views_mssql(f["sys_objects"].where("type = 'V'"), f["sys_schemas"], f["sys_sql_modules"], f["sys_indexes"])


@query("inv_indexes", "cat_index_columns", sql="""
SELECT source_id, schema_name, table_name, index_name, index_type, is_unique, is_primary_key, filter_definition,
  coalesce(string_agg(column_name, ',' ORDER BY key_ordinal) FILTER (NOT is_included), '') AS columns,
  coalesce(string_agg(column_name, ',' ORDER BY key_ordinal) FILTER (is_included), '') AS included_columns
FROM cat_index_columns GROUP BY ALL""")
def inv_indexes(f):
    return arrays_as_text(inv.indexes(f["cat_index_columns"]), "columns", "included_columns")


@query("inv_fks", "cat_fk_columns", sql="""
SELECT source_id, schema_name, table_name, fk_name, ref_schema, ref_table, delete_action, update_action,
  string_agg(column_name || '>' || ref_column, ',' ORDER BY ordinal_position) AS column_pairs
FROM cat_fk_columns WHERE ref_table IS NOT NULL GROUP BY ALL""")
def inv_fks(f):
    return inv.foreign_keys(f["cat_fk_columns"]).withColumn(
        "column_pairs", F.array_join(F.transform("column_pairs", lambda p: F.concat(p["column_name"], F.lit(">"), p["ref_column"])), ","))


@query("inv_jobs", "cat_jobs", sql="SELECT source_id, job_name, enabled FROM cat_jobs")
def inv_jobs(f):
    return inv.jobs(f["cat_jobs"])


@query("inv_partitions", "cat_partitions", sql="SELECT * FROM cat_partitions WHERE partition_name IS NOT NULL")
def inv_partitions(f):
    return inv.partitions(f["cat_partitions"])


@query("inv_server_objects", "cat_server_objects", sql="""
SELECT source_id, kind, name FROM cat_server_objects WHERE kind = 'assembly' OR server_id > 0""")
def inv_server_objects(f):
    return inv.server_objects(f["cat_server_objects"])


@query("charset_usage", "my_columns", sql="""
SELECT source_id, character_set_name, collation_name, count(*) AS column_count FROM my_columns
WHERE character_set_name IS NOT NULL GROUP BY ALL""")
def charset_usage(f):
    return inv.charset_usage(f["my_columns"])


@query("schemas_in_use", "sys_schemas", "sys_tables", sql="""
SELECT s.source_id, s.name AS schema_name, count(t.object_id) AS table_count
FROM sys_schemas s LEFT JOIN sys_tables t ON s.source_id = t.source_id AND s.schema_id = t.schema_id
WHERE s.name NOT IN ('sys', 'guest') GROUP BY 1, 2 HAVING count(t.object_id) > 0 OR s.name = 'dbo'""")
def schemas_in_use(f):
    return inv.schemas_in_use(f["sys_schemas"], f["sys_tables"])


@query("checklist", "cat_tables", "my_columns", "cat_index_columns", "cat_fk_columns", "cat_modules", "cat_jobs", "server_meta", sql="""
WITH t AS (SELECT source_id, count(*) AS table_count, count(*) FILTER (auto_increment > 0) AS auto_increment_table_count,
    sum(round(data_length / 1048576, 2)::decimal(18, 2))::double AS total_data_mb,
    max(round((data_length + index_length) / 1048576, 2)) AS largest_table_mb
  FROM cat_tables WHERE table_type = 'BASE TABLE' GROUP BY 1),
c AS (SELECT source_id, bool_or(data_type IN ('point', 'geomcollection')) AS sp, count(*) FILTER (data_type = 'longblob') AS lb
      FROM my_columns GROUP BY 1),
i AS (SELECT source_id, bool_or(index_type = 'FULLTEXT') AS ft FROM cat_index_columns GROUP BY 1),
k AS (SELECT source_id, count(DISTINCT (schema_name, table_name, fk_name, ref_table)) AS fk FROM cat_fk_columns WHERE ref_table IS NOT NULL GROUP BY 1),
m AS (SELECT source_id, count(*) FILTER (routine_type = 'PROCEDURE') AS sp, count(*) FILTER (routine_type = 'FUNCTION') AS fn,
        count(*) FILTER (kind = 'trigger') AS tr FROM cat_modules GROUP BY 1),
e AS (SELECT source_id, count(*) AS n FROM cat_jobs GROUP BY 1),
u AS (SELECT source_id, count(DISTINCT (character_set_name, collation_name)) FILTER (collation_name ILIKE 'utf8mb4_0900%') AS n
      FROM my_columns WHERE character_set_name IS NOT NULL GROUP BY 1)
SELECT s.source_id, coalesce(table_count, 0) AS table_count, coalesce(auto_increment_table_count, 0) AS auto_increment_table_count,
  coalesce(total_data_mb, 0) AS total_data_mb, coalesce(largest_table_mb, 0) AS largest_table_mb,
  coalesce(c.sp, false) AS has_spatial_columns, coalesce(c.lb, 0) AS longblob_column_count, coalesce(i.ft, false) AS has_fulltext_indexes,
  coalesce(k.fk, 0) AS foreign_key_count, coalesce(m.sp, 0) AS stored_procedure_count, coalesce(m.fn, 0) AS function_count,
  coalesce(m.tr, 0) AS trigger_count, coalesce(e.n, 0) AS event_count, coalesce(u.n, 0) AS unsupported_collation_count,
  s.binlog_format, s.engine_version, s.character_set_server, s.lower_case_table_names
FROM server_meta s LEFT JOIN t USING (source_id) LEFT JOIN c USING (source_id) LEFT JOIN i USING (source_id)
LEFT JOIN k USING (source_id) LEFT JOIN m USING (source_id) LEFT JOIN e USING (source_id) LEFT JOIN u USING (source_id)""")
def checklist(f):
    return inv.checklist_mysql(f["server_meta"], f["cat_tables"], f["my_columns"], inv.indexes(f["cat_index_columns"]),
                               inv.foreign_keys(f["cat_fk_columns"]), f["cat_modules"], f["cat_jobs"],
                               inv.charset_usage(f["my_columns"]), f["server_meta"])


@query("checklist_mssql", "cat_tables", "cat_columns", "cat_index_columns", "cat_fk_columns", "cat_modules", "cat_jobs",
       "cat_server_objects", "server_meta", sql="""
WITH t AS (SELECT source_id, count(*) AS n, bool_or(is_memory_optimized) AS mo, bool_or(is_temporal) AS te, bool_or(is_heap) AS he FROM cat_tables GROUP BY 1),
c AS (SELECT source_id, count(*) FILTER (is_identity) AS id, count(*) FILTER (is_computed) AS co, count(*) FILTER (is_filestream) AS fs,
  bool_or(data_type = 'geography') AS sp, bool_or(data_type = 'hierarchyid') AS hi, bool_or(data_type = 'xml') AS xm,
  bool_or(data_type = 'sql_variant') AS sv, bool_or(data_type = 'image') AS im, bool_or(data_type = 'ntext') AS nt,
  count(*) FILTER (collation_name <> 'SQL_Latin1_General_CP1_CI_AS') AS cl FROM cat_columns GROUP BY 1),
i AS (SELECT source_id, bool_or(filter_definition IS NOT NULL) AS fi, bool_or(index_type LIKE '%COLUMNSTORE%') AS cs FROM cat_index_columns GROUP BY 1),
k AS (SELECT source_id, count(DISTINCT (schema_name, table_name, fk_name, ref_table)) AS n FROM cat_fk_columns WHERE ref_table IS NOT NULL GROUP BY 1),
m AS (SELECT source_id, count(*) FILTER (routine_type = 'PROCEDURE') AS sp, count(*) FILTER (routine_type = 'FUNCTION') AS fn,
  count(*) FILTER (kind = 'routine' AND is_clr) AS cl, count(*) FILTER (kind = 'trigger') AS tr,
  count(*) FILTER (kind = 'trigger' AND is_instead_of) AS io, count(*) FILTER (kind = 'view') AS vw FROM cat_modules GROUP BY 1),
iv AS (SELECT source_id, count(DISTINCT (schema_name, table_name)) AS n FROM cat_index_columns x
  WHERE EXISTS (SELECT 1 FROM cat_modules v WHERE v.kind = 'view' AND v.source_id = x.source_id AND v.schema_name = x.schema_name AND v.name = x.table_name) GROUP BY 1),
z AS (SELECT source_id, sum(round((data_length + index_length) / 1048576, 2)::decimal(18,2))::double AS total, max(round((data_length + index_length) / 1048576, 2)) AS largest FROM cat_tables GROUP BY 1),
e AS (SELECT source_id, count(*) AS n FROM cat_jobs GROUP BY 1),
o AS (SELECT source_id, count(*) FILTER (kind = 'assembly') AS a, count(*) FILTER (kind = 'linked_server' AND server_id > 0) AS l FROM cat_server_objects GROUP BY 1)
SELECT s.source_id, coalesce(t.n, 0) AS table_count, coalesce(mo, false) AS has_memory_optimized, coalesce(te, false) AS has_temporal_tables,
  coalesce(he, false) AS has_heap_tables, coalesce(c.id, 0) AS identity_column_count, coalesce(c.co, 0) AS computed_column_count,
  coalesce(c.fs, 0) AS filestream_column_count, coalesce(c.sp, false) AS has_spatial_columns, coalesce(c.hi, false) AS has_hierarchyid_columns,
  coalesce(c.xm, false) AS has_xml_columns, coalesce(c.sv, false) AS has_sql_variant_columns, coalesce(c.im, false) AS has_image_columns,
  coalesce(c.nt, false) AS has_ntext_columns, coalesce(c.cl, 0) AS non_standard_collation_count, coalesce(i.fi, false) AS has_filtered_indexes,
  coalesce(i.cs, false) AS has_columnstore_indexes, coalesce(k.n, 0) AS foreign_key_count, coalesce(m.sp, 0) AS stored_procedure_count,
  coalesce(m.fn, 0) AS function_count, coalesce(m.cl, 0) AS clr_routine_count, coalesce(m.tr, 0) AS trigger_count,
  coalesce(m.io, 0) AS instead_of_trigger_count, coalesce(m.vw, 0) AS view_count, coalesce(e.n, 0) AS agent_job_count,
  coalesce(o.a, 0) AS assembly_count, coalesce(o.l, 0) AS linked_server_count, s.product_version AS sql_version, s.edition,
  s.cdc_enabled AS is_cdc_enabled, s.has_ssis, lower(s.auth_mode) = 'windows' AS windows_auth_only, coalesce(iv.n, 0) AS indexed_view_count,
  coalesce(z.total, 0) AS total_data_mb, coalesce(z.largest, 0) AS largest_table_mb
FROM server_meta s LEFT JOIN t USING (source_id) LEFT JOIN c USING (source_id) LEFT JOIN i USING (source_id) LEFT JOIN k USING (source_id)
LEFT JOIN m USING (source_id) LEFT JOIN e USING (source_id) LEFT JOIN o USING (source_id) LEFT JOIN iv USING (source_id) LEFT JOIN z USING (source_id)""")
def checklist_mssql(f):
    return inv.checklist_mssql(f["server_meta"], f["cat_tables"], f["cat_columns"], inv.indexes(f["cat_index_columns"]),
                               inv.foreign_keys(f["cat_fk_columns"]), f["cat_modules"], f["cat_jobs"],
                               inv.server_objects(f["cat_server_objects"]), f["server_meta"],
                               f["cat_tables"].select("source_id", ((F.col("data_length") + F.col("index_length")) / 1048576).alias("total_mb")))


@query("inventory_summary", "cat_tables", "cat_columns", "cat_modules", "cat_jobs", sql="""
WITH s AS (SELECT source_id FROM cat_tables UNION SELECT source_id FROM cat_columns UNION SELECT source_id FROM cat_modules UNION SELECT source_id FROM cat_jobs),
t AS (SELECT source_id, count(*) AS n, count(DISTINCT schema_name) AS k FROM cat_tables GROUP BY 1),
c AS (SELECT source_id, count(*) AS n FROM cat_columns GROUP BY 1),
m AS (SELECT source_id, count(*) FILTER (kind = 'routine') AS r, count(*) FILTER (kind = 'trigger') AS t, count(*) FILTER (kind = 'view') AS v FROM cat_modules GROUP BY 1),
j AS (SELECT source_id, count(*) AS n FROM cat_jobs GROUP BY 1)
SELECT s.source_id, coalesce(t.n, 0) AS table_count, coalesce(c.n, 0) AS column_count, coalesce(m.r, 0) AS routine_count,
  coalesce(m.t, 0) AS trigger_count, coalesce(m.v, 0) AS view_count, coalesce(j.n, 0) AS event_count, coalesce(t.k, 0) AS schema_count
FROM s LEFT JOIN t USING (source_id) LEFT JOIN c USING (source_id) LEFT JOIN m USING (source_id) LEFT JOIN j USING (source_id)""")
def inventory_summary(f):
    m = f["cat_modules"]
    return inv.inventory_summary({"table": f["cat_tables"], "column": f["cat_columns"], "routine": inv.modules(m, "routine"),
                                  "trigger": inv.modules(m, "trigger"), "view": inv.modules(m, "view"), "event": f["cat_jobs"]})


SIZES = """sizes AS (SELECT source_id, schema_name, table_name, coalesce(table_rows, 0) AS table_rows, round(data_length / 1048576, 2) AS data_mb,
  round(index_length / 1048576, 2) AS index_mb, round((data_length + index_length) / 1048576, 2) AS total_mb
  FROM cat_tables WHERE table_type = 'BASE TABLE')"""


@query("table_sizes", "cat_tables", sql=f"WITH {SIZES} SELECT * FROM sizes")
def table_sizes(f):
    return prof.table_sizes(f["cat_tables"])


@query("table_sizes_mssql", "sys_partition_stats", "sys_tables", "sys_schemas", sql="""
SELECT t.source_id, s.name AS schema_name, t.name AS table_name, sum(row_count)::bigint AS row_count,
  sum(reserved_pages) * 8 / 1024.0::double AS reserved_mb, sum(in_row_pages + lob_pages + overflow_pages) * 8 / 1024.0::double AS data_mb,
  (sum(used_pages) - sum(in_row_pages + lob_pages + overflow_pages)) * 8 / 1024.0::double AS index_mb
FROM sys_partition_stats p JOIN sys_tables t ON t.source_id = p.source_id AND t.object_id = p.object_id
JOIN sys_schemas s ON s.source_id = t.source_id AND s.schema_id = t.schema_id GROUP BY 1, 2, 3""")
def table_sizes_mssql(f):
    return prof.table_sizes_mssql(f["sys_partition_stats"], f["sys_tables"], f["sys_schemas"])


@query("profile_totals", "cat_tables", sql=f"""WITH {SIZES}
SELECT source_id, count(*) AS table_count, sum(table_rows)::bigint AS total_rows, sum(data_mb::decimal(24,4))::double AS total_data_mb,
  sum(index_mb::decimal(24,4))::double AS total_index_mb, max(data_mb) AS largest_data_mb, max(total_mb) AS largest_table_mb,
  max(table_rows) AS largest_table_rows FROM sizes GROUP BY 1""")
def profile_totals(f):
    return prof.profile_totals(prof.table_sizes(f["cat_tables"]))


@query("largest_tables", "cat_tables", sql=f"""WITH {SIZES}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY total_mb DESC, schema_name, table_name)::int AS rank FROM sizes)
WHERE rank <= 20""")
def largest_tables(f):
    return prof.largest_tables(prof.table_sizes(f["cat_tables"]))


@query("lob_columns", "my_columns", sql="""SELECT source_id, schema_name, table_name, column_name, data_type FROM my_columns
WHERE data_type IN ('blob', 'mediumblob', 'longblob', 'text', 'mediumtext', 'longtext')""")
def lob_columns(f):
    return prof.lob_columns(f["my_columns"])


@query("transfer_hours", "cat_tables", sql=f"""WITH {SIZES}
SELECT source_id, round(sum(data_mb::decimal(24,4))::double / 12.5 / 3600, 1) AS hours FROM sizes GROUP BY 1""")
def transfer_hours(f):
    return prof.profile_totals(prof.table_sizes(f["cat_tables"])).select("source_id", prof.transfer_hours(F.col("total_data_mb")).alias("hours"))


@query("lob_max_len", sql="""
SELECT 'text' AS column_name, max(strlen(text))::int AS max_bytes FROM documents UNION ALL SELECT 'lang', max(strlen(lang))::int FROM documents
UNION ALL SELECT 'source', max(strlen(source))::int FROM documents""")
def lob_max_len(f):
    return prof.lob_max_len(f["documents"], ["text", "lang", "source"])


@query("lob_max_len_sampled", sql="SELECT unnest(['html', 'url']) AS column_name, true AS within_full, true AS same_again")
def lob_max_len_sampled(f):
    """A sample's longest value is one of the column's, and the same each time."""
    part = [prof.lob_max_len(f["pages"], ["html", "url"], fraction=0.5).withColumnRenamed("max_bytes", f"s{i}") for i in range(2)]
    full = prof.lob_max_len(f["pages"], ["html", "url"])
    return full.join(part[0], "column_name").join(part[1], "column_name").select("column_name", (F.col("s0") <= F.col("max_bytes")).alias("within_full"), (F.col("s0") == F.col("s1")).alias("same_again"))


ORDER_FIELDS = [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"), ("o_orderdate", "d"), ("o_orderpriority", "s")]


def _profile_sql(n, kind):
    num = f"min({n})::double, max({n})::double" if kind == "n" else "NULL::double, NULL::double"
    txt = f"min({n}), max({n}), max(length({n}))::int" if kind == "s" else "NULL::varchar, NULL::varchar, NULL::int"
    val = f"min({n})::varchar, max({n})::varchar" if n in ("o_orderkey", "o_custkey", "o_orderdate") else "NULL::varchar, NULL::varchar"
    over = "count(*) FILTER (o_custkey NOT BETWEEN 0 AND 255)" if n == "o_custkey" else "0::bigint"
    return f"SELECT '{n}', count(*), count(*) FILTER ({n} IS NULL), {num}, {txt}, {val}, {over}, count(DISTINCT {n}) FROM orders_tgt"


@query("column_profile", "orders_tgt", sql="WITH p(column_name, row_count, null_count, min_number, max_number, min_text, max_text, max_length, min_value, max_value, overflow_count, distinct_count) AS ("
       + " UNION ALL ".join(_profile_sql(*x) for x in ORDER_FIELDS) + ") SELECT * FROM p")
def column_profile(f):
    return prof.column_profile(f["orders_tgt"], distinct="exact", target={"o_custkey": "tinyint"})


APPROX = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"], "documents": ["doc_id", "lang", "source"], "pages": ["page_id", "url"]}


@query("column_profile_approx", sql=" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, true AS near FROM {t}" for t, cs in APPROX.items() for c in cs))
def column_profile_approx(f):
    """Sketched distinct counts lie within a sixth of the exact ones."""
    tables = {n: f[n].select(*cs) for n, cs in APPROX.items()}
    sketched, exact = prof.profile_tables(tables), prof.profile_tables(tables, distinct="exact").withColumnRenamed("distinct_count", "exact")
    near = F.abs(F.col("distinct_count") - F.col("exact")) * 6 <= F.col("exact")
    return sketched.join(exact.select("table_name", "column_name", "exact"), ["table_name", "column_name"]).select("table_name", "column_name", "row_count", near.alias("near"))


EVERY_COLUMN = {"lineitem": {"i": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "f": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "s": ["l_returnflag", "l_linestatus"],
                             "t": ["l_shipdate"]},
                "documents": {"i": ["doc_id", "n_chars"], "s": ["text", "lang", "source"]}, "pages": {"i": ["page_id"], "s": ["url", "html"]}}


def _every_column(select):
    return " UNION ALL ".join(select(t, c, kind) for t, kinds in EVERY_COLUMN.items() for kind, columns in kinds.items() for c in columns)


def _full_sql(t, c, kind):
    number = f"min({c})::double, max({c})::double" if kind in "if" else "NULL::double, NULL::double"
    text = f"min({c}), max({c})" if kind == "s" else "NULL::varchar, NULL::varchar"
    value = f"min({c})::varchar, max({c})::varchar" if kind in "it" else "NULL::varchar, NULL::varchar"
    return f"""SELECT '{t}', '{c}', count(*), count(*) FILTER ({c} IS NULL), {number}, {text}, {value}, {f'max(length({c}))::int' if kind == 's' else 'NULL::int'}, 0::bigint, count(DISTINCT {c}), true FROM {t}"""


@query("column_profile_full", sql=f"""WITH p(table_name, column_name, row_count, null_count, min_number, max_number, min_text, max_text, min_value, max_value, max_length, overflow_count, exact_count, near)
AS ({_every_column(_full_sql)}) SELECT * FROM p""")
def column_profile_full(f):
    """The whole profile of every column, with the exact distinct count and whether the sketch lies within a sixth of it."""
    tables = {n: f[n] for n in APPROX}
    exact = prof.profile_tables(tables, distinct="exact").select("table_name", "column_name", F.col("distinct_count").alias("exact_count"))
    near = F.abs(F.col("distinct_count") - F.col("exact_count")) * 6 <= F.col("exact_count")
    return prof.profile_tables(tables).join(exact, ["table_name", "column_name"]).withColumn("near", near).drop("distinct_count")


def _merged_sql(t, c, kind):
    value = f"min({c})::varchar, max({c})::varchar" if kind in "its" else "NULL::varchar, NULL::varchar"
    over = {"l_partkey": "count(*) FILTER (l_partkey > 255)", "l_returnflag": "0::bigint", "url": "count(*) FILTER (length(url) > 20)"}.get(c, "0::bigint")
    return f"SELECT '{t}', '{c}', count(*), count(*) FILTER ({c} IS NULL), {value}, {f'max(length({c}))::int' if kind == 's' else 'NULL::int'}, {over}, true FROM {t}"


@query("column_profile_merged", sql=f"""WITH p(table_name, column_name, row_count, null_count, min_value, max_value, max_length, overflow_count, near)
AS ({_every_column(_merged_sql)}) SELECT * FROM p""")
def column_profile_merged(f):
    """Profiles out of the stored sketches of four shards a table; a shard that is stored again replaces itself. The distinct count lies within
    a tenth of the exact one."""
    path, targets = run_folder(f.spark, "sketches"), {"lineitem": {"l_partkey": "tinyint unsigned", "l_returnflag": "varchar(1)"}, "documents": {}, "pages": {"url": "varchar(20)"}}
    keys = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}
    sk.store_shards([(t, str(shard), f[t].where(F.col(key) % 4 == shard)) for t, key in keys.items() for shard in (0, 1, 2, 3, 2)], path, targets)
    merged = sk.stored_profile(f.spark, path, list(targets))
    exact = prof.profile_tables({t: f[t] for t in targets}, distinct="exact").select("table_name", "column_name", F.col("distinct_count").alias("exact"))
    plain = F.col("kind") != "double"
    return merged.join(exact, ["table_name", "column_name"]).select(
        "table_name", "column_name", "row_count", "null_count", F.when(plain, F.col("min_value")).alias("min_value"), F.when(plain, F.col("max_value")).alias("max_value"), "max_length",
        "overflow_count", (F.abs(F.col("distinct_count") - F.col("exact")) * 10 <= F.col("exact")).alias("near"))
