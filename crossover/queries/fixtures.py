"""Projections of the driver tables; each runs unchanged in Spark SQL and in DuckDB."""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"

# name -> (frames it reads, SQL)
FIXTURES: dict[str, tuple[list[str], str]] = {}

FIXTURES["cat_tables"] = (["orders"], """
select 'db' || cast(o_custkey % 20 as string) as source_id,
       case o_orderkey % 5 when 0 then 'sales' when 1 then 'hr' else 'dbo' end as schema_name,
       't' || cast(o_orderkey as string) as table_name,
       case when o_orderkey % 23 = 0 then 'VIEW' else 'BASE TABLE' end as table_type,
       case when o_orderkey % 29 = 0 then null else cast(o_custkey * 1000 as bigint) end as table_rows,
       cast(floor(o_totalprice) as bigint) * 65536 as data_length,
       cast(floor(o_totalprice) as bigint) * 8192 as index_length,
       case when o_orderkey % 2 = 0 then o_orderkey else null end as auto_increment,
       o_orderkey % 31 = 0 as is_temporal,
       o_orderkey % 37 = 0 as is_memory_optimized,
       o_orderkey % 7 = 0 as is_heap,
       case when o_orderkey % 3 = 0 then 'MyISAM' else 'InnoDB' end as engine,
       case when o_orderkey % 11 = 0 then 'utf8mb4_0900_ai_ci' else 'utf8mb4_bin' end as table_collation
from {orders}""")

FIXTURES["cat_columns"] = (["lineitem", "orders"], f"""
select 'db' || cast(o.o_custkey % 20 as string) as source_id,
       case o.o_orderkey % 5 when 0 then 'sales' when 1 then 'hr' else 'dbo' end as schema_name,
       't' || cast(l.l_orderkey as string) as table_name,
       'c' || cast(row_number() over (partition by l.l_orderkey order by {LINE_ORDER}) as string) as column_name,
       cast(row_number() over (partition by l.l_orderkey order by {LINE_ORDER}) as int) as ordinal_position,
       case l.l_partkey % 16 when 0 then 'geography' when 1 then 'xml' when 2 then 'sql_variant' when 3 then 'hierarchyid'
            when 4 then 'money' when 5 then 'nvarchar' when 6 then 'varbinary' when 7 then 'datetime2' when 8 then 'decimal'
            when 9 then 'image' when 10 then 'tinyint' when 11 then 'bit' when 12 then 'uniqueidentifier' when 13 then 'varchar'
            when 14 then 'customtype' else 'bigint' end as data_type,
       case when l.l_suppkey % 4 = 0 then -1 else cast(l.l_suppkey * 10 as int) end as max_length,
       cast(10 + l.l_partkey % 9 as int) as num_precision,
       case when l.l_partkey % 8 = 7 then null else cast(l.l_partkey % 8 as int) end as num_scale,
       l.l_linenumber % 2 = 0 as is_nullable,
       l.l_returnflag = 'A' as is_identity,
       l.l_returnflag = 'R' and l.l_linestatus = 'O' as is_computed,
       l.l_partkey % 97 = 0 as is_filestream,
       case when l.l_partkey % 2 = 0 then 'Latin1_General_CS_AS' when l.l_partkey % 3 = 0 then 'Thai_CI_AS'
            when l.l_partkey % 5 = 0 then 'Thai_BIN' else 'SQL_Latin1_General_CP1_CI_AS' end as collation_name,
       case when l.l_suppkey % 3 = 0 then '(isnull([a],0))' when l.l_suppkey % 3 = 1 then '([a]+[b])' end as computed_definition,
       case l.l_linenumber when 1 then '0' when 2 then 'CURRENT_TIMESTAMP' when 3 then '(uuid())' when 4 then 'new'
            when 5 then '  ' when 6 then '-1.5' end as column_default
from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey""")

FIXTURES["my_columns"] = (["lineitem"], f"""
select 'db' || cast(l_orderkey % 20 as string) as source_id,
       case l_orderkey % 5 when 0 then 'sales' when 1 then 'hr' else 'shop' end as schema_name,
       't' || cast(l_orderkey as string) as table_name,
       'c' || cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as string) as column_name,
       cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as int) as ordinal_position,
       case l_partkey % 12 when 0 then 'bigint' when 1 then case when l_orderkey % 20 < 10 then 'point' else 'int' end
            when 2 then 'longblob' when 3 then 'text' when 4 then 'json' when 5 then 'enum' when 6 then 'varchar'
            when 7 then 'datetime' when 8 then 'decimal' when 9 then 'mediumblob' when 10 then 'geomcollection' else 'int' end as data_type,
       case l_suppkey % 4 when 0 then null when 1 then 'latin1' else 'utf8mb4' end as character_set_name,
       case l_suppkey % 4 when 0 then null when 1 then 'latin1_swedish_ci' when 2 then 'UTF8MB4_0900_AI_CI'
            else 'utf8mb4_bin' end as collation_name,
       case l_linenumber when 1 then '0' when 2 then 'CURRENT_TIMESTAMP' when 3 then '(uuid())' when 4 then 'new'
            when 5 then '  ' when 6 then '-1.5' end as column_default
from {{lineitem}}""")

FIXTURES["cat_index_columns"] = (["lineitem"], f"""
select 'db' || cast(l_orderkey % 20 as string) as source_id,
       case l_orderkey % 5 when 0 then 'sales' when 1 then 'hr' else 'dbo' end as schema_name,
       't' || cast(l_orderkey as string) as table_name,
       case l_linenumber % 3 when 0 then 'PRIMARY' else 'ix' || cast(l_linenumber % 3 as string) end as index_name,
       case when l_orderkey % 13 = 0 and l_linenumber % 3 = 1 then 'FULLTEXT'
            when l_orderkey % 17 = 0 and l_linenumber % 3 = 2 then 'NONCLUSTERED COLUMNSTORE' else 'BTREE' end as index_type,
       l_linenumber % 3 <> 1 as is_unique,
       l_linenumber % 3 = 0 as is_primary_key,
       case when l_orderkey % 19 = 0 and l_linenumber % 3 = 1 then '([a] is not null)' end as filter_definition,
       'c' || cast(l_partkey as string) as column_name,
       cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as int) as key_ordinal,
       l_suppkey % 5 = 0 as is_included
from {{lineitem}}""")

FIXTURES["cat_fk_columns"] = (["lineitem"], f"""
select 'db' || cast(l_orderkey % 20 as string) as source_id,
       case l_orderkey % 5 when 0 then 'sales' when 1 then 'hr' else 'dbo' end as schema_name,
       't' || cast(l_orderkey as string) as table_name,
       'fk' || cast(l_linenumber % 2 as string) as fk_name,
       case when l_linenumber % 4 = 3 then null else 'dbo' end as ref_schema,
       case when l_linenumber % 4 = 3 then null else 't' || cast(l_orderkey + 1 as string) end as ref_table,
       'c' || cast(l_partkey as string) as column_name,
       'r' || cast(l_suppkey as string) as ref_column,
       case when l_orderkey % 2 = 0 then 'CASCADE' else 'NO_ACTION' end as delete_action,
       'NO_ACTION' as update_action,
       cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as int) as ordinal_position
from {{lineitem}}""")

FIXTURES["cat_partitions"] = (["lineitem"], """
select 'db' || cast(l_orderkey % 20 as string) as source_id, 't' || cast(l_orderkey as string) as table_name,
       case when l_linenumber % 3 = 0 then null else 'p' || cast(l_linenumber as string) end as partition_name,
       case when l_linenumber % 2 = 0 then 'RANGE' else 'HASH' end as partition_method, cast(l_quantity as bigint) as table_rows
from {lineitem}""")

# ---- SQL Server system catalog ------------------------------------------------------------------------------------
FIXTURES["sys_schemas"] = (["orders"], """
select distinct 'db' || cast(o_orderkey % 20 as string) as source_id, o_orderkey % 6 as schema_id,
       case o_orderkey % 6 when 0 then 'sales' when 1 then 'hr' when 2 then 'guest' when 3 then 'empty'
            when 4 then 'sys' else 'dbo' end as name
from {orders}""")

FIXTURES["sys_tables"] = (["orders"], """
select 'db' || cast(o_orderkey % 20 as string) as source_id, o_orderkey as object_id,
       case when o_orderkey % 6 = 3 then o_orderkey % 2 else o_orderkey % 6 end as schema_id,
       't' || cast(o_orderkey as string) as name, o_orderkey % 37 = 0 as is_memory_optimized,
       cast(case when o_orderkey % 31 = 0 then 2 else 0 end as int) as temporal_type
from {orders}""")

FIXTURES["sys_partitions"] = (["lineitem"], """
select 'db' || cast(l_orderkey % 20 as string) as source_id, l_orderkey as object_id,
       cast(l_linenumber % 4 as int) as index_id, l_orderkey * 10 + l_linenumber as partition_id,
       cast(sum(cast(l_quantity as bigint)) as bigint) as row_count
from {lineitem} group by l_orderkey, l_linenumber""")

FIXTURES["sys_allocation_units"] = (["lineitem"], """
select 'db' || cast(l_orderkey % 20 as string) as source_id, l_orderkey * 10 + l_linenumber as container_id,
       cast(l_partkey % 640 as bigint) as total_pages, cast(l_partkey % 512 as bigint) as used_pages
from {lineitem}""")

FIXTURES["sys_partition_stats"] = (["lineitem"], """
select 'db' || cast(l_orderkey % 20 as string) as source_id, l_orderkey as object_id,
       cast(l_quantity as bigint) as row_count, cast(l_partkey % 640 as bigint) as reserved_pages,
       cast(l_partkey % 512 as bigint) as used_pages, cast(l_partkey % 200 as bigint) as in_row_pages,
       cast(l_suppkey % 50 as bigint) as lob_pages, cast(l_linenumber as bigint) as overflow_pages
from {lineitem}""")

FIXTURES["sys_columns"] = (["lineitem"], f"""
select 'db' || cast(l_orderkey % 20 as string) as source_id, l_orderkey as object_id,
       cast(row_number() over (partition by l_orderkey order by {LINE_ORDER}) as int) as column_id,
       'c' || cast(l_partkey as string) as name, cast(l_partkey % 12 as int) as user_type_id,
       cast(l_suppkey as int) as max_length, l_linenumber % 2 = 0 as is_nullable
from {{lineitem}}""")

FIXTURES["sys_types"] = (["part"], """
select distinct cast(p_partkey % 12 as int) as user_type_id, 'type' || cast(p_partkey % 12 as string) as name
from {part}""")

FIXTURES["sys_computed_columns"] = (["sys_columns"], """
select source_id, object_id, column_id, '(' || name || '*2)' as definition from {sys_columns} where max_length % 7 = 0""")

FIXTURES["sys_default_constraints"] = (["sys_columns"], """
select source_id, object_id, column_id, '((' || cast(max_length as string) || '))' as definition
from {sys_columns} where max_length % 3 = 0""")

FIXTURES["sys_objects"] = (["documents"], """
select 'db' || cast(doc_id % 20 as string) as source_id, doc_id as object_id, doc_id % 6 as schema_id,
       'm' || cast(doc_id as string) as name,
       case doc_id % 5 when 0 then 'P' when 1 then 'FN' when 2 then 'TR' when 3 then 'V' else 'X' end as type,
       case doc_id % 5 when 0 then 'SQL_STORED_PROCEDURE' when 1 then 'SQL_SCALAR_FUNCTION' when 2 then 'SQL_TRIGGER'
            when 3 then 'VIEW' else 'EXTENDED_STORED_PROCEDURE' end as type_desc,
       case when doc_id % 3 = 0 then null else doc_id + 100 end as parent_id,
       doc_id % 4 = 2 as is_instead_of_trigger
from {documents}""")

FIXTURES["sys_sql_modules"] = (["documents"], """
select 'db' || cast(doc_id % 20 as string) as source_id, doc_id as object_id,
       case when doc_id % 7 = 0 then 'CREATE VIEW v WITH SCHEMABINDING AS ' || text else text end as definition
from {documents} where doc_id % 9 <> 0""")

FIXTURES["sys_assembly_modules"] = (["documents"], """
select 'db' || cast(doc_id % 20 as string) as source_id, doc_id as object_id, doc_id % 3 as assembly_id
from {documents} where doc_id % 11 = 0""")

FIXTURES["sys_assemblies"] = (["documents"], """
select distinct 'db' || cast(doc_id % 20 as string) as source_id, doc_id % 3 as assembly_id,
       'asm' || cast(doc_id % 3 as string) as name
from {documents}""")

FIXTURES["sys_indexes"] = (["documents"], """
select 'db' || cast(doc_id % 20 as string) as source_id, doc_id as object_id, cast(n_chars % 3 as int) as index_id
from {documents}""")

# ---- text objects and logs ----------------------------------------------------------------------------------------
FIXTURES["cat_modules"] = (["documents"], """
select 'db' || cast(doc_id % 20 as string) as source_id,
       case doc_id % 4 when 0 then 'trigger' when 1 then 'view' else 'routine' end as kind,
       case when doc_id % 4 < 2 then null when doc_id % 8 = 2 then 'FUNCTION' else 'PROCEDURE' end as routine_type,
       'dbo' as schema_name, 'm' || cast(doc_id as string) as name,
       doc_id % 22 = 0 as is_clr, doc_id % 12 = 0 as is_instead_of,
       case when doc_id % 4 = 0 then 'BEFORE' end as action_timing,
       case when doc_id % 4 = 0 then 'INSERT' end as event_manipulation,
       case when doc_id % 4 = 0 then 't' || cast(doc_id as string) end as event_table,
       'CREATE OBJECT m' || chr(10)
       || case when doc_id % 3 = 0 then 'MERGE INTO a USING b' || chr(10) || 'merge into c' || chr(10) else '' end
       || case when doc_id % 5 = 0 then 'SELECT 1 FOR  XML PATH' || chr(10) else '' end
       || case when doc_id % 7 = 0 then 'DECLARE c1 CURSOR FOR SELECT 1' || chr(10) else '' end
       || case when doc_id % 11 = 0 then 'EXEC sp_executesql @s' || chr(10) else '' end
       || case when doc_id % 13 = 0 then 'SELECT * INTO #tmp FROM t WITH (NOLOCK)' || chr(10) else '' end
       || case when doc_id % 17 = 0 then 'IF x WHILE y CALL dbo.p COMMIT' || chr(10) || chr(10) else '' end
       || case when doc_id % 19 = 0 then 'SELECT next value  for s, SCOPE_IDENTITY()' || chr(10) else '' end
       || case when doc_id % 2 = 0 then 'SELECT GETDATE(), ISNULL(a,b), LEN(c)' || chr(10) else '' end
       || text || chr(10) || 'END' as definition
from {documents}""")

FIXTURES["query_log"] = (["conversations"], """
select 'db' || cast(conv_id % 20 as string) as source_id, conv_id * 100 + turn as digest_id,
       case (conv_id + turn) % 9 when 0 then 'XA START ? ' || text when 1 then 'SELECT GET_LOCK ( ? , ? ) ' || text
            when 2 then 'SELECT SQL_CALC_FOUND_ROWS * FROM t ' || text when 3 then 'SELECT ST_Distance ( a , b ) ' || text
            when 4 then 'SELECT ExtractValue ( x , ? ) ' || text when 5 then 'SELECT * FROM t FOR UPDATE SKIP LOCKED ' || text
            when 6 then '  ' else 'SELECT * FROM t WHERE id = ? ' || text end as digest_text,
       cast(conv_id * 7 + turn as bigint) as count_star,
       cast((conv_id * 7919 + turn * 104729) % 1000003 as bigint) as sum_timer_wait,
       (conv_id + turn) % 4 <> 0 as transpile_ok
from {conversations}""")

FIXTURES["tsql_log"] = (["conversations"], """
select 'db' || cast(conv_id % 15 as string) as source_id, conv_id * 100 + turn as digest_id,
       case (conv_id + turn) % 7 when 0 then 'MERGE a USING b ' || text when 1 then 'SELECT 1 FOR XML PATH ' || text
            when 2 then 'SELECT * FROM a CROSS APPLY f(x) OUTER APPLY g(y) ' || text
            when 3 then 'SELECT * FROM a PIVOT (x) ' || text when 4 then 'SELECT * FROM a WITH (NOLOCK) ' || text
            when 5 then '  ' else 'SELECT 1 ' || text end as digest_text,
       cast(conv_id * 7 + turn as bigint) as execution_count,
       (conv_id + turn) % 4 <> 0 as transpile_ok
from {conversations}""")

FIXTURES["server_meta"] = (["nation"], """
select 'db' || cast(n_nationkey as string) as source_id,
       case when n_nationkey % 7 = 6 then null when n_nationkey % 4 = 0 then 'STATEMENT' else 'row' end as binlog_format,
       case when n_nationkey % 5 = 0 then '2.11.3' else '3.07.1' end as engine_version,
       case when n_nationkey % 3 = 0 then 'latin1' else 'utf8mb4' end as character_set_server,
       cast(n_nationkey % 3 as int) as lower_case_table_names,
       case when n_nationkey % 2 = 0 then 'Enterprise Edition' when n_nationkey % 3 = 0 then 'Standard Edition' else 'Web' end as edition,
       cast(2 + n_nationkey % 12 as int) as cpu_count,
       n_nationkey % 2 = 1 as cdc_enabled,
       case when n_nationkey % 4 = 3 then '12.0.2000' when n_nationkey % 4 = 2 then 'n/a' else '15.0.1' end as product_version,
       case when n_nationkey % 3 = 0 then 'utf8mb4_bin' when n_nationkey % 3 = 1 then 'Thai_CI_AS'
            else 'SQL_Latin1_General_CP1_CI_AS' end as db_collation,
       case when n_nationkey % 5 = 0 then 'Windows' else 'mixed' end as auth_mode,
       n_nationkey % 6 = 0 as has_ssis
from {nation} where n_nationkey < 20""")

FIXTURES["server_variables"] = (["customer"], """
select 'db' || cast(c_custkey % 20 as string) as source_id,
       case c_custkey % 7 when 0 then 'binlog_format' when 1 then 'version' when 2 then 'lower_case_table_names'
            when 3 then 'character_set_server' when 4 then 'cpu_count' else 'other' end as name,
       max(case when c_custkey % 7 = 4 then cast(c_nationkey as string) when c_custkey % 7 = 2 then 'x' || cast(c_nationkey as string)
            else c_mktsegment end) as value
from {customer} group by c_custkey % 20, c_custkey % 7""")

FIXTURES["cat_jobs"] = (["supplier"], """
select 'db' || cast(s_suppkey % 23 as string) as source_id, 'job' || cast(s_suppkey as string) as job_name,
       s_suppkey % 2 = 0 as enabled
from {supplier} where s_suppkey % 23 < 12""")

FIXTURES["cat_server_objects"] = (["customer"], """
select 'db' || cast(c_custkey % 13 as string) as source_id,
       case when c_custkey % 3 = 0 then 'assembly' else 'linked_server' end as kind,
       'o' || cast(c_custkey as string) as name, cast(c_custkey % 4 as int) as server_id
from {customer} where c_custkey % 13 <> 5""")

FIXTURES["metrics"] = (["events"], """
select 'db' || cast(user_id % 20 as string) as source_id, ts,
       case event_id % 4 when 0 then 'ServerlessDatabaseCapacity' when 1 then 'VolumeBytesUsed'
            when 2 then 'VolumeReadIOPs' else 'VolumeWriteIOPs' end as metric,
       cast(floor(value * 100) as bigint) / 64.0 as value
from {events}""")

# ---- data copies --------------------------------------------------------------------------------------------------
FIXTURES["orders_tgt"] = (["orders"], """
select o_orderkey, o_custkey,
       case when o_orderkey % 101 = 0 then o_orderstatus || '  ' else o_orderstatus end as o_orderstatus,
       case when o_orderkey % 89 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice,
       o_orderdate,
       case when o_orderkey % 178 = 0 then null else o_orderpriority end as o_orderpriority
from {orders} where o_orderkey % 97 <> 0
union all
select o_orderkey + 1000000000 as o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from {orders} where o_orderkey % 113 = 0""")

FIXTURES["lineitem_tgt"] = (["lineitem"], """
select * from {lineitem} where l_partkey % 83 <> 0
union all
select * from {lineitem} where l_partkey % 79 = 0""")

FIXTURES["customer_tgt"] = (["customer"], """
select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from {customer} where c_custkey % 50 <> 0""")

FIXTURES["documents_tgt"] = (["documents"], """
select doc_id, case when doc_id % 41 = 0 then text || 'x' else text end as text, lang, source, n_chars
from {documents} where doc_id % 43 <> 0""")

FIXTURES["changes"] = (["events"], """
select event_id as seq, ts as commit_ts,
       cast(user_id as string) || ':' || event_type as row_key,
       case when event_id % 10 = 9 then 'D' when event_id % 10 < 3 then 'I' else 'U' end as op,
       value
from {events}""")

FIXTURES["staged_rows"] = (["lineitem"], """
select l_orderkey as row_id, l_linenumber,
       cast(l_partkey as string) as tiny_text,
       cast(l_extendedprice as decimal(18,2)) as amount,
       case when l_suppkey % 10 = 0 then 'n/a' else cast(l_suppkey as string) end as qty_text,
       case when l_partkey % 20 = 0 then null else l_returnflag || '-' || cast(l_partkey as string) end as label
from {lineitem}""")

# ---- run and usage logs -------------------------------------------------------------------------------------------
FIXTURES["run_events"] = (["events"], """
select 'run' || cast(user_id as string) || '-' || cast(event_id % 7 as string) as run_id,
       case event_id % 4 when 0 then 'scan' when 1 then 'convert' when 2 then 'load' else 'check' end as phase,
       case when event_id % 3 = 0 then 'start' else 'complete' end as step,
       case when event_type = 'error' then 'error' else 'ok' end as outcome,
       ts, event_id as line_no, cast(floor(value * 10) as bigint) as duration_ms,
       case when event_id % 5 = 0 then cast(event_id % 100 as bigint) end as overall_score,
       case when event_id % 2 = 0 then cast(event_id % 90 as bigint) end as score,
       case event_id % 6 when 0 then 'LOCALHOST:3306' when 1 then 'prod.cluster-abc.eu.rds.amazonaws.com'
            when 2 then 'x.rds.amazonaws.com' when 3 then 'gw.target.example' when 4 then '[::1]' else 'db.example.org' end as host
from {events}""")

FIXTURES["usage_log"] = (["conversations"], """
select case when conv_id % 7 = 3 then 's' || cast(conv_id - 3 as string) || '/subagents/a' || cast(conv_id as string)
            else 's' || cast(conv_id as string) end as file_name,
       turn as line_no, role, text as content,
       cast(length(text) as bigint) as input_tokens, cast((length(text) * 3) % 997 as bigint) as output_tokens,
       cast((length(text) * 7) % 499 as bigint) as cache_write_tokens, cast((length(text) * 11) % 1999 as bigint) as cache_read_tokens,
       case when turn % 4 = 1 then 'model-a' else 'model-b' end as model
from {conversations}""")
