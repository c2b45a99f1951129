"""Queries on type, name and collation mapping and on conforming rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.constants import COLLATION_MAP, TYPE_MAP
from crossover.operators import inventory as inv
from crossover.operators import mapping as mp
from crossover.queries.registry import query
from crossover.queries.text import case_of

TARGET = f"""CASE WHEN data_type = 'nvarchar' AND max_length > 0 THEN 'VARCHAR(' || max_length // 2 || ')' WHEN data_type = 'varchar' AND max_length > 0 THEN 'VARCHAR(' || max_length || ')'
  WHEN data_type = 'varbinary' AND max_length > 0 THEN 'VARBINARY(' || max_length || ')' WHEN data_type = 'varbinary' AND max_length < 0 THEN 'LONGBLOB'
  WHEN data_type IN ('nvarchar', 'varchar') AND max_length < 0 THEN 'LONGTEXT'
  WHEN data_type = 'decimal' THEN 'DECIMAL(' || num_precision || ',' || coalesce(num_scale, 0) || ')' WHEN data_type = 'datetime2' THEN 'DATETIME(' || least(coalesce(num_scale, 6), 6) || ')'
  ELSE coalesce({case_of(TYPE_MAP, 'data_type')}, upper(data_type)) END"""
KEY = "source_id, schema_name, table_name, column_name"


@query("map_types", "cat_columns", sql=f"SELECT {KEY}, data_type, {TARGET} AS target_type, data_type <> 'customtype' AS known_type FROM cat_columns")
def map_types(f):
    return mp.map_types(f["cat_columns"]).select("source_id", "schema_name", "table_name", "column_name", "data_type", "target_type", "known_type")


@query("map_names_prefix", "cat_tables", sql="""SELECT source_id, schema_name, table_name, NULL::varchar AS target_db,
  CASE WHEN schema_name = 'dbo' THEN table_name ELSE schema_name || '_' || table_name END AS target_table FROM cat_tables""")
def map_names_prefix(f):
    return mp.map_names(f["cat_tables"].select("source_id", "schema_name", "table_name"), "prefix")


@query("map_names_database", "cat_tables", sql="SELECT source_id, schema_name, table_name, schema_name AS target_db, table_name AS target_table FROM cat_tables")
def map_names_database(f):
    return mp.map_names(f["cat_tables"].select("source_id", "schema_name", "table_name"), "database")


SHORT = "short AS (SELECT source_id, schema_name, 't' || (data_length // 65536) % 5000 AS table_name FROM cat_tables)"


def short_names(f):
    return f["cat_tables"].select("source_id", "schema_name", F.concat(F.lit("t"), ((F.col("data_length") / 65536).cast("long") % 5000).cast("string")).alias("table_name"))


@query("name_collisions", "cat_tables", sql=f"""WITH {SHORT}, d AS (SELECT DISTINCT * FROM short)
SELECT source_id, schema_name, table_name, table_name AS target_table, n AS tables FROM (SELECT *, count(*) OVER (PARTITION BY source_id, table_name) AS n FROM d) WHERE n > 1""")
def name_collisions(f):
    return mp.name_collisions(mp.map_names(short_names(f), "flatten"))


@query("orphan_tables", "cat_tables", "cat_columns", sql="""SELECT source_id, schema_name, table_name FROM cat_tables t WHERE NOT EXISTS (
  SELECT 1 FROM cat_columns c WHERE c.source_id = t.source_id AND c.schema_name = t.schema_name AND c.table_name = t.table_name)""")
def orphan_tables(f):
    return mp.orphan_tables(f["cat_tables"], f["cat_columns"])


@query("target_schema", "cat_columns", "cat_index_columns", sql=f"""WITH c AS (SELECT *, {TARGET} AS target_type FROM cat_columns),
p AS (SELECT source_id, schema_name, table_name, string_agg(column_name, ',' ORDER BY key_ordinal) FILTER (NOT is_included) AS pk FROM cat_index_columns
  WHERE is_primary_key GROUP BY 1, 2, 3)
SELECT c.source_id, c.schema_name, c.table_name, string_agg(column_name || ' ' || target_type || CASE WHEN is_nullable THEN '' ELSE ' not null' END
  || CASE WHEN is_identity THEN ' identity' ELSE '' END || CASE WHEN is_computed THEN ' computed' ELSE '' END, ',' ORDER BY ordinal_position) AS fields, coalesce(any_value(pk), '') AS primary_key
FROM c LEFT JOIN p ON p.source_id = c.source_id AND p.schema_name = c.schema_name AND p.table_name = c.table_name GROUP BY 1, 2, 3""")
def target_schema(f):
    t = mp.target_schema(f["cat_columns"], inv.indexes(f["cat_index_columns"]))
    text = F.transform("fields", lambda x: F.concat(
        x["column_name"], F.lit(" "), x["target_type"], F.when(x["is_nullable"], "").otherwise(" not null"),
        F.when(x["is_identity"], " identity").otherwise(""), F.when(x["is_computed"], " computed").otherwise("")))
    return t.select("source_id", "schema_name", "table_name", F.array_join(text, ",").alias("fields"),
                    F.coalesce(F.array_join("primary_key", ","), F.lit("")).alias("primary_key"))


@query("map_mysql", "my_columns", sql=f"""SELECT {KEY}, data_type, collation_name, CASE WHEN data_type IN ('point', 'geomcollection') THEN 'json' ELSE data_type END AS target_type,
  CASE WHEN lower(collation_name) = 'utf8mb4_0900_ai_ci' THEN 'utf8mb4_general_ci' ELSE collation_name END AS target_collation,
  concat_ws('; ', CASE WHEN data_type IN ('point', 'geomcollection') THEN 'spatial to json' END,
    CASE WHEN lower(collation_name) = 'utf8mb4_0900_ai_ci' THEN 'collation replaced' END) AS notes FROM my_columns""")
def map_mysql(f):
    return mp.map_mysql(f["my_columns"].select("source_id", "schema_name", "table_name", "column_name", "data_type", "collation_name"))


@query("map_engines", "cat_tables", sql="""SELECT source_id, schema_name, table_name, 'InnoDB' AS target_engine, engine <> 'InnoDB' AS engine_changed,
  CASE WHEN table_collation = 'utf8mb4_0900_ai_ci' THEN 'utf8mb4_general_ci' ELSE table_collation END AS target_collation FROM cat_tables""")
def map_engines(f):
    return mp.map_engines(f["cat_tables"])


@query("map_collations", "cat_columns", sql=f"""SELECT source_id, collation_name, count(*) AS column_count,
  coalesce({case_of(COLLATION_MAP, 'collation_name')}, CASE WHEN collation_name LIKE '%\\_CI%' ESCAPE '\\' THEN 'utf8mb4_general_ci' ELSE 'utf8mb4_bin' END) AS target_collation
FROM cat_columns GROUP BY 1, 2""")
def map_collations(f):
    return mp.map_collations(f["cat_columns"])


@query("plan_indexes", "cat_index_columns", sql="""SELECT DISTINCT source_id, schema_name, table_name, index_name, CASE WHEN index_name = 'PRIMARY' THEN 'with_table'
  WHEN index_type = 'FULLTEXT' THEN 'drop' WHEN is_unique THEN 'create_unique' ELSE 'create' END AS action FROM cat_index_columns""")
def plan_indexes(f):
    return mp.plan_indexes(inv.indexes(f["cat_index_columns"]), "self_hosted")


@query("classify_defaults", "my_columns", sql=f"""SELECT {KEY}, CASE WHEN column_default IS NULL OR trim(column_default) = '' THEN 'none' WHEN column_default = 'CURRENT_TIMESTAMP' THEN 'keyword'
  WHEN column_default IN ('0', '-1.5') THEN 'number' WHEN column_default LIKE '(%' THEN 'expression' ELSE 'literal' END AS default_kind FROM my_columns""")
def classify_defaults(f):
    return mp.classify_defaults(f["my_columns"])


@query("schema_diff", "cat_columns", sql=f"""WITH a AS (SELECT {KEY}, data_type, is_nullable FROM cat_columns WHERE NOT is_filestream),
b AS (SELECT {KEY}, CASE WHEN max_length % 70 = 0 THEN 'bigint' ELSE data_type END AS data_type, is_nullable FROM cat_columns WHERE NOT is_computed)
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.schema_name, b.schema_name) AS schema_name, coalesce(a.table_name, b.table_name) AS table_name,
  coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN a.source_id IS NULL THEN 'added' WHEN b.source_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  a.data_type AS old_data_type, a.is_nullable AS old_is_nullable, b.data_type AS new_data_type, b.is_nullable AS new_is_nullable
FROM a FULL JOIN b ON a.source_id = b.source_id AND a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.column_name = b.column_name
WHERE a.data_type IS DISTINCT FROM b.data_type OR a.is_nullable IS DISTINCT FROM b.is_nullable""")
def schema_diff(f):
    c = f["cat_columns"]
    after = c.where("not is_computed").withColumn("data_type", F.when(F.col("max_length") % 70 == 0, "bigint").otherwise(F.col("data_type")))
    return mp.schema_diff(c.where("not is_filestream"), after, ["data_type", "is_nullable"])


FIELDS = [mp.Field("row_id", T.LongType()), mp.field_for("tiny_text", "TINYINT UNSIGNED"), mp.field_for("amount", "DECIMAL(6,1)"),
          mp.field_for("qty_text", "INT"), mp.field_for("label", "VARCHAR(5)", nullable=False)]

FAULTS = """
faults AS (SELECT row_id, l_linenumber, 'tiny_text' AS column_name, tiny_text AS value, 'overflow' AS reason FROM staged_rows WHERE tiny_text::bigint > 255 AND tiny_text::bigint <= 32767
UNION ALL SELECT row_id, l_linenumber, 'tiny_text', tiny_text, 'bad_value' FROM staged_rows WHERE tiny_text::bigint > 32767
UNION ALL SELECT row_id, l_linenumber, 'amount', amount::varchar, CASE WHEN round(amount, 1) >= 100000 THEN 'bad_value' ELSE 'loses_digits' END FROM staged_rows
  WHERE round(amount, 1) >= 100000 OR amount <> round(amount, 1)
UNION ALL SELECT row_id, l_linenumber, 'qty_text', qty_text, 'bad_value' FROM staged_rows WHERE qty_text = 'n/a'
UNION ALL SELECT row_id, l_linenumber, 'label', label, CASE WHEN label IS NULL THEN 'null_not_allowed' ELSE 'too_long' END FROM staged_rows WHERE label IS NULL OR length(label) > 5)"""


@query("conform_rejects", "staged_rows", sql=f"WITH {FAULTS} SELECT * FROM faults")
def conform_rejects(f):
    return mp.conform(f["staged_rows"], FIELDS)[1].select("row_id", "l_linenumber", "column_name", "value", "reason")


@query("conform_rows", "staged_rows", sql="""SELECT row_id, tiny_text::smallint AS tiny_text, round(amount, 1)::double AS amount, qty_text::int AS qty_text, label FROM staged_rows
WHERE tiny_text::bigint <= 255 AND round(amount, 1) < 100000 AND amount = round(amount, 1) AND qty_text <> 'n/a' AND length(label) <= 5""")
def conform_rows(f):
    return mp.conform(f["staged_rows"], FIELDS)[0].withColumn("amount", F.col("amount").cast("double"))
