"""Fixed schemas of everything that is read, as DDL; nothing is inferred."""

CATALOG = {
    "tables": ("schema_name string, table_name string, table_type string, engine string, table_rows bigint, data_length bigint, "
                      "index_length bigint, auto_increment bigint, table_collation string, is_temporal boolean, is_memory_optimized boolean, "
                      "is_heap boolean, source_id string"),
    "columns": ("schema_name string, table_name string, column_name string, ordinal_position int, data_type string, max_length int, "
                       "num_precision int, num_scale int, is_nullable boolean, column_default string, is_identity boolean, is_computed boolean, "
                       "is_filestream boolean, computed_definition string, character_set_name string, collation_name string, source_id string"),
    "modules": ("kind string, schema_name string, name string, routine_type string, definition string, is_clr boolean, is_instead_of boolean, "
                       "action_timing string, event_manipulation string, event_table string, source_id string"),
}

RUN_EVENT = ("run_id string, phase string, step string, outcome string, timestamp timestamp_ntz, duration_ms bigint, "
                    "metrics map<string,string>, error string, version string, _corrupt_record string")

USAGE_LINE = ("type string, message struct<role string, content string, model string, usage struct<input_tokens bigint, output_tokens bigint, "
                     "cache_creation_input_tokens bigint, cache_read_input_tokens bigint>>, _corrupt_record string")

# Sections of a scan report as they are written. A schema is named table_schema by some reports and schema_name by others.
REPORT_SECTIONS = {
    "tables": "table_schema string, schema_name string, table_name string, engine string, row_format string, table_rows bigint, data_length bigint, index_length bigint, "
              "auto_increment bigint, table_collation string, create_options string",
    "columns": "table_schema string, schema_name string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string, "
               "column_type string, character_set_name string, collation_name string, column_key string, extra string, generation_expression string",
    "indexes": "table_schema string, schema_name string, table_name string, index_name string, columns string, is_primary_key boolean, non_unique int, index_type string",
    "foreign_keys": "constraint_schema string, table_name string, constraint_name string, referenced_table_schema string, referenced_table_name string, columns string, ref_columns string",
    "routines": "routine_schema string, routine_name string, routine_type string, data_type string, routine_body string, routine_definition string, is_deterministic string, "
                "security_type string, definer string",
    "triggers": "trigger_schema string, trigger_name string, event_manipulation string, event_object_table string, action_statement string, action_timing string",
    "views": "table_schema string, table_name string, view_definition string, check_option string, is_updatable string, definer string, security_type string",
    "events": "event_schema string, event_name string, event_type string, execute_at string, interval_value string, interval_field string, event_definition string, status string",
    "partitions": "table_schema string, table_name string, partition_name string, partition_method string, partition_expression string, partition_description string, "
                  "subpartition_method string, subpartition_expression string",
    "charset_usage": "character_set_name string, collation_name string, column_count bigint",
}

REPORT_SUMMARY = "overall_score int, rating string, table_count bigint, total_data_size_gb double"

REPORT = (f"version string, source struct<host string>, summary struct<{REPORT_SUMMARY}>, "
          "schema_inventory struct<" + ", ".join(f"{n} array<struct<{f}>>" for n, f in REPORT_SECTIONS.items()) + ">")

MANIFEST = ("run_token string, table_name string, shard int, row_count bigint, status string, recorded_at timestamp, message string")

PUBLISHED = "run_token string, table_name string, shard int, folder string, row_count bigint, hash_xor bigint, hash_sum decimal(38,0), recorded_at timestamp"
