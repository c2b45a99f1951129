"""Catalog inventory: tables, columns, indexes, keys and modules of many databases, grouped by ``source_id``.

Catalog rows of the hot source spread over all tasks: every grouping is on the object, or aggregates partially first.
An ordered column list is collected per index or key only, whose length the source database itself limits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossover.functions.constants import MSSQL_SPATIAL_TYPES, MYSQL_SPATIAL_TYPES, SYSTEM_SCHEMAS

PAGE_KB = 8


def in_scope(df: DataFrame, dialect: str = "mysql", database: str | None = None, schema_col: str = "schema_name") -> DataFrame:
    """Leave out system schemas, or keep one database; a plain filter that reaches the source."""
    if database and database != "*":
        return df.where(F.col(schema_col) == database)
    return df.where(~F.col(schema_col).isin(SYSTEM_SCHEMAS[dialect]))


def select_tables(tables: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keep the named tables (None or ``*`` is all) and drop the excluded ones."""
    spark = tables.sparkSession
    if include and include != ["*"]:
        tables = tables.join(spark.createDataFrame([(n,) for n in include], "table_name string"), "table_name", "left_semi")
    if exclude:
        tables = tables.join(spark.createDataFrame([(n,) for n in exclude], "table_name string"), "table_name", "left_anti")
    return tables


def base_tables(tables: DataFrame) -> DataFrame:
    zero = {c: 0 for c in ("table_rows", "data_length", "index_length", "auto_increment") if c in tables.columns}
    return tables.where(F.col("table_type") == "BASE TABLE").fillna(zero)


# ---- SQL Server system catalog ------------------------------------------------------------------------------------

def tables_mssql(tables: DataFrame, schemas: DataFrame, partitions: DataFrame, units: DataFrame, heaps: DataFrame) -> DataFrame:
    """Tables with row count, size and flags.

    Rows and pages are each brought to one row per table before the join. Joining allocation units to partitions
    first would count the rows of a partition once per unit.
    """
    obj = ["source_id", "object_id"]
    counts = partitions.groupBy(*obj).agg(F.sum(F.when(F.col("index_id").isin(0, 1), F.col("row_count")).otherwise(0)).alias("row_count"))
    unit_pages = units.groupBy("source_id", F.col("container_id").alias("partition_id")).agg(
        F.sum("total_pages").alias("total_pages"), F.sum("used_pages").alias("used_pages"))
    pages = (partitions.select(*obj, "partition_id").join(unit_pages, ["source_id", "partition_id"])
             .groupBy(*obj).agg(F.sum("total_pages").alias("total_pages"), F.sum("used_pages").alias("used_pages")))
    heap = heaps.where("index_id = 0").select(*obj).distinct().withColumn("is_heap", F.lit(True))
    names = schemas.select("source_id", "schema_id", F.col("name").alias("schema_name"))

    def mb(c: str) -> Column:
        return F.coalesce(F.col(c) * PAGE_KB / 1024.0, F.lit(0.0)).alias(c.replace("_pages", "_mb"))

    return (tables.join(names, ["source_id", "schema_id"]).join(counts, obj, "left").join(pages, obj, "left").join(heap, obj, "left")
            .select("source_id", "schema_name", F.col("name").alias("table_name"),
                    F.coalesce("row_count", F.lit(0)).alias("row_count"), mb("total_pages"), mb("used_pages"),
                    "is_memory_optimized", (F.col("temporal_type") > 0).alias("is_temporal"),
                    F.coalesce("is_heap", F.lit(False)).alias("is_heap")))


def columns_mssql(columns: DataFrame, tables: DataFrame, schemas: DataFrame, types: DataFrame, computed: DataFrame,
                  defaults: DataFrame) -> DataFrame:
    """Columns with type name, computed definition and default."""
    key = ["source_id", "object_id", "column_id"]
    t = tables.select("source_id", "object_id", "schema_id", F.col("name").alias("table_name"))
    s = schemas.select("source_id", "schema_id", F.col("name").alias("schema_name"))
    ty = types.select("user_type_id", F.col("name").alias("data_type"))
    cc = computed.select(*key, F.col("definition").alias("computed_definition"))
    dc = defaults.select(*key, F.col("definition").alias("default_definition"))
    return (columns.join(t, ["source_id", "object_id"]).join(s, ["source_id", "schema_id"]).join(ty, "user_type_id")
            .join(cc, key, "left").join(dc, key, "left")
            .select("source_id", "schema_name", "table_name", F.col("name").alias("column_name"),
                    F.col("column_id").alias("ordinal_position"), "data_type", "max_length", "is_nullable",
                    F.col("computed_definition").isNotNull().alias("is_computed"), "computed_definition", "default_definition"))


def routines_mssql(objects: DataFrame, schemas: DataFrame, modules: DataFrame, assembly_modules: DataFrame,
                   assemblies: DataFrame) -> DataFrame:
    obj = ["source_id", "object_id"]
    # Assemblies join their modules first: most routines have none, and their NULLs would share one join key.
    names = assemblies.select("source_id", "assembly_id", F.col("name").alias("assembly_name"))
    asm = (assembly_modules.select(*obj, "assembly_id", F.lit(True).alias("has_clr")).join(names, ["source_id", "assembly_id"], "left")
           .select(*obj, "has_clr", "assembly_name"))
    return (objects.where(F.col("type").isin("P", "FN", "IF", "TF"))
            .join(schemas.select("source_id", "schema_id", F.col("name").alias("schema_name")), ["source_id", "schema_id"])
            .join(modules.select(*obj, "definition"), obj, "left")
            .join(asm, obj, "left")
            .select("source_id", "schema_name", F.col("name").alias("routine_name"), F.col("type_desc").alias("routine_type"),
                    "definition", F.coalesce("has_clr", F.lit(False)).alias("is_clr"), "assembly_name"))


def triggers_mssql(triggers: DataFrame, tables: DataFrame, schemas: DataFrame, modules: DataFrame,
                   assembly_modules: DataFrame) -> DataFrame:
    """Triggers; the schema is the table's, else the trigger's own, else ``dbo``."""
    obj = ["source_id", "object_id"]
    t = tables.select("source_id", F.col("object_id").alias("parent_id"), F.col("name").alias("table_name"),
                      F.col("schema_id").alias("_table_schema"))
    keyed = (triggers.join(t, ["source_id", "parent_id"], "left")
             .withColumn("schema_id", F.coalesce("_table_schema", "schema_id")))
    return (keyed.join(schemas.select("source_id", "schema_id", F.col("name").alias("schema_name")), ["source_id", "schema_id"], "left")
            .join(modules.select(*obj, "definition"), obj, "left")
            .join(assembly_modules.select(*obj).withColumn("has_clr", F.lit(True)), obj, "left")
            .select("source_id", F.coalesce("schema_name", F.lit("dbo")).alias("schema_name"), F.col("name").alias("trigger_name"),
                    "table_name", F.col("is_instead_of_trigger").alias("is_instead_of"),
                    F.coalesce("has_clr", F.lit(False)).alias("is_clr"), "definition"))


def views_mssql(views: DataFrame, schemas: DataFrame, modules: DataFrame, indexes: DataFrame) -> DataFrame:
    obj = ["source_id", "object_id"]
    indexed = indexes.where("index_id > 0").select(*obj).distinct().withColumn("has_index", F.lit(True))
    return (views.join(schemas.select("source_id", "schema_id", F.col("name").alias("schema_name")), ["source_id", "schema_id"])
            .join(modules.select(*obj, "definition"), obj, "left").join(indexed, obj, "left")
            .select("source_id", "schema_name", F.col("name").alias("view_name"), "definition",
                    F.coalesce("has_index", F.lit(False)).alias("is_indexed"),
                    # the source compares without case here
                    F.coalesce(F.upper("definition").contains("WITH SCHEMABINDING"), F.lit(False)).alias("with_schemabinding")))


def schemas_in_use(schemas: DataFrame, tables: DataFrame) -> DataFrame:
    """Schemas that own a table, and ``dbo`` in any case; tables are counted before the join."""
    n = tables.groupBy("source_id", "schema_id").agg(F.count("object_id").alias("table_count"))
    return (in_scope(schemas, "mssql", schema_col="name").join(n, ["source_id", "schema_id"], "left")
            .select("source_id", F.col("name").alias("schema_name"), F.coalesce("table_count", F.lit(0)).alias("table_count"))
            .where("table_count > 0 or schema_name = 'dbo'"))


def server_objects(objects: DataFrame) -> DataFrame:
    """Assemblies, and linked servers other than the server itself."""
    return objects.where("kind <> 'linked_server' or server_id > 0").select("source_id", "kind", "name")


# ---- both dialects ------------------------------------------------------------------------------------------------

def _ordered(order: str, value: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda p: p["v"])


def indexes(index_columns: DataFrame) -> DataFrame:
    """One row per index with its key columns in key order and its included columns apart."""
    key = ["source_id", "schema_name", "table_name", "index_name", "index_type", "is_unique", "is_primary_key", "filter_definition"]
    col = F.col("column_name")
    return index_columns.groupBy(*key).agg(
        _ordered("key_ordinal", F.when(~F.col("is_included"), col)).alias("columns"),
        _ordered("key_ordinal", F.when(F.col("is_included"), col)).alias("included_columns"))


def foreign_keys(fk_columns: DataFrame) -> DataFrame:
    """One row per foreign key with column pairs in key order."""
    key = ["source_id", "schema_name", "table_name", "fk_name", "ref_schema", "ref_table", "delete_action", "update_action"]
    return (fk_columns.where("ref_table is not null").groupBy(*key)
            .agg(_ordered("ordinal_position", F.struct("column_name", "ref_column")).alias("column_pairs")))


def charset_usage(columns: DataFrame) -> DataFrame:
    return (columns.where("character_set_name is not null")
            .groupBy("source_id", "character_set_name", "collation_name").agg(F.count(F.lit(1)).alias("column_count")))


def modules(modules_: DataFrame, kind: str) -> DataFrame:
    return modules_.where(F.col("kind") == kind)


def partitions(parts: DataFrame) -> DataFrame:
    return parts.where("partition_name is not null")


def jobs(jobs_: DataFrame | None, spark=None) -> DataFrame:
    """Scheduled jobs. A source that denies the read gives no rows rather than an error."""
    if jobs_ is None:
        return spark.createDataFrame([], "source_id string, job_name string, enabled boolean")
    return jobs_.select("source_id", "job_name", "enabled")


def inventory_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """Number of objects per source and kind, and number of schemas. Each frame is counted before they meet."""
    kinds = list(frames)
    counts = reduce(DataFrame.unionByName, [
        df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind)) for kind, df in frames.items()])
    wide = counts.groupBy("source_id").pivot("kind", kinds).agg(F.sum("n"))
    out = wide.select("source_id", *[F.coalesce(F.col(k), F.lit(0)).alias(f"{k}_count") for k in kinds])
    schemas = frames["table"].select("source_id", "schema_name").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("schema_count"))
    return out.join(schemas, "source_id", "left").fillna(0, ["schema_count"])


def _join_sources(sources: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One row per source from frames that are one row per source already."""
    return reduce(lambda a, b: a.join(b, "source_id", "left"), parts, sources)


def checklist_mysql(sources: DataFrame, tables: DataFrame, columns: DataFrame, index_list: DataFrame, fks: DataFrame,
                    modules_: DataFrame, jobs_: DataFrame, charsets: DataFrame, meta: DataFrame) -> DataFrame:
    """Counts and flags per source. Every count is a number and every flag is true or false, also without rows."""
    by = ["source_id"]
    base = base_tables(tables)
    size = (F.col("data_length") + F.col("index_length")) / 1048576
    t = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("table_count"), F.count_if(F.col("auto_increment") > 0).alias("auto_increment_table_count"),
        F.sum(F.round(F.col("data_length") / 1048576, 2).cast("decimal(18,2)")).cast("double").alias("total_data_mb"),
        F.max(F.round(size, 2)).alias("largest_table_mb"))
    c = columns.groupBy(*by).agg(
        F.bool_or(F.lower("data_type").isin(MYSQL_SPATIAL_TYPES)).alias("has_spatial_columns"),
        F.count_if(F.lower("data_type") == "longblob").alias("longblob_column_count"))
    i = index_list.groupBy(*by).agg(F.bool_or(F.upper("index_type") == "FULLTEXT").alias("has_fulltext_indexes"))
    k = fks.groupBy(*by).agg(F.count(F.lit(1)).alias("foreign_key_count"))
    m = modules_.groupBy(*by).agg(
        F.count_if((F.col("kind") == "routine") & (F.col("routine_type") == "PROCEDURE")).alias("stored_procedure_count"),
        F.count_if((F.col("kind") == "routine") & (F.col("routine_type") == "FUNCTION")).alias("function_count"),
        F.count_if(F.col("kind") == "trigger").alias("trigger_count"))
    e = jobs_.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"))
    u = charsets.groupBy(*by).agg(F.count_if(F.lower("collation_name").startswith("utf8mb4_0900")).alias("unsupported_collation_count"))
    s = meta.select("source_id", "binlog_format", "engine_version", "character_set_server", "lower_case_table_names")
    out = _join_sources(sources.select("source_id").distinct(), [t, c, i, k, m, e, u, s])
    flags = {x: False for x in ("has_spatial_columns", "has_fulltext_indexes")}
    numbers = {x: 0 for x in out.columns if x.endswith("_count") or x.endswith("_mb")}
    return out.fillna({**flags, **numbers})


def checklist_mssql(sources: DataFrame, tables: DataFrame, columns: DataFrame, index_list: DataFrame, fks: DataFrame,
                    modules_: DataFrame, jobs_: DataFrame, objects: DataFrame, meta: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Counts and flags per source. ``sizes`` (source_id, total_mb: a row for each table) adds total and largest size."""
    by = ["source_id"]
    dt = F.lower("data_type")
    t = tables.groupBy(*by).agg(
        F.count(F.lit(1)).alias("table_count"), F.bool_or("is_memory_optimized").alias("has_memory_optimized"),
        F.bool_or("is_temporal").alias("has_temporal_tables"), F.bool_or("is_heap").alias("has_heap_tables"))
    c = columns.groupBy(*by).agg(
        F.count_if("is_identity").alias("identity_column_count"), F.count_if("is_computed").alias("computed_column_count"),
        F.count_if("is_filestream").alias("filestream_column_count"),
        F.bool_or(dt.isin(MSSQL_SPATIAL_TYPES)).alias("has_spatial_columns"),
        F.bool_or(dt == "hierarchyid").alias("has_hierarchyid_columns"), F.bool_or(dt == "xml").alias("has_xml_columns"),
        F.bool_or(dt == "sql_variant").alias("has_sql_variant_columns"), F.bool_or(dt == "image").alias("has_image_columns"),
        F.bool_or(dt == "ntext").alias("has_ntext_columns"),
        F.count_if(F.col("collation_name") != "SQL_Latin1_General_CP1_CI_AS").alias("non_standard_collation_count"))
    i = index_list.groupBy(*by).agg(
        F.bool_or(F.col("filter_definition").isNotNull()).alias("has_filtered_indexes"),
        F.bool_or(F.upper("index_type").contains("COLUMNSTORE")).alias("has_columnstore_indexes"))
    k = fks.groupBy(*by).agg(F.count(F.lit(1)).alias("foreign_key_count"))
    m = modules_.groupBy(*by).agg(
        F.count_if((F.col("kind") == "routine") & (F.col("routine_type") == "PROCEDURE")).alias("stored_procedure_count"),
        F.count_if((F.col("kind") == "routine") & (F.col("routine_type") == "FUNCTION")).alias("function_count"),
        F.count_if((F.col("kind") == "routine") & F.col("is_clr")).alias("clr_routine_count"),
        F.count_if(F.col("kind") == "trigger").alias("trigger_count"),
        F.count_if((F.col("kind") == "trigger") & F.col("is_instead_of")).alias("instead_of_trigger_count"),
        F.count_if(F.col("kind") == "view").alias("view_count"))
    views = modules_.where("kind = 'view'").select("source_id", "schema_name", F.col("name").alias("table_name"))
    iv = index_list.join(views, ["source_id", "schema_name", "table_name"], "left_semi").groupBy(*by).agg(F.count_distinct("schema_name", "table_name").alias("indexed_view_count"))
    j = jobs_.groupBy(*by).agg(F.count(F.lit(1)).alias("agent_job_count"))
    o = objects.groupBy(*by).agg(F.count_if(F.col("kind") == "assembly").alias("assembly_count"),
                                 F.count_if(F.col("kind") == "linked_server").alias("linked_server_count"))
    s = meta.select("source_id", F.col("product_version").alias("sql_version"), "edition", F.col("cdc_enabled").alias("is_cdc_enabled"),
                    "has_ssis", (F.lower("auth_mode") == "windows").alias("windows_auth_only"))
    z = []
    if sizes is not None:
        mb = F.round("total_mb", 2)
        z = [sizes.groupBy(*by).agg(F.sum(mb.cast("decimal(18,2)")).cast("double").alias("total_data_mb"), F.max(mb).alias("largest_table_mb"))]
    out = _join_sources(sources.select("source_id").distinct(), [t, c, i, iv, k, m, j, o, s, *z])
    flags = {x: False for x in out.columns if x.startswith(("has_", "is_")) or x == "windows_auth_only"}
    return out.fillna({**flags, **{x: 0 for x in out.columns if x.endswith(("_count", "_mb"))}})
