"""Source against target: existence, counts, structure, keyed row diff, checksums and samples.

The row diff needs no join. Both sides are cut down to key, 64-bit row hash and two counters, put together and counted
per (key, hash). Equal rows meet in one group and drop out; only the rest is grouped again by key. Partial aggregation
runs before both shuffles, so a key that holds a third of all rows costs no more than any other, and repeated keys
are counted instead of multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossover.functions.comparing import comparable
from crossover.functions.hashing import checksum_aggregates, row_digest, row_hash
from crossover.functions.text import rows_of

SUMMARY_SCHEMA = ("table_name string, source_rows bigint, target_rows bigint, rows_matching bigint, rows_missing bigint, rows_mismatched bigint, "
                  "rows_extraneous bigint, status string")
MISSING, EXTRANEOUS, MISMATCHED = "missing", "extraneous", "mismatched"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ---- structure ----------------------------------------------------------------------------------------------------

def compare_tables(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Tables on one side only."""
    sides = _union([source.select(*on, F.lit(1).alias("s"), F.lit(0).alias("t")),
                    target.select(*on, F.lit(0).alias("s"), F.lit(1).alias("t"))])
    found = sides.groupBy(*on).agg(F.max("s").alias("s"), F.max("t").alias("t")).where("s <> t")
    return found.select(
        *on, F.when(F.col("s") == 1, F.lit("missing_on_target")).otherwise(F.lit("extra_on_target")).alias("issue")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count per table."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
                   for name, df in tables.items()])


def compare_counts(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Row counts side by side. A table that is absent on one side has a NULL count there, not 0."""
    s = source.select(*on, F.col("row_count").alias("source_count"))
    t = target.select(*on, F.col("row_count").alias("target_count"))
    delta = F.col("target_count") - F.col("source_count")
    return s.join(t, on, "full_outer").select(
        *on, "source_count", "target_count", delta.alias("delta"),
        F.try_divide(delta * 100.0, F.col("source_count")).alias("delta_pct"),
        F.coalesce(delta == 0, F.lit(False)).alias("matches"),
    )


def count_bands(counts: DataFrame) -> DataFrame:
    """What a count difference calls for: up to 1 percent passes, up to 5 reload the table, beyond that look deeper."""
    s, t = F.col("source_count"), F.col("target_count")
    share = F.abs(t - s) / s
    band = (
        F.when(s.isNull(), "absent_on_source").when(t.isNull(), "absent_on_target")
        .when(s == t, "count_verified").when(s == 0, "investigate_load")
        .when(share <= 0.01, "within_tolerance").when(share <= 0.05, "reload_table").otherwise("investigate_load")
    )
    return counts.withColumn("band", band)


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column catalog of frames, taken from their schemas; a default is what the schema keeps as the column's current default."""
    rows = [(name, f.name, i + 1, f.dataType.simpleString(), f.nullable, f.metadata.get("CURRENT_DEFAULT"))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean, column_default string"
    )


def compare_columns(
    source: DataFrame, target: DataFrame, on: list[str], conditional: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Columns that differ, in both directions: missing, extra, other type, and with ``strict`` order, nullability and default.

    ``conditional(source_type, target_type)`` lists type pairs whose data is still comparable. Columns of tables that
    exist on one side only are left to :func:`compare_tables`.
    """
    keep = [c for c in ("data_type", "ordinal_position", "is_nullable", "column_default") if c in source.columns and c in target.columns]
    both = source.select(*on).distinct().join(target.select(*on).distinct(), on, "left_semi")
    key = [*on, "column_name"]
    s = source.select(*key, F.struct(*keep).alias("s"))
    t = target.select(*key, F.struct(*keep).alias("t"))
    pairs = s.join(t, key, "full_outer").join(both, on, "left_semi")
    s_type, t_type = F.lower(F.col("s.data_type")), F.lower(F.col("t.data_type"))
    if conditional is not None:
        allowed = conditional.select(
            F.lower("source_type").alias("source_type"), F.lower("target_type").alias("target_type"),
            F.lit(True).alias("allowed"),
        ).distinct()
        pairs = pairs.join(allowed, (s_type == F.col("source_type")) & (t_type == F.col("target_type")), "left")
    else:
        pairs = pairs.withColumn("allowed", F.lit(False))
    present_both = F.col("s").isNotNull() & F.col("t").isNotNull()
    checks = [
        F.when(F.col("t").isNull(), F.lit("missing_column")),
        F.when(F.col("s").isNull(), F.lit("extra_column")),
        F.when(present_both & (s_type != t_type),
               F.when(F.coalesce(F.col("allowed"), F.lit(False)), "conditional_match").otherwise("column_type")),
    ]
    if strict:
        for field, label in (("ordinal_position", "column_order"), ("is_nullable", "nullability"), ("column_default", "column_default")):
            if field in keep:
                checks.append(F.when(present_both & ~F.col(f"s.{field}").eqNullSafe(F.col(f"t.{field}")), F.lit(label)))
    keep = [*key, F.col("s.data_type").alias("source_type"), F.col("t.data_type").alias("target_type")]
    return rows_of(pairs, keep, *[F.when(c.isNotNull(), F.struct(c.alias("issue"))) for c in checks])


# ---- keyed row diff -----------------------------------------------------------------------------------------------

def _sides(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None, trim: bool, digest: bool = False) -> DataFrame:
    source, target, cols = comparable(source, target, keys, columns, trim)

    def cut(df: DataFrame, s: int, t: int) -> DataFrame:
        return df.select(*keys, (row_digest if digest else row_hash)(df, cols, trim=False).alias("_hash"),
                         F.lit(s).cast("long").alias("_s"), F.lit(t).cast("long").alias("_t"))

    return cut(source, 1, 0).unionByName(cut(target, 0, 1))


def _coded(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None, trim: bool) -> tuple[DataFrame, DataFrame, list[str], list[str], dict[str, str]]:
    """Both sides in one form under plain column names (c0, c1, ...), so that no name of the caller's clashes with one of the comparison or
    needs quoting; the names of keys and columns, and what each stands for."""
    source, target, cols = comparable(source, target, keys, columns, trim)
    code = {n: f"c{i}" for i, n in enumerate(source.columns)}
    s, t = (df.toDF(*code.values()) for df in (source, target))
    return s, t, [code[k] for k in keys], [code[c] for c in cols], {c: n for n, c in code.items()}


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _row_groups(source, target, keys, columns, trim, digest: bool = False) -> DataFrame:
    return (_sides(source, target, keys, columns, trim, digest).groupBy(*keys, "_hash")
            .agg(F.sum("_s").alias("_s"), F.sum("_t").alias("_t")))


def _key_classes(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, how many rows are left over on each side once equal rows are taken out in pairs."""
    left = (groups.where(F.col("_s") != F.col("_t")).groupBy(*keys)
            .agg(F.sum(F.greatest(F.col("_s") - F.col("_t"), F.lit(0))).alias("_s"),
                 F.sum(F.greatest(F.col("_t") - F.col("_s"), F.lit(0))).alias("_t")))
    both = F.least("_s", "_t")
    return left.select(*keys, (F.col("_s") - both).alias("rows_missing"), (F.col("_t") - both).alias("rows_extraneous"),
                       both.alias("rows_mismatched"))


def diff_rows(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, trim: bool = True, digest: bool = False
) -> DataFrame:
    """Every key with a difference: status and number of rows. A unique key has one status and one row.

    ``digest`` compares SHA-256 digests of rows in place of 64-bit hashes: four times the shuffle, for proof rather than for finding errors.
    """
    source, target, keys, columns, names = _coded(source, target, keys, columns, trim)
    classes = _key_classes(_row_groups(source, target, keys, columns, False, digest), keys)

    def case(status: str) -> Column:
        n = F.col(f"rows_{status}")
        return F.when(n > 0, F.struct(F.lit(status).alias("status"), n.alias("row_count")))

    return _named(rows_of(classes, keys, case(MISSING), case(EXTRANEOUS), case(MISMATCHED)), names)


def diff_summary(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, trim: bool = True,
    table: str = "",
) -> DataFrame:
    """One row: rows on each side and rows per class. Both branches read the same shuffle output."""
    source, target, keys, columns, _ = _coded(source, target, keys, columns, trim)
    groups = _row_groups(source, target, keys, columns, False)
    names = ["source_rows", "target_rows", "rows_matching", "rows_missing", "rows_mismatched", "rows_extraneous"]

    def zero(*filled: str) -> list[Column]:
        return [F.lit(0).cast("long").alias(n) for n in names if n not in filled]

    totals = groups.agg(F.sum("_s").alias("source_rows"), F.sum("_t").alias("target_rows"),
                        F.sum(F.least("_s", "_t")).alias("rows_matching"))
    totals = totals.select("*", *zero("source_rows", "target_rows", "rows_matching")).select(*names)
    classes = _key_classes(groups, keys).agg(
        *[F.sum(n).alias(n) for n in ("rows_missing", "rows_mismatched", "rows_extraneous")])
    classes = classes.select("*", *zero("rows_missing", "rows_mismatched", "rows_extraneous")).select(*names)
    both = totals.unionByName(classes).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    wrong = F.col("rows_missing") + F.col("rows_mismatched") + F.col("rows_extraneous")
    return both.select(F.lit(table).alias("table_name"), *names,
                       F.when(wrong == 0, "verified").otherwise("issues_found").alias("status"))


CELL_BUCKETS = 1 << 16


def diff_cells(
    source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, trim: bool = True
) -> DataFrame:
    """The columns that differ, for every key that has exactly one leftover row on each side.

    Only keys with a mismatch are joined back, out of the buckets of keys that hold one: the list of these is at most
    ``CELL_BUCKETS`` integers, so rows of other buckets are left out before any shuffle. Keys with several leftover rows have
    no pairing of rows; they are in :func:`diff_rows` with their counts and in :func:`diff_multiset` with their rows.
    """
    source, target, keys, cols, names = _coded(source, target, keys, columns, trim)
    cols = [c for c in cols if c not in keys]
    left = (_row_groups(source, target, keys, [*keys, *cols], False).where(F.col("_s") != F.col("_t")))
    single = (left.groupBy(*keys)
              .agg(F.sum(F.greatest(F.col("_s") - F.col("_t"), F.lit(0))).alias("_s"),
                   F.sum(F.greatest(F.col("_t") - F.col("_s"), F.lit(0))).alias("_t"),
                   F.max(F.when(F.col("_s") > F.col("_t"), F.col("_hash"))).alias("_source_hash"),
                   F.max(F.when(F.col("_t") > F.col("_s"), F.col("_hash"))).alias("_target_hash"))
              .where("_s = 1 and _t = 1"))
    hit = F.broadcast(single.select(bucket(single, keys, CELL_BUCKETS).alias("_bucket")).distinct())

    def rows(df: DataFrame, side: str) -> DataFrame:
        """The one leftover row per key; equal copies of it count once."""
        wanted = single.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(f"_{side}_hash").alias("_wanted"))
        on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_hash") == F.col("_wanted")]
        hashed = df.select(*keys, *cols, row_hash(df, [*keys, *cols], trim=False).alias("_hash"), bucket(df, keys, CELL_BUCKETS).alias("_bucket"))
        found = hashed.join(hit, "_bucket", "left_semi").drop("_bucket").join(wanted, reduce(lambda a, b: a & b, on), "left_semi")
        return found.groupBy(*keys).agg(F.first(F.struct(*cols)).alias(side))

    s, t = rows(source, "source"), rows(target, "target")
    t = t.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "target")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    cells = [
        F.when(~F.col(f"source.{c}").eqNullSafe(F.col(f"target.{c}")),
               F.struct(F.lit(names[c]).alias("column_name"), F.col(f"source.{c}").cast("string").alias("source_value"),
                        F.col(f"target.{c}").cast("string").alias("target_value")))
        for c in cols
    ]
    return _named(rows_of(s.join(t, on), keys, *cells), names)


def diff_multiset(source: DataFrame, target: DataFrame, columns: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Rows whose number of copies differs, for tables without a key: the row, the status and how many.

    Two 64-bit hashes stand for the row in the first shuffle. Whole rows move only out of the buckets of hashes that do not
    balance, a list of at most ``CELL_BUCKETS`` integers.
    """
    source, target, _, cols, names = _coded(source, target, (), columns, trim)

    def cut(df: DataFrame, weight: int) -> DataFrame:
        return df.select(row_hash(df, cols, trim=False).alias("_h1"), row_hash(df, cols, trim=False, salt=1).alias("_h2"),
                         F.lit(weight).cast("long").alias("_w"))

    uneven = (cut(source, 1).unionByName(cut(target, -1)).groupBy("_h1", "_h2").agg(F.sum("_w").alias("_w"))
              .where("_w <> 0").select("_h1", "_h2"))
    of = F.pmod("_h1", F.lit(CELL_BUCKETS)).cast("int").alias("_bucket")
    hit = F.broadcast(uneven.select(of).distinct())

    def whole(df: DataFrame, weight: int) -> DataFrame:
        hashed = df.select(*cols, row_hash(df, cols, trim=False).alias("_h1"), row_hash(df, cols, trim=False, salt=1).alias("_h2"), F.lit(weight).cast("long").alias("_w"))
        return hashed.withColumn("_bucket", of).join(hit, "_bucket", "left_semi").drop("_bucket").join(uneven, ["_h1", "_h2"], "left_semi")

    rows = whole(source, 1).unionByName(whole(target, -1)).groupBy(*cols).agg(F.sum("_w").alias("_w")).where("_w <> 0")
    return _named(rows.select(*cols, F.when(F.col("_w") > 0, MISSING).otherwise(EXTRANEOUS).alias("status"), F.abs("_w").alias("copies")), names)


# ---- checksums ----------------------------------------------------------------------------------------------------

def table_checksum(df: DataFrame, columns: list[str] | None = None, trim: bool = True, table: str = "") -> DataFrame:
    """One row per table; equal content gives equal values in whatever order the rows come."""
    return df.agg(*checksum_aggregates(row_hash(df, columns, trim))).select(F.lit(table).alias("table_name"), "*")


def key_checksum(df: DataFrame, keys: list[str], table: str = "") -> DataFrame:
    """Checksum over the key columns alone: shows lost or added rows without reading the rest."""
    return table_checksum(df, keys, table=table)


def checksum_pair(source: DataFrame, target: DataFrame, columns: list[str] | None = None, trim: bool = True, table: str = "") -> DataFrame:
    """Both sides' checksum over one form of their columns, whatever their types: one row."""
    source, target, cols = comparable(source, target, (), columns, trim)
    s, t = (table_checksum(df, cols, False).select(F.struct("row_count", "hash_xor", "hash_sum").alias(n)) for df, n in ((source, "s"), (target, "t")))
    both = s.unionByName(t, allowMissingColumns=True).agg(F.first("s", ignorenulls=True).alias("s"), F.first("t", ignorenulls=True).alias("t"))
    return both.select(F.lit(table).alias("table_name"), F.col("s.row_count").alias("source_count"), F.col("t.row_count").alias("target_count"),
                       F.col("s").eqNullSafe(F.col("t")).alias("matches"))


def compare_checksums(source: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Tables on both sides whose checksums differ."""
    s = source.select(*on, F.struct("row_count", "hash_xor", "hash_sum").alias("s"))
    t = target.select(*on, F.struct("row_count", "hash_xor", "hash_sum").alias("t"))
    return (s.join(t, on).where(~F.col("s").eqNullSafe(F.col("t")))
            .select(*on, F.lit("checksum").alias("issue"), F.col("s.row_count").alias("source_count"),
                    F.col("t.row_count").alias("target_count")))


def bucket(df: DataFrame, keys: list[str], buckets: int) -> Column:
    return F.pmod(row_hash(df, keys), F.lit(buckets)).cast("int")


def bucket_checksums(df: DataFrame, keys: list[str], buckets: int, columns: list[str] | None = None,
                     trim: bool = True) -> DataFrame:
    return df.groupBy(bucket(df, keys, buckets).alias("bucket")).agg(*checksum_aggregates(row_hash(df, columns, trim)))


def bad_buckets(source: DataFrame, target: DataFrame, keys: list[str], buckets: int,
                columns: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Buckets of keys whose checksums differ; at most ``buckets`` rows."""
    source, target, cols = comparable(source, target, keys, columns, trim)
    s = bucket_checksums(source, keys, buckets, cols, False).select("bucket", F.struct("row_count", "hash_xor", "hash_sum").alias("s"))
    t = bucket_checksums(target, keys, buckets, cols, False).select("bucket", F.struct("row_count", "hash_xor", "hash_sum").alias("t"))
    return s.join(t, "bucket", "full_outer").where(~F.col("s").eqNullSafe(F.col("t"))).select("bucket")


def diff_shards(source: DataFrame, target: DataFrame, keys: list[str], buckets: int = 1024,
                columns: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Keyed diff that shuffles only the rows of buckets whose checksums differ.

    When almost everything matches, the first pass moves a few numbers per bucket and the second reads both sides once
    more but shuffles little. With damage in most buckets it is the slower way; :func:`diff_rows` then reads once.
    """
    source, target, keys, columns, names = _coded(source, target, keys, columns, trim)
    bad = bad_buckets(source, target, keys, buckets, columns, False).withColumnRenamed("bucket", "_bucket")
    s = source.withColumn("_bucket", bucket(source, keys, buckets)).join(bad, "_bucket", "left_semi").drop("_bucket")
    t = target.withColumn("_bucket", bucket(target, keys, buckets)).join(bad, "_bucket", "left_semi").drop("_bucket")
    return _named(diff_rows(s, t, keys, columns, False), names)


# ---- samples and summaries ----------------------------------------------------------------------------------------

def sample_keys(df: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """A share of the rows chosen by key hash, so that both sides keep the same keys."""
    return df.where(F.pmod(row_hash(df, keys), F.lit(1_000_000)) < int(rate * 1_000_000))


def mismatch_sample(diff: DataFrame, keys: list[str], n: int = 10, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` keys per status (and per ``by`` column). The row limit per group is applied before the shuffle."""
    w = Window.partitionBy(*(by or []), "status").orderBy(*[F.col(f"`{k}`") for k in keys])
    return diff.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def check_summary(summaries: DataFrame) -> DataFrame:
    """Totals of a run over the per-table summaries."""
    good = F.col("status") == "verified"
    return summaries.agg(
        F.count(F.lit(1)).alias("tables_checked"), F.count_if(good).alias("tables_matching"),
        F.count_if(~good).alias("tables_with_issues"),
        F.sum("source_rows").alias("total_rows_checked"), F.sum("rows_matching").alias("total_rows_matching"),
        F.sum("rows_missing").alias("total_rows_missing"), F.sum("rows_mismatched").alias("total_rows_mismatched"),
        F.sum("rows_extraneous").alias("total_rows_extraneous"), F.coalesce(F.bool_and(good), F.lit(True)).alias("passed"),
    )


# ---- keys ---------------------------------------------------------------------------------------------------------

def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, and keys with a NULL part."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    kind = F.when(has_null, "null_key").when(F.col("row_count") > 1, "duplicate_key")
    return counted.withColumn("violation", kind).where("violation is not null")


def fk_orphans(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Foreign keys of ``child`` without a parent row, with the number of rows. Keys with a NULL part are no orphans.

    The child is counted per key before the join, so a hot key is one row by then.
    """
    cols = [c for c, _ in pairs]
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    counted = child.where(filled).groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in pairs])
    return counted.join(parents, cols, "left_anti")
