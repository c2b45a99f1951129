"""Target tier, cost and load strategy per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossover.functions import constants as k
from crossover.functions.text import rows_of


def metric_hourly(metrics: DataFrame, days: int | None = None) -> DataFrame:
    """Hourly average and maximum per source and metric, over the last ``days`` of each source if given."""
    if days is not None:
        last = metrics.groupBy("source_id").agg(F.max("ts").alias("_last"))
        metrics = metrics.join(last, "source_id").where(F.col("ts") > F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last")
    return (metrics.groupBy("source_id", "metric", F.window("ts", "1 hour").alias("w"))
            .agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
            .select("source_id", "metric", F.col("w.start").alias("hour"), "avg_value", "max_value"))


def metric_stats(hourly: DataFrame) -> DataFrame:
    """Mean of the hourly averages and highest of the hourly maxima."""
    return hourly.groupBy("source_id", "metric").agg(F.avg("avg_value").alias("average"), F.max("max_value").alias("maximum"))


def source_cost(stats: DataFrame) -> DataFrame:
    """Monthly cost of a source from its metrics: the average counts, the maximum stands in where there is none."""
    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.coalesce("average", "maximum")))

    v = stats.groupBy("source_id").agg(
        value("ServerlessDatabaseCapacity").alias("acu"), value("VolumeBytesUsed").alias("bytes"),
        value("VolumeReadIOPs").alias("reads"), value("VolumeWriteIOPs").alias("writes"))
    zero = F.lit(0.0)
    compute = F.coalesce(F.col("acu") * k.SOURCE_COMPUTE_HOURLY * k.HOURS_PER_MONTH, zero)
    storage = F.coalesce(F.col("bytes"), zero) / 1073741824 * k.SOURCE_STORAGE_GB_MONTH
    io = (F.coalesce(F.col("reads"), zero) + F.coalesce(F.col("writes"), zero)) * (3600 * k.HOURS_PER_MONTH) / 1000000 * k.SOURCE_IO_MILLION
    return v.select("source_id", F.round(compute, 2).alias("compute_cost"), F.round(storage, 2).alias("storage_cost"), F.round(io, 2).alias("io_cost"),
                    F.round(compute + storage + io, 2).alias("source_monthly"), F.col("acu").isNull().alias("compute_unknown"))


def recommend(totals: DataFrame) -> DataFrame:
    """Target size band and its monthly cost."""
    gb = F.col("total_data_mb") / 1024

    def pick(i: int) -> Column:
        out = F.when(gb <= k.TARGET_BANDS[0][0], F.lit(k.TARGET_BANDS[0][i]))
        for band in k.TARGET_BANDS[1:-1]:
            out = out.when(gb <= band[0], F.lit(band[i]))
        return out.otherwise(F.lit(k.TARGET_BANDS[-1][i]))

    sized = totals.select("source_id", pick(1).alias("tier"), pick(2).alias("nodes"), pick(3).alias("vcpu"), pick(4).alias("ram_gb"),
                          F.greatest(F.floor(gb * 2), pick(5).cast("long")).alias("storage_gb"))
    cost = F.col("nodes") * F.col("vcpu") * k.TARGET_VCPU_HOURLY * k.HOURS_PER_MONTH + F.col("storage_gb") * k.TARGET_STORAGE_GB_MONTH
    return sized.withColumn("target_monthly", F.round(cost, 2))


def cost_compare(source: DataFrame, target: DataFrame) -> DataFrame:
    s, t = F.col("source_monthly"), F.col("target_monthly")
    return source.join(target, "source_id").select("source_id", s, t, "tier", F.when(s > 0, F.bround((s - t) / s * 100, 1)).otherwise(0.0).alias("savings_pct"))


def licence_cost(meta: DataFrame, totals: DataFrame, tier: str = "starter") -> DataFrame:
    """Licence cost of a source by edition and cores, and the cost of the target tier."""
    facts = meta.join(totals.select("source_id", "total_data_mb"), "source_id", "left").fillna(0.0, ["total_data_mb"])
    edition = F.lower(F.coalesce("edition", F.lit("")))
    cores = F.greatest(F.coalesce("cpu_count", F.lit(4)), F.lit(4))
    price = F.when(edition.contains("enterprise"), k.LICENCE_CORE_MONTHLY["enterprise"]).otherwise(k.LICENCE_CORE_MONTHLY["standard"])
    gib = F.col("total_data_mb") / 1024
    over = gib > k.STARTER_FREE_GIB
    if tier == "starter":
        target = F.when(over, (gib - k.STARTER_FREE_GIB) * k.STARTER_GIB_MONTH).otherwise(0.0)
    elif tier == "essential":
        target = F.greatest(gib * k.STARTER_GIB_MONTH, F.lit(k.ESSENTIAL_LEAST_MONTHLY))
    else:
        target = F.lit(k.DEDICATED_MONTHLY)
    better = F.when(over, "essential").otherwise(tier) if tier == "starter" else F.lit(tier)
    basis = F.when(edition.contains("enterprise"), "enterprise").when(edition.contains("standard"), "standard").otherwise("unknown")
    return facts.select("source_id", basis.alias("licence_basis"), cores.alias("billable_cores"), F.round(cores * price, 2).alias("licence_monthly"),
                        F.round(target, 2).alias("target_monthly"), better.alias("recommended_tier"))


def tier_fit(totals: DataFrame, meta: DataFrame) -> DataFrame:
    """Three rows per source: does the tier fit, and what speaks against it."""
    facts = meta.select("source_id", "cdc_enabled").join(totals.select("source_id", "total_data_mb", "largest_table_rows"), "source_id", "left")
    facts = facts.fillna({"total_data_mb": 0.0, "largest_table_rows": 0})
    gib = F.col("total_data_mb") / 1024
    none = F.array().cast("array<string>")

    def present(*texts: Column) -> Column:
        return F.array_compact(F.array(*texts))

    blockers = present(F.when(gib > 25, F.format_string("%.1f GiB exceed the 25 GiB limit", gib)))
    warnings = present(F.when((gib > 20) & (gib <= 25), F.format_string("%.1f GiB are close to the 25 GiB limit", gib)),
                       F.when(F.col("cdc_enabled"), F.lit("no change feed: cutover with downtime")),
                       F.when(F.col("largest_table_rows") > 10_000_000, F.lit("tables above 10M rows import slowly")))
    big = present(F.when(gib > 500, F.format_string("%.1f GiB: dedicated may import faster", gib)))

    def row(tier: str, b: Column, w: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), (F.size(b) == 0).alias("fits"), b.alias("blockers"), w.alias("warnings"))

    return facts.select("source_id", F.inline(F.array(row("starter", blockers, warnings), row("essential", none, big), row("dedicated", none, none))))


def strategy(totals: DataFrame, target: str = "cloud") -> DataFrame:
    """How to load by size: 100 GB and 1 TB part the ways."""
    gb = F.col("total_data_mb") / 1024
    name = F.when(gb < 100, "direct").when(gb < 1024, "dms").otherwise("cloud_import" if target == "cloud" else "physical_import")
    reason = F.when(gb < 100, "< 100 GB").when(gb < 1024, "100 GB - 1 TB").otherwise(">= 1 TB")
    return totals.select("source_id", name.alias("strategy"), reason.alias("reason"))


# What each tier can run, and what it takes by itself.
NOT_ON_TIER = {"starter": ["dms", "physical_import"], "essential": ["physical_import"], "dedicated": []}


def strategy_tier(plans: DataFrame) -> DataFrame:
    """Load strategy for rows (source_id, total_data_mb, tier, choice).

    ``choice`` is ``auto`` or a strategy. One the tier lacks gives no strategy and a reason, so that one source does not
    stop the others.
    """
    tier, choice, mb = F.col("tier"), F.lower("choice"), F.col("total_data_mb")
    by_size = F.when(mb.isNull() | (mb < 50 * 1024), "direct")
    auto = (F.when(tier == "starter", "cli_import").when(tier == "essential", by_size.otherwise("dms"))
            .otherwise(by_size.when(mb <= 500 * 1024, "dms").otherwise("physical_import")))
    refused = F.lit(False)
    for name, absent in NOT_ON_TIER.items():
        if absent:
            refused = refused | ((tier == name) & choice.isin(absent))
    return plans.select("*", F.when(refused, F.lit(None).cast("string")).when(choice == "auto", auto).otherwise(choice).alias("strategy"),
                        F.when(refused, F.format_string("%s is not available on %s", choice, tier)).alias("reason"))


def _decide(kind: str, topic: str, when: Column | None = None) -> Column:
    row = F.struct(F.lit(kind).alias("decision"), F.lit(topic).alias("topic"))
    return row if when is None else F.when(when, row)


def decisions_mysql(checklist: DataFrame, rating: DataFrame, issue_totals: DataFrame, target: str = "cloud") -> DataFrame:
    """What to warn of, ask or recommend for each source."""
    facts = (checklist.join(rating.select("source_id", "overall_score"), "source_id", "left")
             .join(issue_totals.select("source_id", "blocker_count"), "source_id", "left"))
    c, large = F.col, F.col("total_data_mb") > 1048576
    blocked = c("blocker_count") > 0
    return rows_of(
        facts, ["source_id"],
        _decide("warn", "difficult_migration", c("overall_score") < 25), _decide("warn", "resolve_blockers", blocked), _decide("ask", "handle_blockers", blocked),
        _decide("ask", "generate_code", c("stored_procedure_count") > 0),
        _decide("recommend", "cloud_import" if target == "cloud" else "physical_import", large),
        _decide("warn", "binlog_format", c("binlog_format") != "ROW"), _decide("recommend", "free_tier"))


def decisions_mssql(checklist: DataFrame, totals: DataFrame, rating: DataFrame, issue_totals: DataFrame, tier: str = "starter") -> DataFrame:
    facts = (checklist.join(totals.select("source_id", "total_data_mb"), "source_id", "left").join(rating.select("source_id", "overall_score"), "source_id", "left")
             .join(issue_totals.select("source_id", "blocker_count"), "source_id", "left"))
    c, mb = F.col, F.col("total_data_mb")
    rows = [
        _decide("warn", "difficult_migration", c("overall_score") < 25), _decide("ask", "handle_blockers", c("blocker_count") > 0),
        _decide("ask", "generate_code", c("stored_procedure_count") > 0), _decide("ask", "trigger_language", c("trigger_count") > 0),
        _decide("warn", "clr_rewrite", c("assembly_count") > 0), _decide("warn", "ssis_redesign", c("has_ssis"))]
    if tier == "starter":
        rows += [_decide("recommend", "larger_tier", mb > 25600), _decide("warn", "cutover_downtime"), _decide("warn", "transaction_timeout")]
    elif tier == "essential":
        rows.append(_decide("recommend", "dedicated_tier", mb > 512000))
    else:
        rows.append(_decide("recommend", "physical_import", mb > 512000))
    if tier != "starter":
        rows.append(_decide("warn", "enable_cdc", ~c("is_cdc_enabled")))
    return rows_of(facts, ["source_id"], *rows)
