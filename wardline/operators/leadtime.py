"""Lead time of the certificate stream over block lists, and indicator matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, host: Column, domain: Column, at: Column, risk: Column, least_risk: float) -> DataFrame:
    """Per host: smallest registered domain, first time (microseconds), highest risk; hosts without any time drop out."""
    good = rows.select(host.alias("raw_host"), domain.alias("d"), at.alias("t"), risk.alias("r")).where(F.col("raw_host").isNotNull() & (F.col("r") >= least_risk) & ~F.isnan("r"))
    return good.groupBy("raw_host").agg(F.min("d").alias("registered_domain"), F.min("t").alias("ct_first_seen"), F.max("r").alias("risk_score")).where("ct_first_seen is not null")


def blocklist_first_seen(rows: DataFrame, host: Column, domain: Column, at: Column, source: Column) -> DataFrame:
    """Per host: registered domain, first report (microseconds), and the sorted distinct sources as a list in text."""
    good = rows.select(host.alias("raw_host"), domain.alias("d"), at.alias("t"), source.alias("s")).where("raw_host is not null and d is not null and t is not null and s is not null")
    return good.groupBy("raw_host").agg(F.min("d").alias("registered_domain"), F.min("t").alias("blocklist_first_seen"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))


def lead_times(ct: DataFrame, blocked: DataFrame) -> DataFrame:
    """Matches by exact host, then, among the hosts left on both sides, by registered domain.

    ``lead_hours`` is positive where the stream came first. The sources of an apex
    are the union of its hosts' sources.
    """
    exact = ct.join(blocked.drop("registered_domain"), "raw_host").withColumn("match_tier", F.lit("exact_hostname"))
    ct_left = ct.join(blocked.select("raw_host"), "raw_host", "left_anti").groupBy("registered_domain").agg(F.min("ct_first_seen").alias("ct_first_seen"), F.max("risk_score").alias("risk_score"))
    each = blocked.join(ct.select("raw_host"), "raw_host", "left_anti").select("registered_domain", "blocklist_first_seen", F.explode(F.split("sources", ",")).alias("s"))
    bl_left = each.groupBy("registered_domain").agg(F.min("blocklist_first_seen").alias("blocklist_first_seen"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    apex = ct_left.join(bl_left, "registered_domain").withColumns({"raw_host": F.col("registered_domain"), "match_tier": F.lit("registered_domain")})
    columns = ["raw_host", "registered_domain", "ct_first_seen", "blocklist_first_seen", "risk_score", "sources", "match_tier"]
    joined = exact.select(columns).unionByName(apex.select(columns))
    return joined.withColumn("lead_hours", (F.col("blocklist_first_seen") - F.col("ct_first_seen")) / F.lit(3.6e9))


def summary(ct: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: counts by tier, coverage, how often and how far the stream was ahead, and a note on sample size.

    Shares and percentiles without anything to stand on are null. Hosts and matches
    are counted in one aggregate.
    """
    rows = ct.select(F.lit(1).alias("host"), F.lit(None).cast("string").alias("match_tier"), F.lit(None).cast("double").alias("lead_hours")).unionByName(matched.select(F.lit(0).alias("host"), "match_tier", "lead_hours"))
    ahead, exact, is_match = F.col("lead_hours") > 0, F.col("match_tier") == "exact_hostname", F.col("host") == 0
    one = rows.agg(
        F.coalesce(F.sum("host"), F.lit(0)).cast("long").alias("n_hosts"),
        F.count_if(is_match).alias("n_matched"),
        F.count_if(is_match & exact).alias("n_exact"),
        F.count_if(is_match & ~exact).alias("n_apex_only"),
        F.count_if(ahead).alias("n_ahead"),
        F.count_if(ahead & exact).alias("n_ahead_exact"),
        F.count_if(F.col("lead_hours") <= 0).alias("n_blocklist_first"),
        F.percentile(F.when(ahead, F.col("lead_hours")), 0.5).alias("median_hours_ahead"),
        F.percentile(F.when(ahead, F.col("lead_hours")), 0.9).alias("p90_hours_ahead"),
    )
    note = F.when(F.col("n_matched") == 0, "no matches").when(F.col("n_exact") == 0, "no exact matches").when(F.col("n_exact") < 30, "low").when(F.col("n_exact") < 200, "moderate").otherwise("reasonable")
    return one.select(
        "n_hosts", "n_matched", "n_exact", "n_apex_only", "n_ahead", "n_ahead_exact", "n_blocklist_first", (F.col("n_hosts") - F.col("n_matched")).alias("n_ct_only"),
        F.round(100.0 * F.col("n_matched") / F.nullif("n_hosts", F.lit(0)), 2).alias("coverage_pct"), F.round(100.0 * F.col("n_ahead") / F.nullif("n_matched", F.lit(0)), 2).alias("ahead_pct"),
        F.round("median_hours_ahead", 4).alias("median_hours_ahead"), F.round("p90_hours_ahead", 4).alias("p90_hours_ahead"), note.alias("confidence"),
    )
