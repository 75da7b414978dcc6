"""Queries of the batch pipeline: candidates, enrichment, rescoring, audits; a router for analysts' questions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import present, present_host
from wardline.operators import campaigns, features, merging
from wardline.plans.analytics import present_host_sql, present_sql
from wardline.plans.campaigns import _BRANDS, _MEMBERS, OWN, WATCHED, _members, _observed
from wardline.plans.names import CRC_TABLE, crc_sql
from wardline.sources.feeds import read_since
from wardline.tables import table

HOT_ROWS = 600
TIER2_CUT = 2.0


def hot_path(spark: SparkSession, d: str) -> DataFrame:
    """O1: the six hundred messages to enrich first, by triage score, a missing one counting as 1."""
    rows = table(spark, d, "stream_ct").select("kafka_offset", present_host(F.col("domain")).alias("host"), F.coalesce("triage_score", F.lit(1.0)).alias("score")).where("host is not null")
    return rows.orderBy(F.col("score").desc(), "host", "kafka_offset").limit(HOT_ROWS)


def newest_domains(spark: SparkSession, d: str, since: str | None = None) -> DataFrame:
    """O2: of the rows stored since the bookmark, without one of all rows, the earliest of each domain.

    The reference stops at its newest 20,000 rows (CAP_ROWS) and moves its bookmark
    past the others; here no row is cut off.
    """
    fresh = read_since(table(spark, d, "ct_observations"), "created_at", since)
    rows = fresh.select("id", present_host(F.col("registered_domain")).alias("domain"), "created_at").where("domain is not null")
    return merging.keep_first(rows, ["domain"], [F.col("created_at"), F.col("id")])


def tier2_gate(spark: SparkSession, d: str) -> DataFrame:
    """sources by how many rows call for a live lookup; a missing score does."""
    high = F.coalesce(F.col("triage_score").try_cast("double") > TIER2_CUT, F.lit(True))
    return table(spark, d, "ct_observations").groupBy(present(F.col("source")).alias("source")).agg(F.count_if(high).alias("n_high"), F.count("*").alias("n"))


def clean_positives(spark: SparkSession, d: str) -> DataFrame:
    """labelled hosts that hold a letter and aren't addresses."""
    rows = table(spark, d, "ct_observations").where("risk_label_final = 1").select(present_host(F.col("raw_host")).alias("host")).where("host is not null").distinct()
    return rows.where(F.col("host").rlike("[a-z]") & ~F.col("host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))


def geo_fill(spark: SparkSession, d: str) -> DataFrame:
    """M6: lookups without country filled from the newest other lookup of their address that has one; the rest is left out."""
    rows = table(spark, d, "dns_geo_cache").select("puny_domain", "ip", "country", "country_code", "fetched_at").where("ip is not null")
    known = rows.where("country is not null and country_code is not null").groupBy("ip").agg(F.max(F.struct("fetched_at", "country", "country_code")).alias("k"))
    lacking = rows.where("country is null or country_code is null").join(known, "ip")
    return lacking.select("puny_domain", "ip", "fetched_at", F.coalesce("country", "k.country").alias("country"), F.coalesce("country_code", "k.country_code").alias("country_code"))


def rescore_audit(spark: SparkSession, d: str) -> DataFrame:
    """What a new score (risk halved without indicator) would change, per stored reason."""
    rows = table(spark, d, "ct_observations").where("risk_score is not null and not isnan(risk_score)")
    new = F.when(F.col("ti_misp_hit") == 1, F.col("risk_score")).otherwise(F.col("risk_score") * 0.5)
    delta = F.abs(new - F.col("risk_score"))
    label, _ = features.fused(new, F.col("ti_misp_hit") == 1, 0.9)
    return rows.groupBy("decision_reason").agg(
        F.count("*").alias("n"), F.round(F.avg(delta), 8).alias("mean_delta"), F.round(F.max(delta), 8).alias("most_delta"), F.count_if(delta > 0.1).alias("n_changed"), F.sum(label).alias("n_positive")
    )


def brand_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per campaign of a watched brand the members that do and don't imitate it."""
    o = _observed(spark, d)
    brand = campaigns.attribute(o, "host", campaigns.alias_table(spark, WATCHED, OWN))
    named = o.select(F.col("id").alias("observation_id"), "host").join(brand, "host", "left")
    watched = [b for b, _, _ in WATCHED]
    c = table(spark, d, "campaign_clusters").select(F.col("id").alias("cluster_id"), present(F.col("target_brand")).alias("target_brand")).where(F.col("target_brand").isin(watched))
    same = F.coalesce(F.col("brand") == F.col("target_brand"), F.lit(False))
    per = _members(spark, d).join(c, "cluster_id").join(named, "observation_id").groupBy("cluster_id", "target_brand").agg(F.count_if(same).alias("n_good"), F.count_if(~same).alias("n_bad"))
    return per.withColumn("action", F.when(F.col("n_good") == 0, "delete").when(F.col("n_bad") > 0, "prune").otherwise("keep"))


def weighted_background(spark: SparkSession, d: str, rate: float = 0.1) -> DataFrame:
    """U4: forwarded hosts at weight 1 and a CRC-32 sample of the others at the inverse of its rate; the total estimates all hosts."""
    rows = table(spark, d, "stream_ct").select(present_host(F.col("domain")).alias("host"), (F.coalesce("triage_score", F.lit(0.0)) >= 1.0).alias("forwarded")).where("host is not null").groupBy("host").agg(F.max("forwarded").alias("forwarded"))
    sampled = F.crc32(F.col("host").cast("binary")) % 10000 < int(rate * 10000)
    return rows.where(F.col("forwarded") | sampled).withColumn("weight", F.when(F.col("forwarded"), 1.0).otherwise(1.0 / rate))


def rank_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per domain its newest observation and the one before it."""
    rows = table(spark, d, "ct_observations").select("id", present_host(F.col("registered_domain")).alias("domain"), "event_ts").where("domain is not null and event_ts is not null")
    w = Window.partitionBy("domain").orderBy(F.col("event_ts").desc(), F.col("id").desc())
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 2").select("domain", "id", "event_ts", "place")


def ask(spark: SparkSession, d: str, question: str) -> DataFrame | None:
    """One of three fixed questions, recognised by pattern, answered with bound parameters; none if it isn't one of them.

    Questions are cut at 500 characters. Known are: why is a domain risky, which
    campaigns target a brand, what are the riskiest domains.
    """
    q = question[:500].strip().lower()
    if m := re.search(r"\bwhy\b.*?([a-z0-9-]+(?:\.[a-z0-9-]+)+)", q):
        host: Column = F.lit(m[1])
        rows = table(spark, d, "ct_observations").where(present_host(F.col("registered_domain")) == host)
        return rows.orderBy(F.col("event_ts").desc_nulls_last(), F.col("id").desc()).limit(1).select("raw_host", "risk_score", "decision_reason", "model_used")
    if m := re.search(r"\bcampaigns?\b.*\b(?:for|against|targeting)\s+([a-z0-9-]+)", q):
        rows = table(spark, d, "campaign_clusters").where(present(F.col("target_brand")) == F.lit(m[1]))
        return rows.orderBy(F.col("confidence_score").desc(), "id").limit(10).select("id", "confidence_score", "observation_count")
    if re.search(r"\b(top|riskiest|worst)\b.*\b(domains?|threats?)\b", q):
        best = table(spark, d, "ct_observations").where("risk_score is not null and not isnan(risk_score)").orderBy(F.col("risk_score").desc(), "id").limit(50)
        return merging.keep_first(best, ["registered_domain"], [F.col("risk_score").desc(), F.col("id")]).orderBy(F.col("risk_score").desc(), "id").limit(5).select("registered_domain", "risk_score")
    return None


QUERIES = {
    f.__name__: f
    for f in (hot_path, newest_domains, tier2_gate, clean_positives, geo_fill, rescore_audit, brand_audit, weighted_background, rank_changes)
}

ORACLES = {
    "hot_path": f"select kafka_offset, {present_host_sql('domain')} as host, coalesce(triage_score, 1.0) as score from stream_ct where {present_host_sql('domain')} is not null order by score desc, host, kafka_offset limit {HOT_ROWS}",
    "newest_domains": f"""select id, domain, created_at from (select * from (select id, {present_host_sql("registered_domain")} as domain, created_at from ct_observations) where domain is not null)
      qualify row_number() over (partition by domain order by created_at, id) = 1""",
    "tier2_gate": f"select {present_sql('source')} as source, count(*) filter (where coalesce(try_cast(triage_score as double) > {TIER2_CUT}, true)) as n_high, count(*) as n from ct_observations group by 1",
    "clean_positives": f"""select distinct {present_host_sql("raw_host")} as host from ct_observations where risk_label_final = 1 and regexp_matches({present_host_sql("raw_host")}, '[a-z]')
      and not regexp_full_match({present_host_sql("raw_host")}, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}')""",
    "geo_fill": """with k as (select ip, country, country_code from dns_geo_cache where country is not null and country_code is not null
        qualify row_number() over (partition by ip order by fetched_at desc, country desc, country_code desc) = 1)
      select puny_domain, g.ip, fetched_at, coalesce(g.country, k.country) as country, coalesce(g.country_code, k.country_code) as country_code
      from dns_geo_cache g join k on k.ip = g.ip where g.country is null or g.country_code is null""",
    "rescore_audit": """select decision_reason, count(*) as n, round(avg(abs(s - risk_score)), 8) as mean_delta, round(max(abs(s - risk_score)), 8) as most_delta, count(*) filter (where abs(s - risk_score) > 0.1) as n_changed,
      sum((s >= 0.9 or coalesce(ti_misp_hit = 1, false))::integer)::bigint as n_positive
      from (select *, case when ti_misp_hit = 1 then risk_score else risk_score * 0.5 end as s from ct_observations where risk_score is not null and not isnan(risk_score)) group by 1""",
    "brand_audit": f"""{_BRANDS}, {_MEMBERS}, x as (select m.cluster_id, {present_sql("c.target_brand")} as target_brand, coalesce(named.brand = {present_sql("c.target_brand")}, false) as same
        from m join campaign_clusters c on c.id = m.cluster_id join ct_observations o on o.id = m.observation_id left join named on named.host = {present_host_sql("o.raw_host")}
        where {present_sql("c.target_brand")} in ({", ".join(f"'{b}'" for b, _, _ in WATCHED)}))
      select cluster_id, target_brand, count(*) filter (where same) as n_good, count(*) filter (where not same) as n_bad,
        case when count(*) filter (where same) = 0 then 'delete' when count(*) filter (where not same) > 0 then 'prune' else 'keep' end as action from x group by 1, 2""",
    "weighted_background": f"""with {CRC_TABLE}, f as (select {present_host_sql("domain")} as host, max(coalesce(triage_score, 0.0) >= 1.0) as forwarded from stream_ct where {present_host_sql("domain")} is not null group by 1)
      select host, forwarded, case when forwarded then 1.0::double else 10.0::double end as weight from f, crc_table where forwarded or {crc_sql("host")} % 10000 < 1000""",
    "rank_changes": f"""select domain, id, event_ts, place from (select {present_host_sql("registered_domain")} as domain, id, event_ts, (row_number() over (partition by {present_host_sql("registered_domain")} order by event_ts desc, id desc))::integer as place
      from ct_observations where event_ts is not null and {present_host_sql("registered_domain")} is not null) where place <= 2""",
}
