"""Queries on observations: threat statistics, infrastructure, lead time, ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import clean_host, digits, folded, present, present_host
from wardline.functions.text import finite
from wardline.functions.times import from_micros, micros
from wardline.operators import leadtime, merging, ranking
from wardline.plans.dealt import _EPOCH, fold_sql, host_sql, missing_sql
from wardline.plans.names import NOW
from wardline.tables import table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ct_observations").where("risk_score is not null and not isnan(risk_score)")


def threat_stats(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all observations and over those above the cuts."""
    r = F.col("risk_score")
    good = r.isNotNull() & ~F.isnan(r)
    above = good & (r > 0.5)
    one = table(spark, d, "ct_observations").agg(
        F.count("*").alias("total_parsed"), F.count_if(above).alias("total"), F.count_if(good & (r > 0.9)).alias("high_risk"), F.count_if(good & (r > 0.98)).alias("critical"),
        F.round(F.avg(F.when(above, r)), 8).alias("avg_risk"), F.count_distinct(F.when(above, present(F.col("sample_country")))).alias("countries"),
    )
    return one.withColumn("signal_to_noise", F.round(F.col("critical") * 100.0 / F.greatest("total_parsed", F.lit(1)), 4))


def country_risk(spark: SparkSession, d: str) -> DataFrame:
    """Mean risk and count per country above the baseline."""
    return _scored(spark, d).where("risk_score > 0.5").withColumn("country", present(F.col("sample_country"))).where("country is not null").groupBy("country").agg(F.round(F.avg("risk_score"), 8).alias("avg_risk"), F.count("*").alias("n"))


def top_tlds(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent last labels with their mean risk."""
    rows = _scored(spark, d).where("risk_score > 0.5").withColumn("domain", present_host(F.col("registered_domain")))
    tld = F.when(F.col("domain").contains("."), F.substring_index("domain", ".", -1)).otherwise("none")
    return rows.select(tld.alias("tld"), "risk_score").groupBy("tld").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 8).alias("avg_risk")).orderBy(F.col("n").desc(), "tld").limit(10)


def isp_reputation(spark: SparkSession, d: str) -> DataFrame:
    """A10: providers with more than five observations, the ten of the highest mean risk."""
    per = _scored(spark, d).where("risk_score > 0.5").withColumn("isp", present(F.col("sample_isp"))).where("isp is not null").groupBy("isp").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 8).alias("avg_risk"))
    return per.where("n > 5").orderBy(F.col("avg_risk").desc(), "isp").limit(10)


def age_impact(spark: SparkSession, d: str) -> DataFrame:
    """Mean risk per age bin at the fixed moment; empty bins come out with 0."""
    rows = _scored(spark, d).where("risk_score > 0.5")
    age = (F.unix_micros(F.lit(NOW + "Z").cast("timestamp")) - micros(rows, "whois_created")) / F.lit(8.64e10)
    bin_ = F.when((age > -1) & (age <= 1), 0).when((age > 1) & (age <= 7), 1).when((age > 7) & (age <= 30), 2).when((age > 30) & (age <= 365), 3).when((age > 365) & (age <= 9999), 4)
    got = rows.select(bin_.alias("bin"), "risk_score").where("bin is not null").groupBy("bin").agg(F.avg("risk_score").alias("r"), F.count("*").alias("c"))
    bins = spark.createDataFrame([(0, "New"), (1, "Fresh"), (2, "Recent"), (3, "Established"), (4, "Legacy")], "bin int, label string")
    return bins.join(got, "bin", "left").select("bin", "label", F.round(F.coalesce("r", F.lit(0.0)), 8).alias("avg_risk"), F.coalesce("c", F.lit(0)).alias("n"))


def reason_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Decision reasons with their percentage."""
    per = table(spark, d, "ct_observations").where("decision_reason is not null").groupBy("decision_reason").agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def latest_threats(spark: SparkSession, d: str) -> DataFrame:
    """The fifty riskiest observations above 0.85."""
    return _scored(spark, d).where("risk_score > 0.85").orderBy(F.col("risk_score").desc(), "id").limit(50).select("id", "raw_host", "risk_score")


def distinct_threats(spark: SparkSession, d: str) -> DataFrame:
    """Of the fifty best rows the best of each domain, five at most."""
    best = _scored(spark, d).withColumn("domain", present_host(F.col("registered_domain"))).where("domain is not null").orderBy(F.col("risk_score").desc(), "id").limit(50)
    once = merging.keep_first(best, ["domain"], [F.col("risk_score").desc(), F.col("id")])
    return once.orderBy(F.col("risk_score").desc(), "id").limit(5).select("domain", "id", "risk_score")


def domain_infrastructure(spark: SparkSession, d: str) -> DataFrame:
    """Per domain distinct addresses, countries and networks, any IPv6, and a sample row's network."""
    rows = table(spark, d, "dns_geo_cache").select(present_host(F.col("puny_domain")).alias("domain"), "ip", "country", digits(F.col("asn")).alias("asn"), "isp", "fetched_at").where("domain is not null")
    order = F.struct("fetched_at", "asn", "isp", "country", "ip")
    return rows.groupBy("domain").agg(
        F.count_distinct("ip").alias("n_ips"), F.count_distinct("country").alias("n_countries"), F.count_distinct("asn").alias("n_asns"), F.max(F.coalesce(F.col("ip").contains(":"), F.lit(False)).cast("int")).alias("has_ipv6"),
        F.min_by("asn", F.when(F.col("asn").isNotNull(), order)).alias("sample_asn"),
    )


def infrastructure_edges(spark: SparkSession, d: str) -> DataFrame:
    """G1: edges from the riskiest two hundred domains to their networks and last labels."""
    top = _scored(spark, d).withColumn("domain", present_host(F.col("registered_domain"))).orderBy(F.col("risk_score").desc(), "id").limit(200).where("domain is not null and risk_score > 0.8")
    tld = F.when(F.col("domain").contains("."), F.substring_index("domain", ".", -1)).otherwise("unknown")
    asn = digits(F.col("sample_asn"))
    edges = F.array_compact(
        F.array(
            F.when(asn.isNotNull(), F.struct(F.concat(F.lit("as"), asn).alias("target"), F.col("risk_score").alias("value"))),
            F.struct(F.concat(F.lit("tld_"), tld).alias("target"), (F.col("risk_score") * 0.5).alias("value")),
        )
    )
    return top.select("domain", F.explode(edges).alias("e")).groupBy(F.col("domain").alias("source"), F.col("e.target").alias("target")).agg(F.max("e.value").alias("value"), F.count("*").alias("n"))


def infrastructure_nodes(spark: SparkSession, d: str) -> DataFrame:
    """G1: the nodes of these edges, each once."""
    edges = infrastructure_edges(spark, d)
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit("domain").alias("kind")), F.struct(F.col("target").alias("id"), F.when(F.col("target").startswith("tld_"), "tld").otherwise("asn").alias("kind")))).alias("x"))
    return ends.select("x.id", "x.kind").distinct()


def _lead(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "ct_observations")
    source, host, domain, at = present(F.col("source")), present_host(F.col("raw_host")), present_host(F.col("registered_domain")), micros(rows, "event_ts")
    ct = leadtime.first_seen(rows.where(source == "certstream"), host, domain, at, F.col("risk_score"), 0.5)
    blocked = leadtime.blocklist_first_seen(rows.where(source != "certstream"), host, domain, micros(rows, "created_at"), source)
    return ct, leadtime.lead_times(ct, blocked)


def lead_times(spark: SparkSession, d: str) -> DataFrame:
    """Matches of the stream with partner feeds and their lead in hours."""
    m = _lead(spark, d)[1]
    return m.select("raw_host", "registered_domain", from_micros(F.col("ct_first_seen")).alias("ct_first_seen"), from_micros(F.col("blocklist_first_seen")).alias("blocklist_first_seen"), "risk_score", "sources", "match_tier", F.round("lead_hours", 6).alias("lead_hours"))


def lead_time_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and lead in one row."""
    return leadtime.summary(*_lead(spark, d))


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Hits among the top rows by risk."""
    return ranking.precision_at(table(spark, d, "ct_observations"), "risk_score", F.col("ti_misp_hit") > 0, "id", (10, 50, 100, 500))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return ranking.levels(table(spark, d, "ct_observations"), F.col("risk_score"), F.coalesce(F.col("ti_misp_hit") > 0, F.lit(False)))


def ranking_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas under the ROC and the precision-recall curve."""
    return ranking.areas(_levels(spark, d))


def fpr_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Threshold and recall at one percent false positives."""
    return ranking.threshold_at_fpr(_levels(spark, d), 0.01)


def budget_recalls(spark: SparkSession, d: str) -> DataFrame:
    """The threshold for a volume of 500 rows, and the recall within that budget."""
    return ranking.budget(_levels(spark, d), 500)


def benign_fpr(spark: SparkSession, d: str) -> DataFrame:
    """Share of unflagged rows over the threshold, and score percentiles, per model."""
    rows = _scored(spark, d).where("coalesce(risk_label_final, 0) = 0")
    return rows.groupBy("model_used").agg(F.count("*").alias("n"), F.count_if(F.col("risk_score") >= 0.5).alias("n_over"), F.round(F.avg((F.col("risk_score") >= 0.5).cast("double")), 8).alias("fpr"), F.round(F.percentile("risk_score", 0.9), 8).alias("p90"))


def enrichment_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Share of observations with any registration data."""
    one = table(spark, d, "ct_observations").agg(F.count("*").alias("n_total"), F.count_if(F.col("registrar").isNotNull() | F.col("whois_created").isNotNull()).alias("n_whois"), F.count_if(F.col("enrichment_level") == "tier2").alias("n_tier2"))
    return one.withColumn("rate", F.round(F.col("n_whois") / F.nullif("n_total", F.lit(0)), 4))


def cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Hits, misses and expired entries of the registration cache for the observed domains, with the share of each."""
    domains = table(spark, d, "ct_observations").select(present_host(F.col("registered_domain")).alias("domain")).where("domain is not null").distinct()
    cache = table(spark, d, "whois_cache")
    cache = cache.where("error is null").select(present_host(F.col("domain")).alias("domain"), micros(cache, "fetched_at").alias("f"), F.col("registrar")).where("domain is not null")
    now = 1788220800000000
    joined = merging.fresh_lookup(domains, cache, "domain", F.col("f"), now, 14 * 86_400_000_000)
    per = joined.groupBy("outcome").agg(F.count_distinct("domain").alias("n_domains"), F.count("*").alias("n_rows"))
    return per.withColumn("rate", F.round(F.col("n_domains") / F.sum("n_domains").over(Window.partitionBy()), 8))  # three rows


def snapshot_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Per scored file its rows, an order-free hash of their content, its newest event with the age in hours at the fixed moment, and whether another file has the same content."""
    rows = table(spark, d, "ct_observations")
    text = F.concat_ws("|", "raw_host", "registered_domain", F.col("risk_label_final").cast("string"), "decision_reason")
    mark = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    per = rows.select("source_file", mark.alias("mark"), "event_ts", micros(rows, "event_ts").alias("at")).groupBy("source_file").agg(F.count("*").alias("n"), F.bit_xor("mark").alias("content"), F.max("event_ts").alias("newest"), F.max("at").alias("at"))
    age = F.floor((F.unix_micros(F.lit(NOW + "Z").cast("timestamp")) - F.col("at")) / F.lit(3_600_000_000))
    return per.select("source_file", "n", "content", "newest", age.alias("age_hours"), (F.count("*").over(Window.partitionBy("n", "content")) > 1).alias("repeated"))


def candidate_observations(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pass the gate (flagged, indicator hit or risky), with usable keys."""
    rows = table(spark, d, "ct_observations")
    risky = F.coalesce(~F.isnan("risk_score") & (F.col("risk_score") >= 0.7), F.lit(False))
    gate = F.coalesce(F.col("risk_label_final") == 1, F.lit(False)) | F.coalesce(F.col("ti_misp_hit") == 1, F.lit(False)) | risky
    return rows.where(gate & present_host(F.col("raw_host")).isNotNull()).select("id", clean_host(F.col("raw_host")).alias("host"), "event_ts")


def observation_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Rows stored within a day merged by (host, event) with those stored late: scores replaced (a NaN is none), registration filled."""
    rows = table(spark, d, "ct_observations")
    keyed = rows.select(clean_host(F.col("raw_host")).alias("raw_host"), "event_ts", finite(F.col("risk_score")).alias("risk_score"), "registrar", "id", (micros(rows, "created_at") - micros(rows, "event_ts") > 86_400_000_000).alias("late")).where("event_ts is not null and raw_host is not null")
    old = merging.keep_first(keyed.where("not late"), ["raw_host", "event_ts"], [F.col("id")])
    new = merging.keep_first(keyed.where("late"), ["raw_host", "event_ts"], [F.col("id").desc()])
    return merging.upsert(old, new, ["raw_host", "event_ts"], ["risk_score"], ["registrar"])


def label_union(spark: SparkSession, d: str) -> DataFrame:
    """Observed and streamed hosts as one labelled set, each host once with where it was seen."""
    obs = table(spark, d, "ct_observations").select(present_host(F.col("raw_host")).alias("host"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    log = table(spark, d, "stream_ct").select(present_host(F.col("domain")).alias("host"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return obs.unionByName(log).where("host is not null").groupBy("host").agg(F.max("a").alias("seen_in_observations"), F.max("b").alias("seen_in_stream"), F.count("*").alias("n"))


def unseen_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Streamed hosts that were never observed."""
    obs = table(spark, d, "ct_observations").select(present_host(F.col("raw_host")).alias("host"))
    return table(spark, d, "stream_ct").select(present_host(F.col("domain")).alias("host")).where("host is not null").distinct().join(obs, "host", "left_anti")


def registration_join(spark: SparkSession, d: str) -> DataFrame:
    """Per domain its newest event, newest registrar and number of addresses."""
    obs = table(spark, d, "ct_observations").select(present_host(F.col("registered_domain")).alias("domain"), "event_ts").where("domain is not null").groupBy("domain").agg(F.max("event_ts").alias("newest"))
    whois = table(spark, d, "whois_cache").where("error is null").select(present_host(F.col("domain")).alias("domain"), folded(F.col("registrar")).alias("registrar"), "fetched_at")
    newest = whois.groupBy("domain").agg(F.max(F.struct("fetched_at", "registrar")).alias("w")).select("domain", "w.registrar")
    geo = table(spark, d, "dns_geo_cache").select(present_host(F.col("puny_domain")).alias("domain"), "ip").groupBy("domain").agg(F.count_distinct("ip").alias("n_ips"))
    return obs.join(newest, "domain", "left").join(geo, "domain", "left").select("domain", "newest", "registrar", F.coalesce("n_ips", F.lit(0)).alias("n_ips"))


def source_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Rows per source of the label union, its share, and whether a source that is asked for is missing; raises without any row."""
    return merging.lineage(table(spark, d, "ct_observations").select(present(F.col("source")).alias("source")), "source", ["certstream", "openphish"])


QUERIES = {
    f.__name__: f
    for f in (
        threat_stats, country_risk, top_tlds, isp_reputation, age_impact, reason_breakdown, latest_threats, distinct_threats, domain_infrastructure, infrastructure_edges, infrastructure_nodes, lead_times,
        lead_time_summary, precision_at_k, ranking_areas, fpr_threshold, budget_recalls, benign_fpr, enrichment_completeness, cache_outcomes, snapshot_fingerprints, candidate_observations, observation_upsert,
        label_union, unseen_hosts, registration_join, source_lineage,
    )
}


def present_sql(c: str) -> str:
    """The folded text or null, in DuckDB's SQL."""
    return f"case when not {missing_sql(c)} then {fold_sql(c)} end"


def present_host_sql(c: str) -> str:
    """The cleaned host or null, in DuckDB's SQL."""
    return f"case when not {missing_sql(c)} then nullif({host_sql(c)}, '') end"


_SCORED = "(select * from ct_observations where risk_score is not null and not isnan(risk_score))"
_TLD = "case when contains(domain, '.') then regexp_extract(domain, '[^.]*$') else '{0}' end"
_EDGES = f"""with top as (select * from (select *, {present_host_sql("registered_domain")} as domain from {_SCORED} order by risk_score desc, id limit 200) where domain is not null and risk_score > 0.8),
e as (select domain as source, 'as' || regexp_replace(sample_asn, '[^0-9]', '', 'g') as target, risk_score as value from top where regexp_matches(sample_asn, '[0-9]')
      union all select domain, 'tld_' || {_TLD.format("unknown")}, risk_score * 0.5 from top),
edges as (select source, target, max(value) as value, count(*) as n from e group by 1, 2)"""
_LEAD = f"""with o as (select {present_sql("source")} as s, {present_host_sql("raw_host")} as raw_host, {present_host_sql("registered_domain")} as d, epoch_us(event_ts) as t, risk_score as r, epoch_us(created_at) as c from ct_observations),
ct as (select raw_host, min(d) as registered_domain, min(t) as a, max(r) as risk_score from o where s = 'certstream' and raw_host is not null and r >= 0.5 and not isnan(r) group by 1 having min(t) is not null),
bl as (select raw_host, min(d) as registered_domain, min(c) as b, string_agg(distinct s, ',' order by s) as sources from o where s <> 'certstream' and raw_host is not null and d is not null group by 1),
ca as (select registered_domain, min(a) as a, max(risk_score) as risk_score from ct where raw_host not in (select raw_host from bl) and registered_domain is not null group by 1),
ba as (select registered_domain, min(b) as b, string_agg(distinct x, ',' order by x) as sources from (select registered_domain, b, unnest(string_split(sources, ',')) as x from bl where raw_host not in (select raw_host from ct)) group by 1),
m as (select ct.raw_host, ct.registered_domain, a, b, risk_score, sources, 'exact_hostname' as match_tier from ct join bl using (raw_host)
      union all select ca.registered_domain, ca.registered_domain, a, b, risk_score, sources, 'registered_domain' from ca join ba using (registered_domain))"""
_LEVELS = """with l0 as (select risk_score as score, count(*) as n, count(*) filter (where ti_misp_hit > 0) as p from ct_observations where risk_score is not null and not isnan(risk_score) group by 1),
l as (select *, sum(n) over w as above, sum(p) over w as above_pos, sum(n) over () as total, sum(p) over () as pos from l0 window w as (order by score desc rows unbounded preceding))"""

ORACLES = {
    "threat_stats": f"""select total_parsed, total, high_risk, critical, avg_risk, countries, round(critical * 100.0 / greatest(total_parsed, 1), 4)::double as signal_to_noise from (
      select count(*) as total_parsed, count(*) filter (where g and risk_score > 0.5) as total, count(*) filter (where g and risk_score > 0.9) as high_risk, count(*) filter (where g and risk_score > 0.98) as critical,
        round(avg(risk_score) filter (where g and risk_score > 0.5), 8) as avg_risk, count(distinct case when g and risk_score > 0.5 then {present_sql("sample_country")} end) as countries
      from (select *, risk_score is not null and not isnan(risk_score) as g from ct_observations))""",
    "country_risk": f"select {present_sql('sample_country')} as country, round(avg(risk_score), 8) as avg_risk, count(*) as n from {_SCORED} where risk_score > 0.5 and not {missing_sql('sample_country')} group by 1",
    "top_tlds": f"""select {_TLD.format("none")} as tld, count(*) as n, round(avg(risk_score), 8) as avg_risk from (select *, {present_host_sql("registered_domain")} as domain from {_SCORED}) where risk_score > 0.5
      group by 1 order by n desc, tld limit 10""",
    "isp_reputation": f"""select {present_sql("sample_isp")} as isp, count(*) as n, round(avg(risk_score), 8) as avg_risk from {_SCORED} where risk_score > 0.5 and not {missing_sql("sample_isp")}
      group by 1 having count(*) > 5 order by avg_risk desc, isp limit 10""",
    "age_impact": f"""select bin, label, round(coalesce(avg(risk_score), 0), 8) as avg_risk, count(risk_score) as n
      from (values (0, 'New'), (1, 'Fresh'), (2, 'Recent'), (3, 'Established'), (4, 'Legacy')) b(bin, label)
      left join (select risk_score, case when age > -1 and age <= 1 then 0 when age > 1 and age <= 7 then 1 when age > 7 and age <= 30 then 2 when age > 30 and age <= 365 then 3 when age > 365 and age <= 9999 then 4 end as k
        from (select risk_score, (epoch_us(timestamp '{NOW}') - epoch_us(whois_created))::double / 8.64e10::double as age from {_SCORED} where risk_score > 0.5)) on k = bin group by 1, 2""",
    "reason_breakdown": "select decision_reason, n, round(n * 100.0 / sum(n) over (), 2)::double as pct from (select decision_reason, count(*) as n from ct_observations where decision_reason is not null group by 1)",
    "latest_threats": f"select id, raw_host, risk_score from {_SCORED} where risk_score > 0.85 order by risk_score desc, id limit 50",
    "distinct_threats": f"""select domain, id, risk_score from (select *, row_number() over (partition by domain order by risk_score desc, id) as k from (
      select {present_host_sql("registered_domain")} as domain, id, risk_score from {_SCORED} where {present_host_sql("registered_domain")} is not null order by risk_score desc, id limit 50)) where k = 1
      order by risk_score desc, id limit 5""",
    "domain_infrastructure": f"""select {present_host_sql("puny_domain")} as domain, count(distinct ip) as n_ips, count(distinct country) as n_countries, count(distinct a) as n_asns, max(coalesce(contains(ip, ':'), false)::integer) as has_ipv6,
      first(a order by fetched_at, a, isp nulls first, country nulls first, ip nulls first) filter (where a is not null) as sample_asn
      from (select *, nullif(regexp_replace(asn, '[^0-9]', '', 'g'), '') as a from dns_geo_cache) where {present_host_sql("puny_domain")} is not null group by 1""",
    "infrastructure_edges": f"{_EDGES} select source, target, value, n from edges",
    "infrastructure_nodes": f"{_EDGES} select source as id, 'domain' as kind from edges union select target, case when starts_with(target, 'tld_') then 'tld' else 'asn' end from edges",
    "lead_times": f"""{_LEAD} select raw_host, registered_domain, {_EPOCH} + to_microseconds(a) as ct_first_seen, {_EPOCH} + to_microseconds(b) as blocklist_first_seen, risk_score, sources, match_tier, round((b - a)::double / 3.6e9::double, 6) as lead_hours from m""",
    "lead_time_summary": f"""{_LEAD}, h as (select *, (b - a)::double / 3.6e9::double as lead from m),
      s as (select (select count(*) from ct) as n_hosts, count(*) as n_matched, count(*) filter (where match_tier = 'exact_hostname') as n_exact, count(*) filter (where match_tier <> 'exact_hostname') as n_apex_only, count(*) filter (where lead > 0) as n_ahead,
        count(*) filter (where lead > 0 and match_tier = 'exact_hostname') as n_ahead_exact, count(*) filter (where lead <= 0) as n_blocklist_first, round(quantile_cont(lead, 0.5) filter (where lead > 0), 4) as median_hours_ahead, round(quantile_cont(lead, 0.9) filter (where lead > 0), 4) as p90_hours_ahead from h)
      select *, n_hosts - n_matched as n_ct_only, round(100.0 * n_matched / nullif(n_hosts, 0), 2)::double as coverage_pct, round(100.0 * n_ahead / nullif(n_matched, 0), 2)::double as ahead_pct,
        case when n_matched = 0 then 'no matches' when n_exact = 0 then 'no exact matches' when n_exact < 30 then 'low' when n_exact < 200 then 'moderate' else 'reasonable' end as confidence from s""",
    "precision_at_k": f"""select k, count(*) as n_evaluated, count(*) filter (where ti_misp_hit > 0) as n_hits, count(*) filter (where ti_misp_hit > 0) / count(*) as precision
      from (values (10), (50), (100), (500)) t(k) join (select ti_misp_hit, row_number() over (order by risk_score desc, id) as r from {_SCORED}) on r <= k group by k""",
    "ranking_areas": f"""{_LEVELS} select max(pos)::bigint as n_pos, (max(total) - max(pos))::bigint as n_neg,
      round(sum(p * ((total - pos) - (above - above_pos)) + p * (n - p) / 2)::double / (max(pos) * (max(total) - max(pos)))::double, 8) as roc_auc, round(sum(p * above_pos::double / above) / max(pos), 8) as average_precision from l""",
    "fpr_threshold": f"{_LEVELS} select min(score) as threshold, round(max(above_pos::double / pos), 8) as recall from l where (above - above_pos)::double / (total - pos) <= 0.01",
    "budget_recalls": f"{_LEVELS} select min(score) filter (where above <= 500) as threshold, round(sum(p * greatest(0.0, least(1.0, (500.0 - (above - n))::double / n))) / max(pos), 8) as recall from l",
    "benign_fpr": f"""select model_used, count(*) as n, count(*) filter (where risk_score >= 0.5) as n_over, round(avg((risk_score >= 0.5)::integer), 8) as fpr, round(quantile_cont(risk_score, 0.9), 8) as p90
      from {_SCORED} where coalesce(risk_label_final, 0) = 0 group by 1""",
    "enrichment_completeness": """select count(*) as n_total, count(*) filter (where registrar is not null or whois_created is not null) as n_whois, count(*) filter (where enrichment_level = 'tier2') as n_tier2,
      round(count(*) filter (where registrar is not null or whois_created is not null) / count(*), 4) as rate from ct_observations""",
    "cache_outcomes": f"""with dom as (select distinct {present_host_sql("registered_domain")} as domain from ct_observations where {present_host_sql("registered_domain")} is not null),
      c as (select {present_host_sql("domain")} as domain, epoch_us(fetched_at) > 1788220800000000 - 14 * 86400000000 as fresh from whois_cache where error is null)
      select *, round(n_domains / sum(n_domains) over ()::double, 8) as rate from (select case when f.domain is not null then 'hit' when s.domain is not null then 'expired' else 'miss' end as outcome, count(distinct dom.domain) as n_domains, count(*) as n_rows
      from dom left join (select * from c where fresh) f on f.domain = dom.domain left join (select distinct domain from c) s on s.domain = dom.domain group by 1)""",
    "snapshot_fingerprints": f"""select source_file, n, content, newest, floor((epoch_us(timestamp '{NOW}') - epoch_us(newest)) / 3600000000)::bigint as age_hours, count(*) over (partition by n, content) > 1 as repeated from (
      select source_file, count(*) as n, bit_xor(('0x' || left(md5(concat_ws('|', raw_host, registered_domain, risk_label_final::varchar, decision_reason)), 15))::bigint) as content, max(event_ts) as newest from ct_observations group by 1)""",
    "candidate_observations": f"""select id, {host_sql("raw_host")} as host, event_ts from ct_observations where {present_host_sql("raw_host")} is not null
      and (coalesce(risk_label_final = 1, false) or coalesce(ti_misp_hit = 1, false) or coalesce(not isnan(risk_score) and risk_score >= 0.7, false))""",
    "observation_upsert": f"""with k as (select {host_sql("raw_host")} as raw_host, event_ts, case when not isnan(risk_score) and not isinf(risk_score) then risk_score end as risk_score, registrar, id, epoch_us(created_at) - epoch_us(event_ts) > 86400000000 as late from ct_observations where event_ts is not null),
      o as (select * from k where not late qualify row_number() over (partition by raw_host, event_ts order by id) = 1), n as (select * from k where late qualify row_number() over (partition by raw_host, event_ts order by id desc) = 1)
      select coalesce(n.raw_host, o.raw_host) as raw_host, coalesce(n.event_ts, o.event_ts) as event_ts, case when n.id is not null then n.risk_score else o.risk_score end as risk_score, coalesce(n.registrar, o.registrar) as registrar
      from o full join n on o.raw_host = n.raw_host and o.event_ts = n.event_ts""",
    "label_union": f"""select host, max(a) as seen_in_observations, max(b) as seen_in_stream, count(*) as n from (select {present_host_sql("raw_host")} as host, 1 as a, 0 as b from ct_observations
      union all select {present_host_sql("domain")}, 0, 1 from stream_ct) where host is not null group by 1""",
    "unseen_hosts": f"select distinct {present_host_sql('domain')} as host from stream_ct where {present_host_sql('domain')} is not null and {present_host_sql('domain')} not in (select {present_host_sql('raw_host')} from ct_observations where {present_host_sql('raw_host')} is not null)",
    "registration_join": f"""select o.domain, newest, registrar, coalesce(n_ips, 0) as n_ips from (select {present_host_sql("registered_domain")} as domain, max(event_ts) as newest from ct_observations where {present_host_sql("registered_domain")} is not null group by 1) o
      left join (select {present_host_sql("domain")} as domain, {fold_sql("registrar")} as registrar from whois_cache where error is null qualify row_number() over (partition by {present_host_sql("domain")} order by fetched_at desc, {fold_sql("registrar")} desc nulls last) = 1) w on w.domain = o.domain
      left join (select {present_host_sql("puny_domain")} as domain, count(distinct ip) as n_ips from dns_geo_cache group by 1) g on g.domain = o.domain""",
    "source_lineage": f"""select source, coalesce(n, 0) as n, round(coalesce(n, 0) / (select count(*) from ct_observations)::double, 8) as share, n is null as missing
      from (select {present_sql('source')} as source, count(*) as n from ct_observations group by 1) full join (values ('certstream'), ('openphish')) e(source) using (source)""",
}
