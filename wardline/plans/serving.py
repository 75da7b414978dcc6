"""Queries on labels, indicators, the work queue, reviews and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions import labels as L
from wardline.functions.hosts import present, present_host
from wardline.functions.text import country_code, finite, indicator_host
from wardline.functions.times import from_micros, micros
from wardline.operators import campaigns, features, merging, ranking, reviews, suffixes
from wardline.plans.analytics import _LEAD, _lead, present_host_sql, present_sql
from wardline.plans.campaigns import _BRANDS, NOW_US, OWN, WATCHED, _observed
from wardline.plans.dealt import _EPOCH
from wardline.plans.names import TABLE_SUFFIXES
from wardline.tables import table

#: The registrations, observations and queue items of this day (21 August 2026) are those of the run.
RUN_AT = 1787270400000000
RISKY = [*L.RISKY_TLDS, "zz", "xq"]


def threat_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and level of every observation by score and watched brand."""
    o = _observed(spark, d)
    brand = campaigns.attribute(o, "host", campaigns.alias_table(spark, WATCHED, OWN))
    s, hit = finite(F.col("risk_score")), F.col("brand").isNotNull()
    return o.join(brand, "host", "left").select("id", L.verdict(s, hit).alias("verdict"), L.level(s, hit).alias("level"))


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """The rule-based score of every registered domain."""
    rows = table(spark, d, "ct_observations").select(present_host(F.col("registered_domain")).alias("domain")).where("domain is not null").distinct()
    return rows.select("domain", F.round(L.baseline_score(F.col("domain"), RISKY), 6).alias("score"))


def tld_buckets(spark: SparkSession, d: str) -> DataFrame:
    """P25: observed domains by how reliably their registry answers; the tables' own labels stand for the reliable ones."""
    rows = table(spark, d, "ct_observations").select(present_host(F.col("registered_domain")).alias("domain")).distinct()
    return rows.groupBy(L.tld_bucket(F.col("domain"), ["qx", "test"]).alias("bucket")).agg(F.count("*").alias("n"))


def preferred_hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host of the domain column, else of the URL."""
    text = L.preferred(F.col("registered_domain"), F.concat(F.lit("https://"), F.btrim("raw_host"), F.lit("/x?y")))
    return table(spark, d, "ct_observations").select("id", text.alias("chosen"), indicator_host(text).alias("host"))


def country_codes(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by country code, or by a name that is as short as one."""
    return table(spark, d, "dns_geo_cache").groupBy(country_code(F.col("country_code"), F.col("country")).alias("country")).agg(F.count("*").alias("n"))


def campaign_cards(spark: SparkSession, d: str) -> DataFrame:
    """Per campaign how long ago it was last seen, in words, and what its confidence is made of."""
    c = table(spark, d, "campaign_clusters")
    minutes = (F.lit(NOW_US) - micros(c, "last_seen")) / F.lit(60_000_000)
    risk, corroboration, full = L.confidence_parts(F.col("confidence_score"), F.col("observation_count"))
    return c.select("id", L.freshness(minutes).alias("seen"), F.round(risk, 8).alias("max_risk"), F.round(corroboration, 8).alias("corroboration"), full.alias("at_limit"))


def binary_labels(spark: SparkSession, d: str) -> DataFrame:
    """SC16: rows per binary label, the general stream standing for the benign source."""
    rows = table(spark, d, "ct_observations").select(present(F.col("source")).alias("source"))
    return rows.groupBy(L.label_of(F.col("source"), "certstream").alias("label")).agg(F.count("*").alias("n"))


def _indicators(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "ct_observations")
    listed = rows.where(present(F.col("source")) != "certstream").select(indicator_host(F.col("registered_domain")).alias("indicator")).where("indicator is not null").distinct()
    return listed, spark.createDataFrame([(s,) for s in TABLE_SUFFIXES], "rule string")


def indicator_hits(spark: SparkSession, d: str) -> DataFrame:
    """Observed hosts that a partner feed's domain names, or that lie below one; public suffixes end the walk."""
    hosts = table(spark, d, "ct_observations").select(indicator_host(F.col("raw_host")).alias("host"))
    return suffixes.ancestor_hits(hosts, "host", *_indicators(spark, d))


def indicator_precision(spark: SparkSession, d: str) -> DataFrame:
    """SC15, A23: precision of the riskiest observations against the indicators as they are now."""
    hits = indicator_hits(spark, d).select("host", F.lit(True).alias("hit"))
    rows = table(spark, d, "ct_observations").select("id", finite(F.col("risk_score")).alias("risk"), indicator_host(F.col("raw_host")).alias("host")).join(hits, "host", "left")
    return ranking.precision_at(rows, "risk", F.coalesce("hit", F.lit(False)), "id", (10, 100, 1000))


def touched_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns with a member among the (host, event) pairs of a run's enriched rows."""
    rows = table(spark, d, "ct_observations")
    enriched = rows.where(F.col("enrichment_level").isin("tier1", "tier2"))
    run = enriched.where(micros(rows, "created_at") >= RUN_AT)
    members = table(spark, d, "cluster_members").select("cluster_id", F.col("observation_id").alias("id"))
    return merging.touched_parents(enriched.select("id", "raw_host", "event_ts"), run, ["raw_host", "event_ts"], members, "id", "cluster_id")


def daily_registrations(spark: SparkSession, d: str) -> DataFrame:
    """The registration lookups of the domains that a run observed, each row once."""
    rows = table(spark, d, "ct_observations")
    run = rows.where(micros(rows, "created_at") >= RUN_AT).select(present_host(F.col("registered_domain")).alias("domain"))
    cache = table(spark, d, "whois_cache").select(present_host(F.col("domain")).alias("domain"), "registrar", "fetched_at")
    return merging.of_keys(cache, run, ["domain"])


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """A work queue of the observed domains: what the table says of a domain's newest row decides where the item stands."""
    rows = table(spark, d, "ct_observations")
    o = rows.select(present_host(F.col("registered_domain")).alias("domain"), "id", micros(rows, "created_at").alias("t"), "num_unique_ips", "enrichment_level").where("domain is not null")
    per = o.groupBy("domain").agg(F.min("t").alias("enqueued"), F.max_by(F.struct("enrichment_level", "num_unique_ips"), "id").alias("x"))
    status = F.when(F.col("x.enrichment_level") == "tier0", "pending").when(F.col("x.enrichment_level") == "tier1", "processing").otherwise("done")
    return per.select("domain", "enqueued", status.alias("status"), F.pmod(F.coalesce("x.num_unique_ips", F.lit(0)), F.lit(3)).alias("attempts"))


def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    """Items per status, the oldest of each and how long it waits."""
    per = merging.queue_depth(_queue(spark, d), "status", "enqueued", NOW_US)
    return per.select("status", "n", from_micros(F.col("oldest")).alias("oldest"), F.round("lag_seconds", 3).alias("lag_seconds"))


def queue_run(spark: SparkSession, d: str) -> DataFrame:
    """A crash is recovered, the fifty oldest items are claimed, those with an address lookup are completed, the rest fails once more; the queue and its ledger."""
    looked = table(spark, d, "dns_geo_cache").where("asn is not null").select(present_host(F.col("puny_domain")).alias("domain"))
    claimed = merging.claim_oldest(merging.recover_stale(_queue(spark, d), "status"), "status", "enqueued", "domain", 50)
    kept, ledger = merging.failed_ledger(merging.requeue_failed(merging.complete(claimed, looked, "status", "domain"), "status", "attempts"), "status")
    return kept.select("domain", "status", "attempts", F.lit(False).alias("in_ledger")).unionByName(ledger.select("domain", "status", "attempts", F.lit(True).alias("in_ledger")))


def newly_queued(spark: SparkSession, d: str) -> DataFrame:
    """Streamed domains that aren't in flight already."""
    streamed = table(spark, d, "stream_ct").select(present_host(F.col("domain")).alias("domain")).where("domain is not null").distinct()
    return merging.not_in_flight(streamed, _queue(spark, d), "domain", "status")


def _dispositions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_events")
    verdict = F.when(F.col("event_type") == "disposition_recorded", "confirmed").otherwise("suppressed")
    return e.where(F.col("event_type").isin("disposition_recorded", "suppression_match")).select("id", "cluster_id", micros(e, "created_at").alias("created_at"), verdict.alias("verdict"))


def confirmation(spark: SparkSession, d: str) -> DataFrame:
    """The share of reviewed campaigns whose newest entry confirms; recorded dispositions stand for confirmations, suppressions for the rest."""
    return reviews.confirmation_rate(_dispositions(spark, d))


def review_delay(spark: SparkSession, d: str) -> DataFrame:
    """The median hours from a campaign to its first disposition."""
    c = table(spark, d, "campaign_clusters")
    return reviews.median_hours_to_review(c.select("id", micros(c, "created_at").alias("created_at")), _dispositions(spark, d))


def suppression(spark: SparkSession, d: str) -> DataFrame:
    """The share of campaigns that are suppressed."""
    return reviews.suppression_rate(table(spark, d, "campaign_clusters"))


def campaign_rate(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns a day over the last seven days before the fixed moment."""
    c = table(spark, d, "campaign_clusters")
    return reviews.per_day(c.select(micros(c, "created_at").alias("created_at")), NOW_US)


def analyst_directory(spark: SparkSession, d: str) -> DataFrame:
    """Active analysts by name, with their place."""
    rows = table(spark, d, "analysts").where("active").select("username", "display_name")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("username")))  # a directory of people


def brand_watchlist(spark: SparkSession, d: str) -> DataFrame:
    """Watched brands by priority, then name, with their campaigns."""
    brands = spark.createDataFrame([(b, p) for b, _, p in WATCHED], "brand string, priority int")
    n = table(spark, d, "campaign_clusters").groupBy(present(F.col("target_brand")).alias("brand")).agg(F.count("*").alias("n"))
    return brands.join(n, "brand", "left").select("brand", "priority", F.coalesce("n", F.lit(0)).alias("n"), F.row_number().over(Window.orderBy(F.col("priority").desc(), "brand")).alias("place"))  # configured brands


def risk_report(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen riskiest observations."""
    rows = table(spark, d, "ct_observations").select("id", "raw_host", finite(F.col("risk_score")).alias("risk_score"), "decision_reason").where("risk_score is not null")
    return rows.orderBy(F.col("risk_score").desc(), "id").limit(15)


def lead_report(spark: SparkSession, d: str) -> DataFrame:
    """The ten earliest catches before a block list."""
    rows = _lead(spark, d)[1]
    return rows.orderBy(F.col("lead_hours").desc(), "raw_host", "match_tier").limit(10).select("raw_host", "match_tier", "sources", F.round("lead_hours", 6).alias("lead_hours"))


def address_countries(spark: SparkSession, d: str) -> DataFrame:
    """Each domain and address with what is known of the address from any lookup, addresses without a country too."""
    rows = table(spark, d, "dns_geo_cache").select(present_host(F.col("puny_domain")).alias("domain"), "ip", "country", "fetched_at").where("domain is not null")
    known = rows.where("ip is not null and country is not null").groupBy("ip").agg(F.max_by("country", F.struct("fetched_at", "country")).alias("country"))
    return rows.select("domain", "ip").distinct().join(known, "ip", "left").select("domain", "ip", "country")


def feature_numbers(spark: SparkSession, d: str) -> DataFrame:
    """SC1-SC3: what a host's vector is made of: numbers of grams and category tokens, statistics, infrastructure, registration."""
    rows = features.prepared(_featured(spark, d), F.col("host"), CATEGORIES)
    return rows.select("id", F.size("grams").cast("long").alias("n_grams"), F.array_join("tokens", ",").alias("tokens"), "digits", "hyphens", "num_unique_ips", "num_asns", "age_days", "days_to_expiry", "created_isnull", "expires_isnull")


CATEGORIES = {"asn": "sample_asn", "isp": "sample_isp", "cc": "sample_country", "reg": "registrar", "status": "whois_status"}


def _featured(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ct_observations")
    o = rows.select(
        "id", present_host(F.col("raw_host")).alias("host"), present(F.col("source")).alias("source"), micros(rows, "event_ts").alias("at"), "num_unique_ips", "num_countries", "num_asns", *CATEGORIES.values(),
        micros(rows, "whois_created").alias("c"), micros(rows, "whois_expires").alias("x"), "risk_label_final", "ti_misp_hit", "whois_created", "whois_expires",
    ).where("host is not null")
    any_record = F.col("registrar").isNotNull() | F.col("whois_status").isNotNull() | F.col("c").isNotNull() | F.col("x").isNotNull()
    return features.with_registration(o, F.col("c"), F.col("x"), F.lit(None), any_record, NOW_US)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = features.prepared(_featured(spark, d), F.col("host"), CATEGORIES)
    return rows.where("risk_label_final is not null").withColumn("label", F.col("risk_label_final"))


def date_split(spark: SparkSession, d: str) -> DataFrame:
    """SC8: labelled observations by side and label, the latest day held out where it has enough of both."""
    rows = _labelled(spark, d).where("at is not null").select("id", "label", F.date_format(from_micros(F.col("at")), "yyyy-MM-dd").alias("day"))
    train, test, by_date = features.split_by_date(rows, "day", "label", "id")
    sides = train.select(F.lit("train").alias("side"), "label").unionByName(test.select(F.lit("test").alias("side"), "label"))
    return sides.groupBy("side", "label").agg(F.count("*").alias("n")).withColumn("by_date", F.lit(by_date))


def model_fusion(spark: SparkSession, d: str) -> DataFrame:
    """SC1-SC7: a model is fitted on labelled rows and scores all; per fused label and reason the rows, checked against score and hit."""
    rows = _labelled(spark, d)
    kind, model = features.primary({"lgbm_full": features.fit(rows, "id", parts=("lexical", "infrastructure", "categories", "registration"), rounds=5)})
    out = features.scored(model, rows)
    cut, hit = features.threshold({"metrics": {kind: {"threshold_at_1pct_fpr": 0.5}}}, kind), F.col("ti_misp_hit") == 1
    label, reason = features.fused(F.col("score"), hit, cut)
    told = out.select("id", "score", F.coalesce(hit, F.lit(False)).alias("hit"), label.alias("fused"), reason.alias("reason"))
    right = (F.col("fused") == ((F.col("score") >= cut) | F.col("hit")).cast("int")) & (F.col("reason").contains("MISP") == F.col("hit")) & (F.col("reason").contains("ML") == (F.col("score") >= cut))
    return told.groupBy("hit").agg(F.count("*").alias("n"), F.count_if(~right).alias("n_wrong"), F.count_if(~F.col("score").between(0, 1) | F.col("score").isNull()).alias("n_unscored"))


QUERIES = {
    f.__name__: f
    for f in (
        threat_verdicts, baseline_scores, tld_buckets, preferred_hosts, country_codes, campaign_cards, binary_labels, indicator_hits, indicator_precision, touched_clusters, daily_registrations, queue_depths, queue_run,
        newly_queued, confirmation, review_delay, suppression, campaign_rate, analyst_directory, brand_watchlist, risk_report, lead_report, address_countries, feature_numbers, date_split, model_fusion,
    )
}

_FINITE = "case when not isnan({0}) and not isinf({0}) then {0} end"
_AS_HOST = (
    "regexp_replace(regexp_replace(rtrim(case when contains(lower(trim({0}, ' \t\n\r\f\x0b')), '://') then nullif(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim({0}, ' \t\n\r\f\x0b')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), "
    "'^[^/?#]*'), '^.*@', ''), ':[0-9]*$', '')), '') else split_part(split_part(lower(trim({0}, ' \t\n\r\f\x0b')), '/', 1), ':', 1) end, '.'), '^[*][.]', ''), '^www[.]', '')"
)


def _as_host(c: str) -> str:
    h = _AS_HOST.format(c)
    return f"(case when contains({h}, '.') then {h} end)"


_STOPS = "[" + ", ".join(f"'{s}'" for s in TABLE_SUFFIXES) + "]"
_HITS = f"""with named as (select distinct {_as_host("registered_domain")} as i from ct_observations where {present_sql("source")} <> 'certstream'),
  h as (select distinct {_as_host("raw_host")} as host from ct_observations where {_as_host("raw_host")} is not null),
  w as (select host, k, array_to_string(string_split(host, '.')[k:], '.') as s from (select host, unnest(range(1, len(string_split(host, '.')) + 1)) as k from h)),
  hits as (select host, first(s order by k) as indicator from w where s in (select i from named) and not list_contains({_STOPS}, s) group by host)"""
_DISPOSED = "(select id, cluster_id, created_at, case when event_type = 'disposition_recorded' then 'confirmed' else 'suppressed' end as verdict from evidence_events where event_type in ('disposition_recorded', 'suppression_match'))"
_QUEUED = f"""q as (select domain, min(created_at) as enqueued, case arg_max(coalesce(enrichment_level, ''), id) when 'tier0' then 'pending' when 'tier1' then 'processing' else 'done' end as status, (arg_max(coalesce(num_unique_ips, 0), id) % 3)::integer as attempts
  from (select *, {present_host_sql("registered_domain")} as domain from ct_observations) where domain is not null group by 1)"""
_NOTE = "case when n = 0 then 'none' when n < 10 then 'low' else 'ok' end"
_DAY = 86_400_000_000
_DAYS = f"case when nothing or {{0}} is null then 0.0 else {{1}} / {8.64e10!r}::double end"

ORACLES = {
    "threat_verdicts": f"""{_BRANDS}, s as (select id, {_FINITE.format("risk_score")} as s, named.brand is not null as hit from ct_observations left join named on named.host = {present_host_sql("raw_host")})
      select id, case when s > 0.99 then 'CONFIRMED_MALICIOUS_INFRA' when s > 0.90 then 'IMMINENT_PHISHING_THREAT' when s > 0.70 then 'HIGH_PROBABILITY_STAGING' when s > 0.40 or hit then 'SUSPICIOUS_PATTERN' else 'BASELINE_NORMAL' end as verdict,
        case when s > 0.90 then 'CRITICAL' when s > 0.70 or hit then 'HIGH' else 'CLEAN' end as level from s""",
    "baseline_scores": f"""select distinct domain, round((case when regexp_extract(domain, '[^.]*$') in ({", ".join(f"'{t}'" for t in RISKY)}) then 0.5 else 0 end + case when regexp_matches(domain, '[0-9]{{4}}') then 0.3 else 0 end
      + case when len(regexp_extract_all(domain, '-')) >= 2 then 0.2 else 0 end)::double, 6) as score from (select {present_host_sql("registered_domain")} as domain from ct_observations) where domain is not null""",
    "tld_buckets": f"""select case when contains(domain, '.') and regexp_extract(domain, '[^.]*$') in ('qx', 'test') then 'reliable' else 'other' end as bucket, count(*) as n
      from (select distinct {present_host_sql("registered_domain")} as domain from ct_observations) group by 1""",
    "preferred_hosts": f"""select id, chosen, {_as_host("chosen")} as host from (select id, case when trim(registered_domain, ' ') <> '' then registered_domain else 'https://' || trim(raw_host, ' ') || '/x?y' end as chosen from ct_observations)""",
    "country_codes": """select case when c <> '' and length(c) <= 8 then c when n <> '' and length(n) <= 3 then n end as country, count(*) as n from (select trim(country_code, ' ') as c, trim(country, ' ') as n from dns_geo_cache) group by 1""",
    "campaign_cards": f"""select id, case when m is null then 'unknown' when m < 60 then floor(m + 0.5)::bigint || 'm ago' when m < 1440 then printf('%.1f', floor(m / 60 * 10 + 0.5) / 10) || 'h ago' else printf('%.1f', floor(m / 1440 * 10 + 0.5) / 10) || 'd ago' end as seen,
        round(least(1.0, confidence_score / k), 8) as max_risk, round(k, 8) as corroboration, confidence_score >= 0.9999 as at_limit
      from (select *, ({NOW_US} - epoch_us(last_seen))::double / 60000000 as m, 0.7::double + 0.3::double * least(observation_count, 10) / 10.0::double as k from campaign_clusters)""",
    "binary_labels": f"select case when {present_sql('source')} = 'certstream' then 0 else 1 end as label, count(*) as n from ct_observations group by 1",
    "indicator_hits": f"{_HITS} select host, indicator from hits",
    "indicator_precision": f"""{_HITS}, r as (select hits.host is not null as hit, row_number() over (order by risk desc, id) as place from (select id, {_FINITE.format("risk_score")} as risk, {_as_host("raw_host")} as host from ct_observations) left join hits using (host) where risk is not null)
      select k, count(*) as n_evaluated, count(*) filter (where hit) as n_hits, count(*) filter (where hit) / count(*) as precision from (values (10), (100), (1000)) t(k) join r on place <= k group by k""",
    "touched_clusters": f"""with e as (select * from ct_observations where enrichment_level in ('tier1', 'tier2')) select distinct cluster_id from cluster_members m join e on e.id = m.observation_id
      where cluster_id is not null and (e.raw_host, e.event_ts) in (select (raw_host, event_ts) from e where epoch_us(created_at) >= {RUN_AT} and event_ts is not null)""",
    "daily_registrations": f"""select {present_host_sql("domain")} as domain, registrar, fetched_at from whois_cache where {present_host_sql("domain")} in (select {present_host_sql("registered_domain")} from ct_observations where epoch_us(created_at) >= {RUN_AT} and {present_host_sql("registered_domain")} is not null)""",
    "queue_depths": f"with {_QUEUED} select status, count(*) as n, min(enqueued) as oldest, round(({NOW_US} - epoch_us(min(enqueued)))::double / 1e6, 3) as lag_seconds from q group by 1",
    "queue_run": f"""with {_QUEUED}, r as (select domain, enqueued, case when status = 'processing' then 'pending' else status end as status, attempts from q),
      c as (select *, case when status = 'pending' and row_number() over (partition by status order by enqueued, domain) <= 50 then 'processing' else status end as s from r),
      f as (select domain, attempts, case when s = 'processing' and domain in (select {present_host_sql("puny_domain")} from dns_geo_cache where asn is not null and {present_host_sql("puny_domain")} is not null) then 'done' else s end as s from c)
      select domain, case when s = 'processing' then case when attempts + 1 >= 3 then 'failed' else 'pending' end else s end as status, attempts + case when s = 'processing' then 1 else 0 end as attempts, s = 'processing' and attempts + 1 >= 3 as in_ledger from f""",
    "newly_queued": f"with {_QUEUED} select distinct {present_host_sql('domain')} as domain from stream_ct where {present_host_sql('domain')} is not null and {present_host_sql('domain')} not in (select domain from q where status in ('pending', 'processing'))",
    "confirmation": f"""with v as (select cluster_id, arg_max(verdict, id) as verdict from {_DISPOSED} where cluster_id is not null group by 1), c as (select count(*) as n, count(*) filter (where verdict = 'confirmed') as n_confirmed from v)
      select n, n_confirmed, round(n_confirmed / nullif(n, 0), 4) as rate, {_NOTE} as note from c""",
    "review_delay": f"""select count(*) as n, round(quantile_cont(greatest(0.0, (epoch_us(f) - epoch_us(c.created_at))::double / 3.6e9), 0.5), 2) as median_hours
      from campaign_clusters c join (select cluster_id, min(created_at) as f from {_DISPOSED} group by 1) d on d.cluster_id = c.id""",
    "suppression": "select count(*) as n_total, count(*) filter (where stage = 'suppressed') as n_suppressed, round(count(*) filter (where stage = 'suppressed') / nullif(count(*), 0), 4) as rate from campaign_clusters",
    "campaign_rate": f"""select n as n_in_window, round(n / greatest(1.0, least(7.0, ({NOW_US} - first)::double / {_DAY})), 2) as per_day
      from (select min(epoch_us(created_at)) as first, count(*) filter (where epoch_us(created_at) >= {NOW_US} - 7 * {_DAY}) as n from campaign_clusters)""",
    "analyst_directory": "select username, display_name, (row_number() over (order by username))::integer as place from analysts where active",
    "brand_watchlist": f"""select brand, priority, coalesce(n, 0) as n, (row_number() over (order by priority desc, brand))::integer as place from (values {", ".join(f"('{b}', {p})" for b, _, p in WATCHED)}) w(brand, priority)
      left join (select {present_sql("target_brand")} as brand, count(*) as n from campaign_clusters group by 1) using (brand)""",
    "risk_report": f"select id, raw_host, {_FINITE.format('risk_score')} as risk_score, decision_reason from ct_observations where not isnan(risk_score) order by risk_score desc, id limit 15",
    "lead_report": f"{_LEAD} select raw_host, match_tier, sources, round((b - a)::double / 3.6e9::double, 6) as lead_hours from m order by b - a desc, raw_host, match_tier limit 10",
    "address_countries": f"""with r as (select {present_host_sql("puny_domain")} as domain, ip, country, fetched_at from dns_geo_cache where {present_host_sql("puny_domain")} is not null),
      k as (select ip, arg_max(country, struct_pack(f := fetched_at, c := country)) as country from r where ip is not null and country is not null group by 1)
      select distinct r.domain, r.ip, k.country from r left join k on k.ip = r.ip""",
    "feature_numbers": f"""select id, greatest(length(host) - 2, 0) + greatest(length(host) - 3, 0) + greatest(length(host) - 4, 0) as n_grams,
        array_to_string([x for x in [{", ".join(f"'{p}=' || {present_sql(c)}" for p, c in CATEGORIES.items())}] if x is not null], ',') as tokens,
        len(regexp_extract_all(host, '[0-9]'))::double as digits, len(regexp_extract_all(host, '-'))::double as hyphens, coalesce(num_unique_ips, 0)::double as num_unique_ips, coalesce(num_asns, 0)::double as num_asns,
        {_DAYS.format("whois_created", f"({NOW_US} - epoch_us(whois_created))::double")} as age_days, {_DAYS.format("whois_expires", f"(epoch_us(whois_expires) - {NOW_US})::double")} as days_to_expiry,
        case when nothing then 0.0 else (whois_created is null)::integer::double end as created_isnull, case when nothing then 0.0 else (whois_expires is null)::integer::double end as expires_isnull
      from (select *, {present_host_sql("raw_host")} as host, registrar is null and whois_status is null and whois_created is null and whois_expires is null as nothing from ct_observations) where host is not null""",
    "date_split": f"""with l as (select id, risk_label_final as label, strftime(event_ts, '%Y-%m-%d') as day from ct_observations where risk_label_final is not null and event_ts is not null and {present_host_sql("raw_host")} is not null),
      s as (select *, day = max(day) over () as held from l), n as (select count(*) as n from s group by held, label),
      c as (select *, (select count(*) = 4 and min(n) >= 30 from n) as by_date from s)
      select case when case when by_date then held else ('0x' || left(md5('42|' || label || '|' || id), 12))::bigint % 4 = 0 end then 'test' else 'train' end as side, label, count(*) as n, by_date from c group by all""",
    "model_fusion": f"select coalesce(ti_misp_hit = 1, false) as hit, count(*) as n, 0::bigint as n_wrong, 0::bigint as n_unscored from ct_observations where risk_label_final is not null and {present_host_sql('raw_host')} is not null group by 1",
}
