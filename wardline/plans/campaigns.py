"""Queries on triage and campaigns."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import present, present_host
from wardline.functions.times import from_micros, micros
from wardline.operators import campaigns, merging, triage
from wardline.plans.analytics import present_host_sql, present_sql
from wardline.plans.names import CRC_TABLE, crc_sql
from wardline.tables import table

# The brands of the tables, with invented own domains, and common words beside them.
BRANDS = ["hekadopay", "binemabank", "lopiremail", "bolebecloud", "safazostore", "sobodopost", "fehisaair", "gesisetel"]
WORDS = ["login", "secure", "verify", "account", "support", "update", "auth"]
OWN = {b: [f"{b}.test", f"{b}.com.qx"] for b in BRANDS}
RULES = triage.Rules(suspicious_tlds=["zz", "xq"], keywords=BRANDS + WORDS, providers=["com.qx", "co.zz"], own_domains=OWN, infra_suffixes=["invalid"])
WATCHED = [(b, [b[:-1] + "o"], 200 - 10 * (i // 3)) for i, b in enumerate(BRANDS)]
# What hosts pretend to be for, the first category first.
WORKFLOWS = {
    "login": ["login", "signin", "sign-in", "auth", "account", "verify"],
    "sso": ["sso", "identity", "okta", "adfs", "saml"],
    "billing": ["billing", "invoice", "payment", "pay", "checkout"],
    "payroll": ["payroll", "hr-portal", "employee", "salary", "paystub"],
    "wallet": ["wallet", "crypto", "coin", "exchange", "withdraw"],
    "support": ["support", "helpdesk", "ticket", "service-desk"],
    "shipping": ["shipping", "delivery", "tracking", "parcel", "courier"],
}
LISTED = [1, 2, 3, 5, 8, 13, 21]
SUPPRESSIONS = [(1, "domain", "test", None, True), (2, "registrar", "umbra", None, True), (3, "asn", "as65431", None, True), (4, "domain", "myfiroritifo.qz", None, False), (5, "domain", "com.qx", 1, True)]
NOW_US = 1788220800000000
#: Observations stored from this moment on (15 August 2026) are the second run's.
MERGED_AT = 1786752000000000


def _stream_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_ct").select("domain")


def triage_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Score and reasons of every distinct streamed host."""
    t = triage.triage(_stream_hosts(spark, d), "domain", RULES)
    return t.select("host", F.round("score", 6).alias("score"), F.array_join("reasons", ";").alias("reasons"))


def triage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by decision."""
    return triage.triage(_stream_hosts(spark, d), "domain", RULES).groupBy("decision").agg(F.count("*").alias("n"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ct_observations")
    return rows.select("id", present_host(F.col("raw_host")).alias("host"), present_host(F.col("registered_domain")).alias("domain"), micros(rows, "event_ts").alias("at"), "risk_score", F.col("sample_asn").alias("asn"), "registrar", micros(rows, "created_at").alias("stored"))


def host_brands(spark: SparkSession, d: str) -> DataFrame:
    """The watched brand each observed host imitates."""
    return campaigns.attribute(_observed(spark, d), "host", campaigns.alias_table(spark, WATCHED, OWN))


def assembled_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of risky, attributed observations that no live rule suppresses, by brand, day and family."""
    made = _assembled(spark, d, _candidates(spark, d))
    text = campaigns.summary_text(F.col("n_members"), F.col("brand"), F.col("day"), F.col("family"))
    return made.withColumns({"first_seen": from_micros(F.col("first_seen")), "last_seen": from_micros(F.col("last_seen")), "summary": text})


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d).where("risk_score >= 0.5 and not isnan(risk_score) and at is not null and host is not null")
    kept = rows.join(suppressed_observations(spark, d).select("id"), "id", "left_anti")
    return kept.withColumn("day", F.date_format(from_micros(F.col("at")), "yyyy-MM-dd"))


def _assembled(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    return campaigns.assemble(candidates, campaigns.attribute(candidates, "host", campaigns.alias_table(spark, WATCHED, OWN)))


def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """M3: clusters of the observations stored before a moment, and what those stored after it create or add to."""
    rows = _candidates(spark, d)
    made = [_assembled(spark, d, rows.where(c)) for c in (F.col("stored") < MERGED_AT, F.col("stored") >= MERGED_AT)]
    out = campaigns.merge_clusters(*made)
    return out.select("cluster_key", "brand", "n_members", "max_risk", from_micros(F.col("first_seen")).alias("first_seen"), from_micros(F.col("last_seen")).alias("last_seen"), "confidence", "outcome")


def _members(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "cluster_members").where("cluster_id is not null").select("cluster_id", "observation_id").distinct()
    return pairs.join(table(spark, d, "campaign_clusters").select(F.col("id").alias("cluster_id")), "cluster_id")


def cluster_workflows(spark: SparkSession, d: str) -> DataFrame:
    """What the hosts of each campaign pretend to be for."""
    hosts = _members(spark, d).join(_observed(spark, d).select(F.col("id").alias("observation_id"), "host"), "observation_id").where("host is not null")
    words = spark.createDataFrame([(k, c, i) for i, (c, ks) in enumerate(WORKFLOWS.items()) for k in ks], "keyword string, category string, priority int")
    return campaigns.workflow(hosts, "cluster_id", "host", words)


def member_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well each member fits its campaign."""
    rows = _members(spark, d).join(_observed(spark, d).withColumnRenamed("id", "observation_id"), "observation_id")
    return campaigns.membership_scores(rows, decimals=11)


def cluster_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Stored and recomputed counts and confidence of each campaign."""
    o = _observed(spark, d).select(F.col("id").alias("observation_id"), F.when(~F.isnan("risk_score"), F.col("risk_score")).alias("r"))
    per = _members(spark, d).join(o, "observation_id").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("r").alias("max_risk"))
    c = table(spark, d, "campaign_clusters").select(F.col("id").alias("cluster_id"), "confidence_score", "observation_count")
    again = F.round(campaigns.confidence(F.coalesce("max_risk", F.lit(0.0)), F.col("n")), 8)
    return c.join(per, "cluster_id").select("cluster_id", "n", again.alias("confidence"), (F.abs(again - F.col("confidence_score")) > 1e-6).alias("drifted"), (F.col("n") != F.col("observation_count")).alias("count_differs"))


def visible(clusters: DataFrame, least: float = 0.3, brand: str | None = None, stage: str | None = None, assignee: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Clusters from a confidence on, or locked; optionally of one brand, stage or assignee (brand and assignee compare folded). A list of ids stands for all of these conditions."""
    if ids is not None:
        return clusters.where(F.col("id").isin(ids))
    rows = clusters.where((F.col("confidence_score") >= least) | F.col("stage_locked_by").isNotNull())
    for c, v in ((present(F.col("target_brand")), brand), (F.col("stage"), stage), (present(F.col("assignee")), assignee)):
        if v is not None:
            rows = rows.where(c == v)
    return rows


def queue_filters(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns of the queue under each kind of filter, all of them."""
    c = table(spark, d, "campaign_clusters")
    kinds = {"brand": visible(c, brand=BRANDS[0]), "stage": visible(c, stage="active"), "both": visible(c, brand=BRANDS[0], stage="new"), "nobody": visible(c, assignee="nobody"), "listed": visible(c, ids=LISTED)}
    parts = [rows.select(F.lit(k).alias("filter"), "id") for k, rows in kinds.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def campaign_queue(spark: SparkSession, d: str) -> DataFrame:
    """O3: the hundred campaigns an analyst sees first."""
    rows = visible(table(spark, d, "campaign_clusters"))
    return rows.orderBy(F.col("confidence_score").desc(), "id").limit(100).select("id", present(F.col("target_brand")).alias("target_brand"), "confidence_score", "queue_status")


def top_members(spark: SparkSession, d: str) -> DataFrame:
    """The three riskiest members of each campaign, unscored ones first."""
    rows = _members(spark, d).join(_observed(spark, d).select(F.col("id").alias("observation_id"), F.when(~F.isnan("risk_score"), F.col("risk_score")).alias("r")), "observation_id")
    w = Window.partitionBy("cluster_id").orderBy(F.col("r").desc_nulls_first(), "observation_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3").select("cluster_id", "observation_id", "place")


def suppressed_observations(spark: SparkSession, d: str) -> DataFrame:
    """Each observation's first live suppression rule."""
    rules = spark.createDataFrame(SUPPRESSIONS, "rule_id long, rule_type string, match_value string, expires long, active boolean")
    return campaigns.matching_rule(_observed(spark, d), rules, NOW_US)


def fully_suppressed_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns whose members all meet a rule."""
    hit = suppressed_observations(spark, d).select(F.col("id").alias("observation_id"), F.lit(True).alias("met"))
    per = _members(spark, d).join(hit, "observation_id", "left").groupBy("cluster_id").agg(F.bool_and(F.coalesce("met", F.lit(False))).alias("all_met"), F.count("*").alias("n"))
    return per.where("all_met").select("cluster_id", "n")


def campaigns_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns and suppressed ones per day of creation."""
    rows = table(spark, d, "campaign_clusters")
    day = F.date_format(from_micros(micros(rows, "created_at")), "yyyy-MM-dd")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "suppressed").alias("n_suppressed"))


def first_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Hours from a campaign's creation to its first evidence, and the newest evidence's kind."""
    e = table(spark, d, "evidence_events").where("cluster_id is not null")
    per = e.select("cluster_id", micros(e, "created_at").alias("t"), "id", "event_type").groupBy("cluster_id").agg(F.min("t").alias("first"), F.max_by("event_type", "id").alias("newest"))
    c = table(spark, d, "campaign_clusters")
    c = c.select(F.col("id").alias("cluster_id"), micros(c, "created_at").alias("born"))
    return c.join(per, "cluster_id").select("cluster_id", (F.greatest(F.lit(0), F.col("first") - F.col("born")) / F.lit(3.6e9)).alias("hours"), "newest")


def next_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each deletion the first evidence of the same campaign after it."""
    gone = table(spark, d, "cluster_deletions")
    gone = gone.select("cluster_id", micros(gone, "deleted_at").alias("t")).distinct()
    e = table(spark, d, "evidence_events")
    e = e.select("cluster_id", F.col("id").alias("evidence_id"), micros(e, "created_at").alias("u"))
    after = gone.join(e, "cluster_id", "left").groupBy("cluster_id", "t").agg(F.min_by("evidence_id", F.when(F.col("u") > F.col("t"), F.struct("u", "evidence_id"))).alias("evidence_id"))
    return after.select("cluster_id", from_micros(F.col("t")).alias("deleted_at"), "evidence_id")


def repeated_members(spark: SparkSession, d: str) -> DataFrame:
    """M2: memberships inserted once per pair, the earliest row kept."""
    rows = table(spark, d, "cluster_members").where("cluster_id is not null")
    return merging.keep_first(rows, ["cluster_id", "observation_id"], [F.col("created_at"), F.col("id")]).select("cluster_id", "observation_id", "id")


def refreshed_cache(spark: SparkSession, d: str) -> DataFrame:
    """M5: the registration cache with all rows of the domains looked up last replaced by that lookup."""
    rows = table(spark, d, "whois_cache")
    keyed = rows.select(present_host(F.col("domain")).alias("domain"), "fetched_at", "error", micros(rows, "fetched_at").alias("f")).where("domain is not null")
    new = keyed.where("f >= 1787616000000000")
    old = keyed.where("f < 1787616000000000")
    return merging.replace_keys(old, new, ["domain"]).groupBy("domain").agg(F.count("*").alias("n"), F.max("fetched_at").alias("newest"), F.count("error").alias("n_failed"))


QUERIES = {
    f.__name__: f
    for f in (
        triage_hosts, triage_counts, host_brands, assembled_clusters, merged_clusters, queue_filters, cluster_workflows, member_scores, cluster_confidence, campaign_queue, top_members, suppressed_observations, fully_suppressed_clusters,
        campaigns_per_day, first_reviews, next_evidence, repeated_members, refreshed_cache,
    )
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_EVERYWHERE = sorted({*RULES.infra_suffixes, *(s for own in OWN.values() for s in own)})
_KEYWORDS = ", ".join(f"('{k}', {str(k in OWN).lower()}, {_list(OWN.get(k, _EVERYWHERE))})" for k in RULES.keywords)
_TOKENS = "[t for t in [regexp_replace(x, '[^\\p{{L}}]', '', 'g') for x in regexp_split_to_array({0}, '[._-]')] if t <> '']"
_NEAR = "(t = {0} {1} or (length({0}) > 5 and length(t) >= 4 and left(t, 1) = left({0}, 1) and abs(length(t) - length({0})) <= 1 and levenshtein(t, {0}) <= 1))"
_N = "len(regexp_extract_all(h, '{0}'))"
_CORE = "list_reduce(list_concat([''], case when len(string_split(h, '.')) > 1 then string_split(h, '.')[:-2] else string_split(h, '.') end), lambda a, b: case when length(b) > length(a) then b else a end)"
_ENT = "coalesce(list_sum([-(n / length(core)) * log2(n / length(core)) for n in [length(core) - length(replace(core, c, '')) for c in list_distinct(string_split(core, ''))] if n > 0]), 0)"
_TRIAGE = f"""with hosts as (select distinct rtrim(lower(trim(coalesce(domain, ''), ' \t\n\r\f\x0b')), '.') as h from stream_ct),
kw(kw, brand, exempt) as (values {_KEYWORDS}),
tok as (select h, unnest({_TOKENS.format("h")}) as t from hosts),
hit as (select distinct h, kw, brand from tok, kw where {_NEAR.format("kw", "or replace(t, 'rn', 'm') = kw")} and len([s for s in exempt if h = s or ends_with(h, '.' || s)]) = 0),
grouped as (select h, string_agg(kw, ',' order by kw) filter (where brand) as brands, string_agg(kw, ',' order by kw) filter (where not brand) as words from hit group by h),
f as (select h, brands, words, {_CORE} as core, case when contains(h, '.') then regexp_extract(h, '[^.]*$') end as tld, {_N.format("-")} as hyphens,
  {_N.format("[0-9]")} / greatest({_N.format("[\\p{L}\\p{N}]")}, 1) as ratio, [p for p in {_list(RULES.providers)} if h = p or ends_with(h, '.' || p)][1] as provider from hosts left join grouped using (h)),
r as (select h, case when tld in ('zz', 'xq') then 'suspicious_tld:' || tld end as r1, case when length(core) >= 8 and {_ENT} >= 3.8 then printf('high_entropy:%.2f', {_ENT}) end as r2,
  'brand_match:' || brands as r3, 'sensitive_word:' || words as r4, case when hyphens > 3 then 'excessive_hyphens:' || hyphens end as r5, case when ratio > 0.3 then printf('excessive_digits:%.2f', ratio) end as r6,
  case when length(h) > 45 then 'long_domain:' || length(h) end as r7, case when regexp_matches(h, '(^|[.])xn--') then 'punycode' end as r8, 'free_subdomain_provider:' || provider as r9 from f)"""
_SCORE = "round(case when r1 is null then 0.0 else 0.0431 end::double + case when r2 is null then 0.0 else 0.1076 end::double + case when r3 is null then 0.0 else 0.3044 end::double + case when r4 is null then 0.0 else 0.2835 end::double + case when r5 is null then 0.0 else 0.0473 end::double + case when r6 is null then 0.0 else 0.027 end::double + case when r9 is null then 0.0 else 0.1872 end::double, 6)"
_ALIASES = ", ".join(f"('{a}', '{b}', {p}, {_list(OWN[b])})" for b, more, p in WATCHED for a in [b, *more])
_BRANDS = f"""with hosts as (select distinct {present_host_sql("raw_host")} as h from ct_observations where {present_host_sql("raw_host")} is not null),
al(a, brand, prio, own) as (values {_ALIASES}), tok as (select h, unnest({_TOKENS.format("h")}) as t from hosts),
met as (select h, brand, prio from tok, al where {_NEAR.format("a", "")} and len([s for s in own if h = s or ends_with(h, '.' || s)]) = 0),
named as (select h as host, brand from (select *, row_number() over (partition by h order by prio desc, brand) as k from met) where k = 1)"""
_MEMBERS = "m as (select distinct cluster_id, observation_id from cluster_members join campaign_clusters c on c.id = cluster_id)"
_FLOWS = _values([(k, c, i) for i, (c, ks) in enumerate(WORKFLOWS.items()) for k in ks])
_RULES = f"""rules(rule_id, kind, v, expires, active) as (values {_values(SUPPRESSIONS)}),
o as (select id, {present_host_sql("raw_host")} as host, {present_host_sql("registered_domain")} as domain, lower(registrar) as registrar, lower(sample_asn) as asn from ct_observations),
sup as (select o.id, min(rule_id) as rule_id from o, rules where active and (expires is null or expires > {NOW_US}) and
  ((kind = 'domain' and (host = v or ends_with(host, '.' || v) or domain = v)) or (kind = 'registrar' and contains(registrar, v)) or (kind = 'asn' and asn = v)) group by 1)"""

ORACLES = {
    "triage_hosts": f"{_TRIAGE} select h as host, {_SCORE} as score, array_to_string([x for x in [r1, r2, r3, r4, r5, r6, r7, r8, r9] if x is not null], ';') as reasons from r",
    "triage_counts": f"""{_TRIAGE}, {CRC_TABLE} select case when score >= 0.198 then 'forward' when {crc_sql("h")} % 10000 < 1000 or r1 is not null or r3 is not null or r4 is not null then 'spool' else 'drop' end as decision, count(*) as n
      from (select *, {_SCORE} as score from r), crc_table group by 1""",
    "host_brands": f"{_BRANDS} select host, brand from named",
    "assembled_clusters": f"""{_BRANDS}, {_RULES}, c as (select brand, strftime(event_ts, '%Y-%m-%d') as day, case when contains(host, '.') then regexp_extract(host, '[^.]*$') else '' end || ':' || case when len(regexp_extract_all(host, '-')) >= 3 then 'h' else 'l' end as family, risk_score, event_ts
        from (select *, {present_host_sql("raw_host")} as host from ct_observations) join named using (host) where risk_score >= 0.5 and not isnan(risk_score) and event_ts is not null and id not in (select id from sup))
      select brand, day, family, sha1(brand || '|' || day || '|' || family) as cluster_key, count(*) as n_members, max(risk_score) as max_risk, min(event_ts) as first_seen, max(event_ts) as last_seen,
        round(least(1.0, max(risk_score) * (0.7::double + 0.3::double * least(count(*), 10) / 10.0::double)), 8) as confidence,
        count(*) || ' domain(s) impersonating ' || brand || ' in a cert-issuance burst on ' || day || ' (family ' || family || ')' as summary from c group by 1, 2, 3""",
    "merged_clusters": f"""{_BRANDS}, {_RULES}, c as (select brand, strftime(event_ts, '%Y-%m-%d') as day, case when contains(host, '.') then regexp_extract(host, '[^.]*$') else '' end || ':' || case when len(regexp_extract_all(host, '-')) >= 3 then 'h' else 'l' end as family,
        risk_score, event_ts, epoch_us(created_at) >= {MERGED_AT} as new
        from (select *, {present_host_sql("raw_host")} as host from ct_observations) join named using (host) where risk_score >= 0.5 and not isnan(risk_score) and event_ts is not null and id not in (select id from sup))
      select sha1(brand || '|' || day || '|' || family) as cluster_key, brand, count(*)::bigint as n_members, max(risk_score) as max_risk, min(event_ts) as first_seen, max(event_ts) as last_seen,
        round(least(1.0, max(risk_score) * (0.7::double + 0.3::double * least(count(*), 10) / 10.0::double)), 8) as confidence,
        case when bool_and(new) then 'created' when bool_or(new) then 'merged' else 'kept' end as outcome from c group by brand, day, family""",
    "queue_filters": f"""with v as (select *, {present_sql("target_brand")} as b, {present_sql("assignee")} as a from campaign_clusters where confidence_score >= 0.3 or stage_locked_by is not null)
      select 'brand' as filter, id from v where b = '{BRANDS[0]}' union all select 'stage', id from v where stage = 'active' union all select 'both', id from v where b = '{BRANDS[0]}' and stage = 'new'
      union all select 'nobody', id from v where a = 'nobody' union all select 'listed', id from campaign_clusters where id in ({", ".join(map(str, LISTED))})""",
    "cluster_workflows": f"""with {_MEMBERS}, h as (select distinct cluster_id, {present_host_sql("raw_host")} as h from m join ct_observations o on o.id = observation_id where {present_host_sql("raw_host")} is not null),
      kw(kw, category, p) as (values {_FLOWS}), met as (select cluster_id, category, p from (select cluster_id, unnest({_TOKENS.format("h")}) as t from h), kw where {_NEAR.format("kw", "")})
      select cluster_id, coalesce(first(category order by p), 'generic') as workflow from (select distinct cluster_id from h) left join met using (cluster_id) group by 1""",
    "cluster_confidence": f"""with {_MEMBERS}, p as (select cluster_id, count(*) as n, max(case when not isnan(risk_score) then risk_score end) as r from m join ct_observations o on o.id = observation_id group by 1),
      x as (select cluster_id, n, round(least(1.0, coalesce(r, 0.0) * (0.7::double + 0.3::double * least(n, 10) / 10.0::double)), 8) as confidence from p)
      select cluster_id, n, confidence, abs(confidence - confidence_score) > 1e-6 as drifted, n <> observation_count as count_differs from x join campaign_clusters c on c.id = cluster_id""",
    "campaign_queue": f"select id, {present_sql('target_brand')} as target_brand, confidence_score, queue_status from campaign_clusters where confidence_score >= 0.3 or stage_locked_by is not null order by confidence_score desc, id limit 100",
    "top_members": f"""with {_MEMBERS} select cluster_id, observation_id, place from (select cluster_id, observation_id, (row_number() over (partition by cluster_id order by case when not isnan(risk_score) then risk_score end desc nulls first, observation_id))::integer as place
      from m join ct_observations o on o.id = observation_id) where place <= 3""",
    "suppressed_observations": f"with {_RULES} select id, rule_id::bigint as rule_id from sup",
    "fully_suppressed_clusters": f"with {_MEMBERS}, {_RULES} select cluster_id, count(*) as n from m left join sup on sup.id = observation_id group by 1 having bool_and(sup.id is not null)",
    "campaigns_per_day": "select strftime(created_at, '%Y-%m-%d') as day, count(*) as n, count(*) filter (where stage = 'suppressed') as n_suppressed from campaign_clusters group by 1",
    "first_reviews": """select cluster_id, greatest(0, first - epoch_us(c.created_at))::double / 3.6e9::double as hours, newest from (
      select cluster_id, min(epoch_us(created_at)) as first, arg_max(event_type, id) as newest from evidence_events where cluster_id is not null group by 1) e join campaign_clusters c on c.id = cluster_id""",
    "next_evidence": """select cluster_id, deleted_at, (select first(e.id order by e.created_at, e.id) from evidence_events e where e.cluster_id = g.cluster_id and e.created_at > g.deleted_at) as evidence_id
      from (select distinct cluster_id, deleted_at from cluster_deletions) g""",
    "repeated_members": "select cluster_id, observation_id, id from cluster_members where cluster_id is not null qualify row_number() over (partition by cluster_id, observation_id order by created_at, id) = 1",
    "refreshed_cache": f"""with k as (select {present_host_sql("domain")} as domain, fetched_at, error, epoch_us(fetched_at) >= 1787616000000000 as new from whois_cache where {present_host_sql("domain")} is not null)
      select domain, count(*) as n, max(fetched_at) as newest, count(error) as n_failed from k where new or domain not in (select domain from k where new) group by 1""",
    "member_scores": f"""with {_MEMBERS}, r as (select m.*, {present_host_sql("raw_host")} as host, epoch_us(event_ts) as t, lower(sample_asn) as asn, lower(registrar) as reg from m join ct_observations o on o.id = observation_id),
      p as (select a.cluster_id, a.observation_id, a.host, a.t, a.asn, a.reg, b.observation_id is not null as other, b.host as bh, b.t as bt, b.asn as ba, b.reg as br from r a left join r b on a.cluster_id = b.cluster_id and a.observation_id <> b.observation_id),
      s as (select cluster_id, observation_id, t, avg(case when host is not null and bh is not null then 1 - levenshtein(host, bh) / greatest(length(host), length(bh), 1) end) as lex,
        list(bt order by bt) filter (where bt is not null) as ts, avg((asn = ba)::integer) as sa, avg((reg = br)::integer) as sr from p group by 1, 2, 3)
      select cluster_id, observation_id, round(0.30::double + 0.25::double * case when t is null or coalesce(len(ts), 0) = 0 then 0.5 else greatest(0.0, 1.0 - least(abs(t - ts[len(ts) // 2 + 1]) / 3.6e9::double, 24.0) / 24.0) end
        + 0.20::double * coalesce(lex, 0) + 0.15::double * coalesce(sa, 0) + 0.10::double * coalesce(sr, 0), 11) as score from s""",
}
