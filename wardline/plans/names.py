"""Queries on names, texts and times, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.functions.hosts import clean_host, clean_host_all_wildcards, is_host, last_label, trimmed, under
from wardline.functions.times import from_micros, hour_start, micros, text_micros
from wardline.operators import suffixes
from wardline.plans.dealt import _EPOCH, fold_sql, host_sql, micros_sql
from wardline.tables import table

# The suffixes under which the tables' names are registered.
TABLE_SUFFIXES = ["qx", "zz", "xz", "qz", "xq", "test", "example", "invalid", "com.qx", "co.zz", "net.qx"]
#: Times are measured against this moment, so that results don't depend on the day.
NOW = "2026-09-01 00:00:00"


def host_forms(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned forms of every message's host."""
    c = F.col("domain")
    return table(spark, d, "stream_ct").select(
        "kafka_offset", clean_host(c).alias("host"), clean_host_all_wildcards(c).alias("host_no_wildcards"), is_host(trimmed(c)).alias("is_host"), last_label(clean_host(c)).alias("last_label")
    )


def host_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Ten lexical statistics of every distinct host."""
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host")).distinct()
    stats = X.lexical_statistics(F.col("host"))
    return hosts.select("host", *[(F.round(v, 6) if k in ("digit_ratio", "hyphen_ratio", "entropy") else v).alias(k) for k, v in stats.items()])


def host_flags(spark: SparkSession, d: str) -> DataFrame:
    """Anomaly flags and lexical family of every distinct host."""
    h = F.col("host")
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host")).distinct()
    tld = F.coalesce(last_label(h), F.lit(""))
    letters = X.count_of(h, "[a-z]")
    flags = F.array_compact(
        F.array(
            F.when(F.length(h) > 25, "long"),
            F.when(X.entropy(h) > 3.8, "entropy"),
            F.when(X.count_of(h, "-") > 1, "hyphens"),
            F.when(h.rlike("[0-9]") & (letters < 4), "digits"),
        )
    )
    family = F.concat(tld, F.lit(":"), F.when(X.count_of(h, "-") >= 3, "h").otherwise("l"))
    return hosts.select("host", F.array_join(flags, ",").alias("flags"), family.alias("family"))


def host_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of hosts with their frequency and collapsed form."""
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host")).distinct()
    each = hosts.select(F.explode(X.tokens(F.col("host"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).select("token", X.collapse_homoglyphs(F.col("token")).alias("collapsed"), "n")


def registered_domains(spark: SparkSession, d: str) -> DataFrame:
    """P5: the registered domain of every distinct host by the suffix rules."""
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host"))
    rules = spark.createDataFrame([(s,) for s in TABLE_SUFFIXES], "rule string")
    return suffixes.registered_domain(hosts, "host", rules)


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts out of URLs and indicators of several shapes, made of the observed names."""
    rows = table(spark, d, "ct_observations").select("id", clean_host(F.col("raw_host")).alias("h"))
    shaped = F.element_at(
        F.array(
            F.concat(F.lit("https://"), "h", F.lit(":8443/a?b=http://c.d/#e")), F.concat(F.lit("HTTP://user:pw@"), "h"), F.concat(F.col("h"), F.lit("/path:1")), F.concat(F.lit("www."), "h", F.lit(":80/x")), F.lit("nodots")
        ),
        (F.pmod("id", F.lit(5)) + 1).cast("int"),
    )
    return rows.select("id", X.url_host(shaped).alias("url_host"), X.indicator_host(shaped).alias("indicator_host"))


def page_probe(spark: SparkSession, d: str) -> DataFrame:
    """Title, password field and fingerprint of every document read as a page."""
    title, password = X.html_title(F.col("text")), X.has_password_field(F.col("text"))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), password.alias("password_field"), X.content_fingerprint(F.lit(200), title, password).alias("fingerprint"))


def row_labels(spark: SparkSession, d: str) -> DataFrame:
    """Finite score and model tag of every observation; the verdicts are in ``threat_verdicts``."""
    rows = table(spark, d, "ct_observations")
    return rows.select("id", X.finite(F.col("risk_score")).alias("score"), X.model_tag(F.coalesce("model_used", F.lit("none")), from_micros(micros(rows, "created_at"))).alias("tag"))


def times(spark: SparkSession, d: str) -> DataFrame:
    """Both times of every message, its latency in whole seconds and its UTC hour and day."""
    e, p = text_micros(F.col("event_ts")), text_micros(F.col("producer_ts"))
    rows = table(spark, d, "stream_ct").select("kafka_offset", e.alias("e"), p.alias("p"))
    day = F.date_format(from_micros(F.col("e")), "yyyy-MM-dd")
    return rows.select("kafka_offset", from_micros(F.col("e")).alias("event_time"), from_micros(F.col("p")).alias("producer_time"), (F.floor(F.col("p") / 1e6) - F.floor(F.col("e") / 1e6)).alias("latency_sec"), from_micros(hour_start(F.col("e"))).alias("hour"), day.alias("day"))


def registration_ages(spark: SparkSession, d: str) -> DataFrame:
    """D3-D4, SC3: age and expiry in days at the fixed moment, with missing flags; all zero without any record."""
    rows = table(spark, d, "ct_observations")
    now = F.unix_micros(F.lit(NOW + "Z").cast("timestamp"))
    none = F.col("registrar").isNull() & F.col("whois_status").isNull() & F.col("c").isNull() & F.col("x").isNull()
    timed = rows.select("id", "registrar", "whois_status", micros(rows, "whois_created").alias("c"), micros(rows, "whois_expires").alias("x"))

    def days(c: str, sign: int) -> Column:
        return F.when(none | F.col(c).isNull(), 0.0).otherwise((now - F.col(c)) * sign / F.lit(8.64e10))

    def absent(c: str) -> Column:
        return F.when(none, 0).otherwise(F.col(c).isNull().cast("int"))

    return timed.select("id", days("c", 1).alias("age_days"), days("x", -1).alias("days_to_expiry"), absent("c").alias("created_isnull"), absent("x").alias("expires_isnull"))


def evidence_status(spark: SparkSession, d: str) -> DataFrame:
    """The HTTP status inside the evidence's JSON; broken JSON gives null and is flagged."""
    rows = table(spark, d, "evidence_events")
    parsed = F.try_parse_json("detail")
    return rows.select("id", F.col("event_type"), F.try_variant_get(parsed, "$.http_status", "int").alias("http_status"), (F.col("detail").isNotNull() & parsed.isNull()).alias("broken"))


def crc_buckets(spark: SparkSession, d: str) -> DataFrame:
    """One in ten hosts by CRC-32."""
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host")).distinct()
    bucket = F.crc32(F.col("host").cast("binary")) % 10000
    return hosts.select("host", bucket.alias("bucket"), (bucket < 1000).alias("sampled"))


def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated percentiles of risk per enrichment level."""
    rows = table(spark, d, "ct_observations").where("risk_score is not null and not isnan(risk_score)")
    return rows.groupBy("enrichment_level").agg(*[F.round(F.percentile("risk_score", p / 100), 6).alias(f"p{p}") for p in (50, 90, 99)], F.count("*").alias("n"))


def provider_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first listed suffix each host lies under."""
    hosts = table(spark, d, "ct_observations").select(clean_host(F.col("raw_host")).alias("host")).distinct()
    listed = F.array(*[F.lit(s) for s in ("com.qx", "co.zz", "net.qx", "test", "qx")])
    first = F.get(F.filter(listed, lambda s: under(F.col("host"), s)), F.lit(0))
    return hosts.withColumn("provider", first).where("provider is not null").groupBy("provider").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (host_forms, host_statistics, host_flags, host_tokens, registered_domains, url_hosts, page_probe, row_labels, times, registration_ages, evidence_status, score_percentiles, provider_hits, crc_buckets)
}

#: CRC-32 by the table of its polynomial, which is built from it; ``crc_table`` goes into a WITH, ``crc_sql`` needs it beside the rows.
CRC_TABLE = """crc_table as (select list(c order by n) as crcs from (select n, list_reduce(list_concat([n], [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(256))::bigint as n)))"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, in DuckDB's SQL."""
    octets = f"[('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint for i in range(length(hex(encode({text}))) // 2)]"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


_HOSTS = f"(select distinct {host_sql('raw_host')} as host from ct_observations)"
_ENTROPY = "coalesce(round(list_sum([-(n / length({0})) * log2(n / length({0})) for n in [length({0}) - length(replace({0}, c, '')) for c in list_distinct(string_split({0}, ''))] if n > 0]), 6), 0)"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_TLD = "case when contains(host, '.') then regexp_extract(host, '[^.]*$') end"
_URL = "nullif(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*'), '^.*@', ''), ':[0-9]*$', '')), '')"
_SHAPED = f"""(select id, [ 'https://' || h || ':8443/a?b=http://c.d/#e', 'HTTP://user:pw@' || h, h || '/path:1', 'www.' || h || ':80/x', 'nodots'][id % 5 + 1] as u
  from (select id, {host_sql("raw_host")} as h from ct_observations))"""

ORACLES = {
    "host_forms": f"""select kafka_offset, {host_sql("domain")} as host, replace(rtrim({fold_sql("domain")}, '.'), '*.', '') as host_no_wildcards,
      regexp_full_match(trim(domain, ' \t\n\r\f\x0b'), '[-A-Za-z0-9._*]+') as is_host,
      case when contains({host_sql("domain")}, '.') then regexp_extract({host_sql("domain")}, '[^.]*$') end as last_label from stream_ct""",
    "host_statistics": f"""select host, length(host)::integer as length, {_COUNT.format("host", "[0-9]")}::integer as digits, {_COUNT.format("host", "-")}::integer as hyphens, {_COUNT.format("host", "[.]")}::integer as dots,
      round({_COUNT.format("host", "[0-9]")} / (length(host) + 1e-6), 6) as digit_ratio, round({_COUNT.format("host", "-")} / (length(host) + 1e-6), 6) as hyphen_ratio,
      {_ENTROPY.format("host")} as entropy, contains(host, 'xn--')::integer as xn_punycode, ({_COUNT.format("host", "[.]")} + 1)::integer as labels,
      length(regexp_extract(host, '[^.]*$'))::integer as tld_len from {_HOSTS}""",
    "host_flags": f"""select host, array_to_string([f for f in [case when length(host) > 25 then 'long' end, case when {_ENTROPY.format("host")} > 3.8 then 'entropy' end, case when {_COUNT.format("host", "-")} > 1 then 'hyphens' end,
        case when regexp_matches(host, '[0-9]') and {_COUNT.format("host", "[a-z]")} < 4 then 'digits' end] if f is not null], ',') as flags,
      coalesce({_TLD}, '') || ':' || case when {_COUNT.format("host", "-")} >= 3 then 'h' else 'l' end as family from {_HOSTS}""",
    "host_tokens": f"""select token, replace(token, 'rn', 'm') as collapsed, count(*) as n
      from (select regexp_replace(unnest(regexp_split_to_array(host, '[._-]')), '[^\\p{{L}}]', '', 'g') as token from {_HOSTS}) where token <> '' group by token""",
    "registered_domains": f"""select host, nullif(case when regexp_matches(host, '(^|[.])(com[.]qx|co[.]zz|net[.]qx)$') then regexp_extract(host, '[^.]+[.](com[.]qx|co[.]zz|net[.]qx)$')
      else regexp_extract(host, '[^.]+[.][^.]+$') end, '') as registered_domain from {_HOSTS}""",
    "url_hosts": f"""select id, {_URL.format("u")} as url_host, case when contains(x, '.') then x end as indicator_host from (
      select id, u, regexp_replace(regexp_replace(rtrim(case when contains(lower(u), '://') then {_URL.format("lower(u)")} else split_part(split_part(lower(u), '/', 1), ':', 1) end, '.'), '^[*][.]', ''), '^www[.]', '') as x
      from {_SHAPED})""",
    "page_probe": """select doc_id, title, password_field, sha256('200|' || coalesce(title, 'None') || '|' || case when password_field then 'True' else 'False' end) as fingerprint from (
      select doc_id, nullif(left(trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), 256), '') as title,
        coalesce(regexp_matches(text, '(?i)<input[^>]+type\\s*=\\s*[\"'']?password'), false) as password_field from documents)""",
    "row_labels": """select id, score, coalesce(model_used, 'none') || '@' || strftime(created_at, '%Y%m%dT%H%M%SZ') as tag
      from (select *, case when not isnan(risk_score) and not isinf(risk_score) then risk_score end as score from ct_observations)""",
    "times": f"""select kafka_offset, {_EPOCH} + to_microseconds(e) as event_time, {_EPOCH} + to_microseconds(p) as producer_time, p // 1000000 - e // 1000000 as latency_sec,
      {_EPOCH} + to_microseconds(e - e % 3600000000) as hour, strftime({_EPOCH} + to_microseconds(e), '%Y-%m-%d') as day
      from (select kafka_offset, {micros_sql("event_ts")} as e, {micros_sql("producer_ts")} as p from stream_ct)""",
    "registration_ages": f"""select id, case when nothing or whois_created is null then 0.0 else (epoch_us(timestamp '{NOW}') - epoch_us(whois_created))::double / 8.64e10::double end as age_days,
      case when nothing or whois_expires is null then 0.0 else (epoch_us(whois_expires) - epoch_us(timestamp '{NOW}'))::double / 8.64e10::double end as days_to_expiry,
      case when nothing then 0 else (whois_created is null)::integer end as created_isnull, case when nothing then 0 else (whois_expires is null)::integer end as expires_isnull
      from (select *, registrar is null and whois_status is null and whois_created is null and whois_expires is null as nothing from ct_observations)""",
    "evidence_status": """select id, event_type, case when json_valid(detail) then try_cast(json_extract_string(detail, '$.http_status') as integer) end as http_status,
      detail is not null and not json_valid(detail) as broken from evidence_events""",
    "crc_buckets": f"with {CRC_TABLE} select host, bucket, bucket < 1000 as sampled from (select host, {crc_sql('host')} % 10000 as bucket from {_HOSTS}, crc_table)",
    "score_percentiles": """select enrichment_level, round(quantile_cont(risk_score, 0.5), 6) as p50, round(quantile_cont(risk_score, 0.9), 6) as p90, round(quantile_cont(risk_score, 0.99), 6) as p99, count(*) as n
      from ct_observations where risk_score is not null and not isnan(risk_score) group by 1""",
    "provider_hits": f"""select provider, count(*) as n from (select case when regexp_matches(host, '(^|[.])com[.]qx$') then 'com.qx' when regexp_matches(host, '(^|[.])co[.]zz$') then 'co.zz'
      when regexp_matches(host, '(^|[.])net[.]qx$') then 'net.qx' when regexp_matches(host, '(^|[.])test$') then 'test' when regexp_matches(host, '(^|[.])qx$') then 'qx' end as provider from {_HOSTS})
      where provider is not null group by 1""",
}
