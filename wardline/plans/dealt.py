"""Queries of the general data problems: p2, p3, p4 and p5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.hosts import folded, present, present_host
from wardline.functions.times import from_micros, micros, text_micros
from wardline.operators import delivery, dense, late, orphans
from wardline.scratch import materialize
from wardline.streaming.ingest import CorrectedCounts
from wardline.tables import table


def _routed(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "stream_ct").select("kafka_offset", "id", "domain", "source", "event_ts", "producer_ts", "ingest_ts")
    kept = delivery.deliver_once(log)
    return late.route(kept, text_micros(F.col("event_ts")), text_micros(F.col("producer_ts")))


def _replayed(spark: SparkSession, d: str) -> CorrectedCounts:
    log = table(spark, d, "stream_ct").select("kafka_offset", "id", "domain", "source", "event_ts", "producer_ts", "ingest_ts")
    kept = delivery.deliver_once(log).select("kafka_offset", present(F.col("source")).alias("source"), text_micros(F.col("event_ts")).alias("e"), text_micros(F.col("producer_ts")).alias("p"))
    records, path = materialize(kept, "kept-messages")
    return CorrectedCounts(spark, f"{path}-stream", ["source"], ["kafka_offset"]).replay(records, F.col("e"), F.col("p"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Kept messages that arrive after their hour's first result: those by which the keyed state was corrected, and those it diverted."""
    counts = _replayed(spark, d)
    corrections = counts.corrections().select("kafka_offset", F.lit("corrects").alias("outcome"))
    return corrections.unionByName(counts.rejected().select("kafka_offset", F.lit("rejected").alias("outcome")))


def p2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The stream's counts per source and hour when all messages are read."""
    return _replayed(spark, d).current().select("source", from_micros(F.col("period_start")).alias("hour"), "n", "n_corrections")


def p2_stream_upserts(spark: SparkSession, d: str) -> DataFrame:
    """What a sink holds that upserted all that the stream emitted; equal to its counts."""
    return _replayed(spark, d).upserted().select("source", from_micros(F.col("period_start")).alias("hour"), "n", "n_corrections")


def p2_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts per source, corrected up to the cut-off, with the rejected apart."""
    per = late.current(_routed(spark, d).withColumn("source", present(F.col("source"))), ["source"])
    return per.select("source", from_micros(F.col("period_start")).alias("hour"), "n", "n_corrections", "n_rejected")


def p2_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Every result that was emitted for an hour and source, in revisions."""
    log = late.upserts(_routed(spark, d).withColumn("source", present(F.col("source"))), ["source"])
    return log.select("source", from_micros(F.col("period_start")).alias("hour"), "revision", "emitted_at", "n", "n_corrections")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Domains and brands that hold at least 5 of 100 rows of their table."""
    domains = dense.heavy_keys(table(spark, d, "ct_observations"), present_host(F.col("registered_domain")))
    brands = dense.heavy_keys(table(spark, d, "campaign_clusters"), present(F.col("target_brand")))
    return domains.select(F.lit("registered_domain").alias("field"), F.col("key").alias("key_value")).unionByName(
        brands.select(F.lit("target_brand").alias("field"), F.col("key").alias("key_value"))
    )


def p3_domains(spark: SparkSession, d: str) -> DataFrame:
    """Rows and risk scores of every registered domain; missing domains under null."""
    per = dense.per_key(table(spark, d, "ct_observations"), present_host(F.col("registered_domain")), F.col("risk_score"))
    return per.select(F.col("key").alias("registered_domain"), "n", F.col("n_valued").alias("n_scored"), F.round("total", 6).alias("risk_total"), F.col("least").alias("risk_least"), F.col("most").alias("risk_most"))


def p3_brands(spark: SparkSession, d: str) -> DataFrame:
    """Campaigns and their observation counts of every brand; missing brands under null."""
    per = dense.per_key(table(spark, d, "campaign_clusters"), present(F.col("target_brand")), F.col("observation_count"), scale=1)
    return per.select(F.col("key").alias("target_brand"), "n", F.col("total").cast("long").alias("observations"), F.col("most").cast("long").alias("largest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of messages beyond the one that is kept."""
    return delivery.copies(table(spark, d, "stream_ct"))


def p4_once(spark: SparkSession, d: str) -> DataFrame:
    """The log with one row per message."""
    log = table(spark, d, "stream_ct")
    return delivery.deliver_once(log).select("kafka_offset", "batch_id", "id", "domain", "source", "ingest_ts")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "campaign_clusters")
    deletions = table(spark, d, "cluster_deletions")
    analysts = table(spark, d, "analysts")
    by_id = orphans.parent_intervals(F.col("id"), micros(clusters, "created_at"), clusters, F.col("cluster_id"), micros(deletions, "deleted_at"), deletions)
    by_name = orphans.parent_intervals(folded(F.col("username")), micros(analysts, "created_at"), analysts)

    def refs(name: str, key: Column, at: str) -> DataFrame:
        rows = table(spark, d, name)
        return rows.select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), key.alias("key"), micros(rows, at).alias("at"))

    to_clusters = refs("cluster_members", F.col("cluster_id"), "created_at").unionByName(refs("evidence_events", F.col("cluster_id"), "created_at"))
    to_analysts = refs("campaign_clusters", present(F.col("assignee")), "updated_at")
    return orphans.orphans(to_clusters, by_id).drop("key").unionByName(orphans.orphans(to_analysts, by_name).drop("key"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References that hold no existing record, or one created later."""
    return _orphans(spark, d).select("table_name", "row_id", "kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, UTC day of the reference and kind."""
    day = F.date_format(from_micros(F.col("at")), "yyyy-MM-dd").alias("day")
    return _orphans(spark, d).groupBy("table_name", day, "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_hourly, p2_upserts, p2_stream, p2_stream_upserts, p3_found, p3_domains, p3_brands, p4_found, p4_once, p5_found, p5_report)}

_HOST = "regexp_replace(rtrim(lower(trim({0}, ' \t\n\r\f\x0b')), '.'), '^\\*\\.', '')"
_FOLD = "lower(trim({0}, ' \t\n\r\f\x0b'))"
_MISSING = "({0} is null or lower(trim({0}, ' \t\n\r\f\x0b')) in ('', 'nan', 'none'))"


def host_sql(c: str) -> str:
    """The cleaned host in DuckDB's SQL."""
    return _HOST.format(c)


def fold_sql(c: str) -> str:
    """Trimmed and lower-cased in DuckDB's SQL."""
    return _FOLD.format(c)


def missing_sql(c: str) -> str:
    """Whether a text is missing, in DuckDB's SQL."""
    return _MISSING.format(c)


def micros_sql(c: str) -> str:
    """Microseconds of a usable time written as text, in DuckDB's SQL."""
    t = f"trim({c}, ' \t\n\r\f\x0b')"
    return (
        f"case when regexp_full_match({t}, '[0-9]{{13}}') then try_cast({t} as bigint) * 1000"
        f" when regexp_full_match({t}, '[0-9]{{10}}') then try_cast({t} as bigint) * 1000000"
        f" when regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?[ ]?([Zz]|[+-][0-9]{{2}}(:?[0-9]{{2}})?)?')"
        f" then epoch_us(try_cast(case when regexp_matches({t}, ':[0-9]{{2}}.*([Zz]|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') then {t} else {t} || 'Z' end as timestamptz)) end"
    )


_KEPT = f"""with ranked as (
  select *, row_number() over (
    partition by case when trim(id, ' \t\n\r\f\x0b') <> '' then trim(id, ' \t\n\r\f\x0b') end,
                 case when trim(id, ' \t\n\r\f\x0b') <> '' then coalesce({host_sql("domain")}, '') else kafka_offset::varchar end
    order by ingest_ts, kafka_offset) as place
  from stream_ct)"""
_TIMED = f"""{_KEPT}, timed as (
  select kafka_offset, case when not {missing_sql("source")} then {fold_sql("source")} end as source,
         {micros_sql("event_ts")} as e, {micros_sql("producer_ts")} as p from ranked where place = 1),
routed as (
  select kafka_offset, source, e - e % 3600000000 as h, p,
         case when p - (e - e % 3600000000) - 3600000000 <= 600000000 then 'on_time'
              when p - (e - e % 3600000000) - 3600000000 <= 86400000000 then 'corrects' else 'rejected' end as outcome
  from timed where e is not null and p is not null)"""
_EPOCH = "timestamp '1970-01-01 00:00:00'"
_HEAVY = """select '{field}' as field, k as key_value from (select {key} as k from {table} where not {missing}) where k <> ''
group by k having count(*) * 20 >= (select count(*) from {table})"""
_ORPHANS = f"""with gone as (select distinct cluster_id from cluster_deletions),
people as (select {fold_sql("username")} as u, min(created_at) as c from analysts group by 1),
refs as (select 'cluster_members' as table_name, id as row_id, cluster_id, created_at as at from cluster_members
         union all select 'evidence_events', id, cluster_id, created_at from evidence_events),
found as (
  select r.table_name, r.row_id, r.at, case when c.id is null and g.cluster_id is not null then 'deleted'
         when c.id is null then 'missing' when c.created_at > r.at then 'late' end as kind
  from refs r left join campaign_clusters c on c.id = r.cluster_id left join gone g on g.cluster_id = r.cluster_id
  where r.cluster_id is not null
  union all
  select 'campaign_clusters', k.id, k.updated_at, case when p.u is null then 'missing' when p.c > k.updated_at then 'late' end
  from campaign_clusters k left join people p on p.u = {fold_sql("k.assignee")} where not {missing_sql("k.assignee")})"""

_COUNTS = f"""{_TIMED} select source, {_EPOCH} + to_microseconds(h) as hour, count(*) as n, count(*) filter (where outcome = 'corrects') as n_corrections
  from routed where outcome <> 'rejected' group by source, h"""

ORACLES = {
    "p2_stream": _COUNTS,
    "p2_stream_upserts": _COUNTS,
    "p2_found": f"{_TIMED} select kafka_offset, outcome from routed where outcome <> 'on_time'",
    "p2_hourly": f"""{_TIMED} select source, {_EPOCH} + to_microseconds(h) as hour,
      count(*) filter (where outcome <> 'rejected') as n, count(*) filter (where outcome = 'corrects') as n_corrections,
      count(*) filter (where outcome = 'rejected') as n_rejected from routed group by source, h""",
    "p2_upserts": f"""{_TIMED}, steps as (
      select source, h, case when outcome = 'on_time' then 0 else (p - h - 4200000000 + 3599999999) // 3600000000 end as s,
             count(*) as n, count(*) filter (where outcome = 'corrects') as c from routed where outcome <> 'rejected' group by all)
      select source, {_EPOCH} + to_microseconds(h) as hour,
        (row_number() over w - 1)::integer as revision, {_EPOCH} + to_microseconds(h + 4200000000 + s * 3600000000) as emitted_at,
        (sum(n) over w)::bigint as n, (sum(c) over w)::bigint as n_corrections
      from steps window w as (partition by source, h order by s)""",
    "p3_found": _HEAVY.format(field="registered_domain", key=host_sql("registered_domain"), table="ct_observations", missing=missing_sql("registered_domain"))
    + " union all "
    + _HEAVY.format(field="target_brand", key=fold_sql("target_brand"), table="campaign_clusters", missing=missing_sql("target_brand")),
    "p3_domains": f"""select case when not {missing_sql("registered_domain")} then nullif({host_sql("registered_domain")}, '') end as registered_domain,
      count(*) as n, count(r) as n_scored, round(sum(round(r * 1000000)) / 1000000, 6) as risk_total, min(r) as risk_least, max(r) as risk_most
      from (select registered_domain, case when not isnan(risk_score) then risk_score end as r from ct_observations) group by 1""",
    "p3_brands": f"""select case when not {missing_sql("target_brand")} then {fold_sql("target_brand")} end as target_brand,
      count(*) as n, sum(observation_count)::bigint as observations, max(observation_count)::bigint as largest from campaign_clusters group by 1""",
    "p4_found": f"{_KEPT} select kafka_offset from ranked where place > 1",
    "p4_once": f"{_KEPT} select kafka_offset, batch_id, id, domain, source, ingest_ts from ranked where place = 1",
    "p5_found": f"{_ORPHANS} select table_name, row_id, kind from found where kind is not null",
    "p5_report": f"{_ORPHANS} select table_name, strftime(found.at, '%Y-%m-%d') as day, kind, count(*) as n from found where kind is not null group by all",
}
