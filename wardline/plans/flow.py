"""Queries that run the test tables through streams, sinks and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.hosts import present
from wardline.functions.times import from_micros, micros
from wardline.plans.analytics import present_sql
from wardline.plans.dealt import micros_sql
from wardline.scratch import materialize, scratch_path
from wardline.sources import feeds, sinks
from wardline.streaming import ingest
from wardline.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stream_ct").select("id", "domain", "tld", "event_ts", "producer_ts", "source", "triage_score", "triage_reasons")


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """K1-K2, ST1-ST4, F1: the log as JSON lines through the stream: identifiers in the table, once each; dead letters by reason; messages without usable time."""
    base = scratch_path(spark, "ingest")
    _events(spark, d).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{base}/in")
    for q in ingest.ingest(ingest.outbox(spark, f"{base}/in"), f"{base}/out", f"{base}/dead", f"{base}/checkpoint", trigger={"availableNow": True}):
        q.awaitTermination()
    kept = spark.read.schema("id string, ds date, batch int").parquet(f"{base}/out").groupBy(F.lit("table").alias("place"), F.col("id").alias("key")).agg(F.count("*").alias("n"))
    parts = [spark.read.schema("reason string").parquet(f"{base}/{k}").groupBy(F.lit(k).alias("place"), F.col("reason").alias("key")).agg(F.count("*").alias("n")) for k in ("dead", "dead_untimed")]
    return kept.unionByName(parts[0]).unionByName(parts[1])


def outbox_replayed(spark: SparkSession, d: str) -> DataFrame:
    """K6, ST6: messages that waited in the outbox, a first receiver down, a second one acknowledging; nothing is left behind."""
    base = scratch_path(spark, "outbox")
    box = sinks.Outbox(spark, f"{base}/box")
    log = table(spark, d, "stream_ct").select("kafka_offset", "id", "domain")
    for k in range(3):
        box.append(log.where(F.pmod("kafka_offset", F.lit(3)) == k))
    box.replay(lambda _: False)
    got = box.replay(lambda lines: lines.write.mode("append").parquet(f"{base}/sent") is None)
    sent = spark.read.schema("value string").parquet(f"{base}/sent").select(F.from_json("value", "kafka_offset long, id string, domain string").alias("e")).select("e.*")
    return sent.withColumn("left_behind", F.lit(box.pending() + got["torn"] + got["kept"]).cast("long"))


def published_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels checked, published as a snapshot and read back by its pointer, with a second version that fails its check and stays unpublished."""
    base = scratch_path(spark, "labels")
    rows = table(spark, d, "ct_observations").select("id", present(F.col("source")).alias("source"), "risk_label_final")
    sinks.audit_then_publish(rows, base, "1", [("id", F.col("id").isNotNull())])
    try:
        sinks.audit_then_publish(rows, base, "2", [("label", F.col("risk_label_final").isNotNull())])
    except ValueError:
        pass
    return spark.read.schema(rows.schema).parquet(feeds.latest_snapshot(spark, base))


def partition_days(spark: SparkSession, d: str) -> DataFrame:
    """Messages in partitions by day, one day replaced, old days pruned by name, the last three days read back."""
    base = scratch_path(spark, "days")
    rows = table(spark, d, "stream_ct")
    dated = rows.select("kafka_offset", F.date_format(from_micros(micros(rows, "ingest_ts")), "yyyy-MM-dd").alias("ds"))
    dated, _ = materialize(dated, "dated")
    sinks.append_by_day(dated, base)
    sinks.replace_partitions(dated.where("ds = '2026-08-20'").withColumn("kafka_offset", -F.col("kafka_offset")), base, ["ds"])
    sinks.prune_days(spark, base, "2026-08-12", dry_run=False)
    stored = spark.read.schema("kafka_offset long, ds string").parquet(base)
    per = stored.groupBy("ds").agg(F.count("*").alias("n"), F.min("kafka_offset").alias("least"))
    recent = feeds.recent_partitions(stored, "2026-08-20", 3, "ds").select("ds").distinct().withColumn("recent", F.lit(True))
    return per.join(recent, "ds", "left").select("ds", "n", "least", F.coalesce("recent", F.lit(False)).alias("recent"))


QUERIES = {f.__name__: f for f in (ingested, outbox_replayed, published_labels, partition_days)}

_E = micros_sql("event_ts")
ORACLES = {
    "ingested": f"""select distinct 'table' as place, id as key, 1::bigint as n from stream_ct where id is not null and domain is not null and {_E} is not null
      union all select 'dead', case when id is null then 'no_id' else 'no_domain' end, count(*) from stream_ct where id is null or domain is null group by 2
      union all select 'dead_untimed', 'no_time', count(*) from stream_ct where id is not null and domain is not null and {_E} is null having count(*) > 0""",
    "outbox_replayed": "select kafka_offset, id, domain, 0::bigint as left_behind from stream_ct",
    "published_labels": f"select id, {present_sql('source')} as source, risk_label_final from ct_observations",
    "partition_days": """select ds, count(*) as n, min(case when ds = '2026-08-20' then -kafka_offset else kafka_offset end) as least, ds between '2026-08-18' and '2026-08-20' as recent
      from (select kafka_offset, strftime(ingest_ts, '%Y-%m-%d') as ds from stream_ct) where ds >= '2026-08-12' group by 1""",
}
