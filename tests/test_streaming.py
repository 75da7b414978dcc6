import json

from pyspark.sql import functions as F

from wardline.operators.triage import Rules
from wardline.sources import sinks
from wardline.streaming import ingest


def test_ingest_routes_and_deduplicates(spark, tmp_path):
    ingest.configure(spark)
    src, out, dead, spool, check = (str(tmp_path / x) for x in ("in", "out", "dead", "spool", "check"))
    msg = lambda i, d, t: json.dumps({"id": i, "domain": d, "event_ts": t, "producer_ts": t, "source": "certstream"})
    values = [msg("1", "paypal-login.tk", "2026-08-03T10:00:00Z"), msg("1", "paypal-login.tk", "2026-08-03T10:00:05Z"), msg("2", "verify.tk", "2026-08-03T10:01:00Z"), "{bad", "", None, msg(None, "x", "2026-08-03T10:00:00Z"), msg("3", "plain.test", "never")]
    spark.createDataFrame([(v,) for v in values], "value string").withColumn("ingest_ts", F.lit("2026-08-03 10:02:00").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("value string, ingest_ts timestamp").parquet(src)
    for q in ingest.ingest(stream, out, dead, check, {"availableNow": True}, Rules(pass_threshold=0.4, sample_rate=1.0), spool):
        q.awaitTermination(120)
    assert [(r["id"], r["decision"]) for r in spark.read.parquet(out).collect()] == [("1", "forward")]
    assert [r["id"] for r in spark.read.parquet(spool).collect()] == ["2"]
    assert sorted(r["reason"] for r in spark.read.parquet(dead).collect()) == ["broken_json", "empty", "empty", "no_id"]
    sinks.reset_stream(spark, dead, f"{check}/dead")
    import os

    assert not os.path.exists(f"{dead}/_spark_metadata") and not os.path.exists(f"{check}/dead")


def test_outbox_replay(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.jsonl").write_text('{"id":"1","domain":"a.test","event_ts":"2026-08-03T10:00:00Z"}\n{"id":"1","domain":"a.test","event_ts":"2026-08-03T10:00:00Z"}\n{bad\n')
    out, dead, check = (str(tmp_path / x) for x in ("out", "dead", "check"))
    for q in ingest.ingest(ingest.outbox(spark, str(box), 1), out, dead, check, {"availableNow": True}):
        q.awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(out).collect()] == ["1"] and spark.read.parquet(dead).count() == 1


def test_backoff():
    wait, seen = 0.0, []
    for _ in range(7):
        wait = ingest.backoff(1, wait)
        seen.append(wait)
    assert seen == [2, 4, 8, 16, 32, 60, 60] and ingest.backoff(31, 60) == 0


def test_watchdog():
    said = []
    dog = ingest.Watchdog(60, 300, lambda what, age: said.append(what))
    looks = [(0, 10), (0, 100), (0, 200), (0, 450), (500, 510), (500, 520)]
    assert [dog.look(a, b) for a, b in looks] == ["fresh", "stale", "still_stale", "still_stale", "recovered", "fresh"]
    assert said == ["stale", "still_stale", "recovered"]


def test_nothing_is_lost_silently(spark, tmp_path):
    import time

    src, out, dead, check = (str(tmp_path / x) for x in ("in", "out", "dead", "check"))
    msg = lambda i, t: (json.dumps({"id": i, "domain": f"{i}.test", "event_ts": t, "producer_ts": t, "source": "certstream"}),)
    batches = [[msg("1", "2026-08-03T12:00:00Z"), msg("2", "never"), msg("3", None)], [msg("4", "2026-08-03T12:05:00Z")], [msg("5", "2026-08-03T09:00:00Z"), msg("6", "2026-08-03T12:06:00Z")]]
    dropped = []
    for rows in batches:
        spark.createDataFrame(rows, "value string").withColumn("ingest_ts", F.lit("2026-08-03 12:10:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("value string, ingest_ts timestamp").parquet(src)
        for q in ingest.ingest(stream, out, dead, check, {"availableNow": True}, tell_dropped=dropped.append):
            q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["1", "4", "6"]
    letters = spark.read.parquet(f"{dead}_untimed").collect()
    assert sorted((json.loads(r["value"])["id"], r["reason"]) for r in letters) == [("2", "no_time"), ("3", "no_time")]
    for _ in range(50):  # listeners hear of a batch a little later
        if dropped:
            break
        time.sleep(0.2)
    assert dropped == [1]
