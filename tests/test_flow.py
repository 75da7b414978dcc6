import json
import os
import time

import pytest
from pyspark.sql import functions as F

from wardline.operators import campaigns, merging
from wardline.sources import feeds, sinks
from wardline.streaming.ingest import Liveness, Watchdog


def test_outbox_life_cycle(spark, tmp_path):
    box = sinks.Outbox(spark, str(tmp_path / "box"))
    assert box.pending() == box.seal() == 0 and box.replay(lambda _: True) == {"replayed": 0, "torn": 0, "kept": 0}
    box.append(spark.createDataFrame([(1,), (2,)], "v long").coalesce(1))
    box.append(spark.createDataFrame([(3,)], "v long").coalesce(1))
    torn = next(p for p in sorted((tmp_path / "box").iterdir())[0].iterdir() if p.name.startswith("part-") and p.stat().st_size)
    torn.write_text(torn.read_text() + '{"v": 9')
    (torn.parent / f".{torn.name}.crc").unlink()
    crashed = tmp_path / "box" / "open-99999999999999999999"
    crashed.mkdir()
    assert box.pending() == 4

    def failing(lines):
        raise OSError("receiver down")

    assert box.replay(failing) == {"replayed": 0, "torn": 0, "kept": 2} and box.pending() == 4
    order = []
    assert box.replay(lambda lines: order.append(sorted(r[0] for r in lines.collect())) is None) == {"replayed": 3, "torn": 1, "kept": 0}
    assert order == [['{"v":1}', '{"v":2}'], ['{"v":3}']] and box.pending() == 0 and crashed.exists()
    box.append(spark.createDataFrame([(4,)], "v long"))
    box.seal()
    now = int(time.time() * 1000)
    assert box.prune(7, now) == 0 and box.prune(7, now + 8 * 86_400_000) == 1 and crashed.exists()


def test_breaker():
    now = [0.0]
    b = feeds.Breaker(2, 300, lambda: now[0])
    b.told(False)
    assert b.state == "closed"
    b.told(False)
    assert b.state == "open"
    now[0] = 300
    assert b.state == "half_open"
    b.told(False)
    assert b.state == "open"
    now[0] = 700
    b.told(True)
    assert b.state == "closed" and b.bad == 0


def test_slow_calls_fail(spark):
    def fetch(k):
        import time

        time.sleep(5 if k == "slow" else 0)
        return k.upper()

    df = spark.createDataFrame([("a",), ("slow",), (None,), ("a",)], "k string")
    got = {r["k"]: (r["answer"], r["outcome"]) for r in feeds.look_up(df, "k", fetch, per_second=100, timeout=1, tasks=2).collect()}
    assert got == {"a": ("A", "ok"), "slow": (None, "error: TimeoutError")}


def test_feed_rules(spark, tmp_path):
    feed = tmp_path / "feed.csv"
    feed.write_text("# Last updated: 2026-08-05 10:00:00 (UTC)\n" + "".join(f'"{k}","2026-08-01","x","http://h{k}.test/a"\n' for k in range(3)))
    assert sorted(r["domain"] for r in feeds.malware_csv(spark, str(feed)).collect()) == ["h0.test", "h1.test", "h2.test"]
    assert feeds.demand_fresh(spark, str(feed), "2026-08-05 21:00:00") == "2026-08-05 10:00:00"
    with pytest.raises(ValueError, match="13.0 hours"):
        feeds.demand_fresh(spark, str(feed), "2026-08-05 23:00:00")
    doc = json.dumps({"Event": {"id": "7", "Galaxy": [{"name": "g1"}, {"x": 1}, {"name": "g2"}], "Attribute": [{"value": "a.test", "type": "domain"}]}})
    assert feeds.indicators(spark.createDataFrame([(doc,)], "value string")).first()["galaxies"] == "g1,g2"
    days = spark.createDataFrame([(f"2026-08-{d:02}",) for d in range(1, 11)] + [(None,)], "ingest_date string")
    assert sorted(r[0] for r in feeds.recent_partitions(days, "2026-08-08", 3).collect()) == ["2026-08-06", "2026-08-07", "2026-08-08"]
    for k in range(3):
        (tmp_path / f"f{k}.parquet").write_text("x")
        os.utime(tmp_path / f"f{k}.parquet", (1000 + [1, 4, 9][k],) * 2)
    assert [p.rsplit("/", 1)[1] for p in feeds.newest_files(spark, str(tmp_path), 2)] == ["f2.parquet", "f1.parquet"]


def test_pointer_is_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "latest.json")
    for k in range(3):
        sinks.write_file(spark, path, json.dumps({"k": k}))
        assert json.loads(open(path).read()) == {"k": k}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["latest.json"]
    spark.createDataFrame([(1, "2026-08-01"), (2, "2026-08-02")], "v int, ds string").write.partitionBy("ds").parquet(str(tmp_path / "days"))
    assert sinks.prune_days(spark, str(tmp_path / "days"), "2026-09-09", today="2026-08-02") == ["2026-08-01"]


def test_liveness_outlives_a_restart(spark, tmp_path):
    now, said = [100.0], []
    make = lambda: Liveness(spark, "q", str(tmp_path / "seen.json"), Watchdog(60, 100, lambda what, age: said.append(what)), lambda: now[0])
    a = make()
    assert a.look(5) == "fresh"
    now[0] = 200
    assert a.look(0) == "stale"
    now[0] = 250
    b = make()
    assert b.look(0) == "still_stale" and b.look(3) == "recovered" and said == ["stale", "recovered"]


def test_clusters_are_merged_and_never_split(spark):
    schema = "cluster_key string, brand string, day string, family string, n_members long, max_risk double, first_seen long, last_seen long"
    old = spark.createDataFrame([("a", "x", "d", "f", 2, 0.5, 5, 9), ("b", "x", "d", "g", 1, 0.9, None, None)], schema)
    new = spark.createDataFrame([("a", "x", "d", "f", 3, 0.8, 1, 7), ("b", "x", "d", "g", 1, 0.1, 4, 4), ("c", "y", "d", "f", 10, 1.0, 2, 3)], schema)
    got = {r["cluster_key"]: (r["n_members"], r["max_risk"], r["first_seen"], r["last_seen"], r["outcome"]) for r in campaigns.merge_clusters(old, new).collect()}
    assert got == {"a": (5, 0.8, 1, 9, "merged"), "b": (2, 0.9, 4, 4, "merged"), "c": (10, 1.0, 2, 3, "created")}
    assert {r["outcome"] for r in campaigns.merge_clusters(old, new.where("false")).collect()} == {"kept"}


def test_queue_life_cycle(spark):
    q = spark.createDataFrame([("a", "pending", 0), ("b", "processing", 1), ("c", "processing", 2), ("d", "failed", 3), (None, "pending", 0)], "k string, status string, attempts int")
    done = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "k string")
    assert {(r["k"], r["status"]) for r in merging.complete(q, done, "status", "k").collect()} == {("a", "pending"), ("b", "done"), ("c", "processing"), ("d", "failed"), (None, "pending")}
    assert {r["status"] for r in merging.recover_stale(q, "status").collect()} == {"pending", "failed"}
    kept, ledger = merging.failed_ledger(q, "status")
    assert kept.count() == 4 and [r["k"] for r in ledger.collect()] == ["d"]
    items = spark.createDataFrame([("a",), ("b",), ("d",), ("e",), (None,)], "k string")
    assert {r["k"] for r in merging.not_in_flight(items, q, "k", "status").collect()} == {"d", "e", None}


def test_composite_keys_meet_as_pairs(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1), (4, "b", None)], "id long, h string, t int")
    members = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (12, 1), (13, 4), (None, 1)], "c long, id long")
    wanted = spark.createDataFrame([("a", 2), ("b", 1), ("b", 1), ("b", None)], "h string, t int")
    assert {r[0] for r in merging.touched_parents(stored, wanted, ["h", "t"], members, "id", "c").collect()} == {11, 12}


def test_lineage(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert {tuple(r) for r in merging.lineage(rows, "s", ["a", "z"]).collect()} == {("a", 2, 0.5, False), ("b", 1, 0.25, False), (None, 1, 0.25, False), ("z", 0, 0.0, True)}
    with pytest.raises(ValueError):
        merging.lineage(rows.where("false"), "s", ["a"])


def test_plain_export(spark):
    clusters = spark.createDataFrame([(1, "x"), (2, None)], "id long, brand string")
    members = spark.createDataFrame([(1, "b.test", 0.5), (1, "a.test", None)], "id long, domain string, risk double").select("id", F.struct("domain", "risk").alias("indicator"))
    said = spark.createDataFrame([(1, 5, "benign"), (1, 7, "confirmed")], "cluster_id long, id long, verdict string")
    got = {r["id"]: json.loads(r["document"]) for r in sinks.export_plain(clusters, members, said, "2026-09-01").collect()}
    assert got[1]["disposition"] == {"verdict": "confirmed"} and [i["domain"] for i in got[1]["indicators"]] == ["a.test", "b.test"]
    assert got[2] == {"export_format": "json", "exported_at": "2026-09-01", "campaign": {"id": 2, "brand": None}, "disposition": None, "indicators": []}
