import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import schemas
from wardline.sources import feeds, sinks


def lines(tmp_path, name, *text):
    (tmp_path / name).write_text("\n".join(text))
    return str(tmp_path / name)


def test_certificates(spark):
    ok = json.dumps({"data": {"leaf_cert": {"all_domains": ["*.A.test", "bad host", "b.test.", "c"]}}})
    df = spark.createDataFrame([(ok,), ("{bad",), (None,), ("[]",)], "value string")
    assert [tuple(r) for r in feeds.certificates(df).orderBy("position").collect()] == [(0, "a.test", "test"), (2, "b.test", "test"), (3, "c", None)]
    assert [r["position"] for r in feeds.certificates(df, keep_one_in=2).orderBy("position").collect()] == [0, 2]


def test_broken_messages_have_reasons(spark):
    given = {'{"id":"1","domain":"a"}': None, "{bad": "broken_json", "[]": "not_an_object", "": "empty", "7": "not_an_object", '{"domain":"a"}': "no_id", '{"id":"1"}': "no_domain", '{"id":"2","domain":"b","event_ts":"later"}': None}
    df = spark.createDataFrame([(k,) for k in given] + [(None,)], "value string")
    got = {r["value"]: (r["reason"], r["valid"]) for r in feeds.parse_events(df).collect()}
    assert got == {k: (v, v is None) for k, v in given.items()} | {None: ("empty", False)}


def test_text_feeds(spark, tmp_path):
    urls = lines(tmp_path, "u.txt", "# list", "", "http://A.test/x", "  b.test:81/y ")
    assert {(r["url"], r["domain"]) for r in feeds.url_list(spark, urls).collect()} == {("http://A.test/x", "a.test"), ("b.test:81/y", "b.test")}
    csv = lines(tmp_path, "m.csv", "# Last updated: 2026-08-03 10:00:00 (UTC)", '"1","2026-08-03 09:00:00","http://c.test/a,b","online","","malware","t1,t2","l","r"')
    row = feeds.malware_csv(spark, csv).first()
    assert (row["domain"], row["tags"]) == ("c.test", "t1,t2") and feeds.feed_time(spark, csv) == "2026-08-03 10:00:00"
    silver = feeds.silver(feeds.malware_csv(spark, csv), "malicious", "csv").first()
    assert silver["label"] == "malicious" and str(silver["first_seen"]) == "2026-08-03 09:00:00"
    ranks = lines(tmp_path, "r.csv", "1,x.test", "2,y.test")
    assert [tuple(r) for r in feeds.ranked_list(spark, ranks).orderBy("rank").collect()] == [(1, "x.test"), (2, "y.test")]
    spooled = lines(tmp_path, "s.jsonl", '{"id":"1","domain":"a"}', "{bad", '{"id":"2","domain":"b","triage_score":0.5}')
    assert {r["id"] for r in feeds.spool(spark, spooled).where("id is not null").collect()} == {"1", "2"}


def test_indicator_documents(spark):
    doc = {"Event": {"id": "7", "Orgc": {"name": "o"}, "Tag": [{"name": "t1"}, {"Name": "t2"}], "Attribute": [{"type": "domain", "value": "a.test", "category": "c"}, {"Type": "url", "Value": "http://b.test"}, {"type": "md5", "value": "x"}]}}
    df = spark.createDataFrame([(json.dumps(doc),), ("{bad",), (json.dumps({"event": {"attribute": [{"type": "hostname", "value": "h.test"}]}}),), (None,)], "value string")
    got = {(r["indicator"], r["type"], r["tags"]) for r in feeds.indicators(df).collect()}
    assert got == {("a.test", "domain", "t1,t2"), ("http://b.test", "url", "t1,t2"), ("h.test", "hostname", None)}
    page = '<a href="x1.json">x1</a> 2026-08-03 10:00\n<a href="x2.json">x2</a> 2026-08-03 15:00 <a href="x3.json">x3</a> 2026-08-03 12:30'
    index = feeds.event_index(spark.createDataFrame([(page,)], "h string"), "h", "2026-08-03 11:00:00")
    assert [r["url"] for r in index.collect()] == ["x3.json", "x1.json"]


def test_expectations(spark):
    df = spark.createDataFrame([(f"http://h{i}.test",) for i in range(60)], "url string")
    assert feeds.expectations(df, "url", pattern="^https?://")["rows"] == 60
    for bad, words in ((df.limit(3), "rows"), (df.unionByName(df), "repeated"), (df.unionByName(spark.createDataFrame([(None,)], "url string")), "null")):
        with pytest.raises(ValueError, match=words):
            feeds.expectations(bad, "url")
    with pytest.raises(ValueError, match="no column"):
        feeds.expectations(df, "gone")


def test_fetch_policy():
    calls = []

    def get(*answers):
        left = list(answers)

        def call():
            calls.append(1)
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return call

    assert feeds.fetch(get((500, ""), OSError("x"), (200, "body")), pause=0) == "body"
    calls.clear()
    with pytest.raises(RuntimeError, match="404"):
        feeds.fetch(get((404, ""), (200, "body")), pause=0)
    assert len(calls) == 1
    with pytest.raises(RuntimeError, match=r"no \*\*\* here"):
        feeds.fetch(get(*[OSError("no key here")] * 3), pause=0, secrets=("key",))
    with pytest.raises(RuntimeError):
        feeds.fetch(get(*[(200, "short")] * 3), least=10, pause=0)


def test_snapshots_and_pointer(spark, tmp_path):
    folder = str(tmp_path / "snap")
    df = spark.range(3)
    a = sinks.publish(df, folder, "001")
    sinks.publish(df, folder, "002", move_pointer=False)
    assert feeds.latest_snapshot(spark, folder) == a and feeds.latest_snapshot(spark, folder, pointer="none").endswith("snapshot-002")
    assert feeds.latest_snapshot(spark, folder, override="x") == "x"
    with pytest.raises(ValueError, match="not published"):
        sinks.audit_then_publish(df, folder, "003", [("small", F.col("id") < 2)])
    assert feeds.latest_snapshot(spark, folder) == a
    c = sinks.audit_then_publish(df, folder, "004", [("small", F.col("id") < 5)])
    assert feeds.latest_snapshot(spark, folder) == c and feeds.freshness(spark.read.parquet(c)).first()["rows"] == 3
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        feeds.latest_snapshot(spark, str(tmp_path / "none"))


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2026-08-01"), (2, "2026-08-02"), (3, "2026-08-09")], "v int, ds string")
    sinks.append_by_day(df, path)
    sinks.replace_partitions(df.where("v = 2").withColumn("v", F.lit(9)), path, ["ds"])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3, 9]
    assert sinks.prune_days(spark, path, "2026-08-05") == ["2026-08-01", "2026-08-02"]
    assert spark.read.parquet(path).count() == 3
    sinks.prune_days(spark, path, "2026-08-05", dry_run=False)
    assert [r["v"] for r in spark.read.parquet(path).collect()] == [3]
    dated = spark.createDataFrame([("bad", "2026-08-04"), ("2026-08-03 10:00:00", "2026-08-04")], "first_seen string, ingest_date string")
    assert sorted(str(r[0]) for r in dated.select(feeds.seen_date(dated)).collect()) == ["2026-08-03", "2026-08-04"]


def test_logs_and_summaries(spark, tmp_path):
    df = spark.range(1)
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.write_summary(df, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "sum")).count() == 1


def test_export_is_valid_and_stable(spark):
    clusters = spark.createDataFrame([(1, "brand"), (2, None)], "id long, brand string")
    members = spark.createDataFrame([(1, "a.test"), (1, "b'.test"), (1, "a.test"), (2, "c.test"), (2, None), (3, "d.test")], "id long, host string")
    rows = sinks.export_campaigns(clusters, members, "2026-08-03T00:00:00Z").orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2]
    bundle = json.loads(rows[0]["document"])
    kinds = [o["type"] for o in bundle["objects"]]
    assert kinds == ["campaign", "indicator", "indicator", "relationship", "relationship"]
    ids = {o["id"] for o in bundle["objects"]}
    assert all({o["source_ref"], o["target_ref"]} <= ids for o in bundle["objects"] if o["type"] == "relationship")
    assert rows == sinks.export_campaigns(clusters, members.repartition(3), "2026-08-03T00:00:00Z").orderBy("id").collect()


def test_conform(spark):
    df = spark.createDataFrame([("1", "x", 2)], "A string, extra string, b int")
    out, added = schemas.conform(df, T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.DoubleType())]), {"c": 0.5})
    assert added == ["c"] and tuple(out.first()) == (1, "2", 0.5)
    assert schemas.conform(spark.createDataFrame([("no",)], "a string"), T.StructType([T.StructField("a", T.IntegerType())]))[0].first()["a"] is None
    assert df.select(feeds.indicator_column(df)).first()[0] is None


def test_incremental_and_union(spark):
    df = spark.range(10)
    assert feeds.read_since(df, "id", 6).count() == 3 and feeds.read_since(df, "id", None).count() == 10
    both = feeds.labels([spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(2, "b")], "id int, y string")])
    assert both.columns == ["id", "x", "y"] and both.count() == 2


def test_tolerant_read(spark, tmp_path):
    p = tmp_path / "many"
    spark.createDataFrame([(1, "a")], "id int, x string").coalesce(1).write.parquet(str(p))
    spark.createDataFrame([(2, "b")], "id int, y string").coalesce(1).write.mode("append").parquet(str(p))
    assert set(feeds.read_tolerant(spark, str(p)).columns) == {"id", "x", "y"}


def test_look_up_stops_after_failures(spark):
    def fetcher(k):
        if k.startswith("bad"):
            raise OSError("down")
        return k.upper()

    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert [tuple(r) for r in feeds.look_up(df, "k", fetcher, per_second=1000).collect()] == [("a", "A", "ok")]
    bad = spark.createDataFrame([(f"bad{i}",) for i in range(12)], "k string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [r["outcome"] for r in feeds.look_up(bad, "k", fetcher, per_second=1000, failures=3).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.count("error: down") == 3 and got.count("skipped") == 9


def test_bookmarks(spark, tmp_path):
    path = str(tmp_path / "bookmark.json")
    df = spark.createDataFrame([("2026-08-03 10:00:00",), ("2026-08-03 11:00:00",), (None,)], "t string").selectExpr("cast(t as timestamp) as t")
    assert sinks.bookmark(spark, path) is None
    sinks.advance_bookmark(df, "t", path)
    assert sinks.bookmark(spark, path) == "2026-08-03 11:00:00"
    assert sinks.advance_bookmark(df.where("false"), "t", path) is None and sinks.bookmark(spark, path) == "2026-08-03 11:00:00"
    assert feeds.read_since(df, "t", sinks.bookmark(spark, path)).count() == 0 and feeds.read_since(df, "t", "2026-08-03 10:30:00").count() == 1


def test_scratch_tables_are_purged(spark):
    from wardline.scratch import materialize, purge

    _, path = materialize(spark.range(2), "kept")
    now = 4_102_444_800_000
    assert path.rsplit("/", 1)[1] in purge(spark, 1, now) and purge(spark, 1, now) == []


def test_command_line(spark, tmp_path, capsys):
    from wardline.__main__ import main

    assert main([]) == 2 and "p4_found" in capsys.readouterr().out
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert main(["p4_found", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
        assert spark.read.parquet(str(tmp_path / "out")).columns == ["kafka_offset"]


def test_kafka_rows(spark):
    row = sinks.kafka_rows(spark.createDataFrame([("a.test", 1)], "domain string, n int")).first()
    assert row["key"] == "a.test" and json.loads(row["value"]) == {"domain": "a.test", "n": 1}
