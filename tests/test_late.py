import datetime as dt
import random

from pyspark.sql import functions as F

from tests.oracle import plan_of
from wardline.functions.times import HOUR, MINUTE, text_micros
from wardline.operators import late
from wardline.streaming.ingest import CorrectedCounts


def test_boundaries(spark):
    end = 10 * HOUR
    rows = [(1, end - 1, end), (2, end - 1, end + 10 * MINUTE), (3, end - 1, end + 10 * MINUTE + 1), (4, end - 1, end + 24 * HOUR), (5, end - 1, end + 24 * HOUR + 1), (6, end - 1, 0), (7, None, 1), (8, 1, None), (9, end, end + HOUR)]
    df = spark.createDataFrame(rows, "k long, e long, a long").withColumn("outcome", F.lit("old"))
    got = {r["k"]: r["outcome"] for r in late.route(df, F.col("e"), F.col("a")).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "corrects", 4: "corrects", 5: "rejected", 6: "on_time", 9: "on_time"}


def test_negative_times_have_periods(spark):
    df = spark.createDataFrame([(-1, -1)], "e long, a long")
    assert late.route(df, F.col("e"), F.col("a")).first()["period_start"] == -HOUR


def test_upserts_end_at_the_current_state(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None]), rnd.randrange(5 * HOUR), 0) for _ in range(500)]
    rows = [(s, e, e + rnd.choice([0, HOUR, 5 * HOUR, 23 * HOUR, 40 * HOUR])) for s, e, _ in rows]
    routed = late.route(spark.createDataFrame(rows, "s string, e long, a long"), F.col("e"), F.col("a"))
    last = {(r["s"], r["period_start"]): (r["n"], r["n_corrections"]) for r in sorted(late.upserts(routed, ["s"]).collect(), key=lambda r: r["revision"])}
    now = {(r["s"], r["period_start"]): (r["n"], r["n_corrections"]) for r in late.current(routed, ["s"]).collect()}
    assert last == {k: v for k, v in now.items() if v[0]}
    assert sum(r["n"] + r["n_rejected"] for r in late.current(routed, ["s"]).collect()) == 500
    assert late.upserts(routed.where("false"), ["s"]).count() == 0 == late.current(routed.where("false"), ["s"]).count()


def test_stream_equals_replay(spark, tmp_path):
    rnd = random.Random(4)
    start = dt.datetime(2026, 8, 3)
    rows = []
    for k in range(600):
        e = start + dt.timedelta(minutes=rnd.randrange(3000))
        a = e + dt.timedelta(minutes=rnd.choice([0, 1, 90, 600, 1300, 2000]))
        rows.append((k, rnd.choice(["x", "y", None]), e.isoformat() + "Z", a.isoformat() + "Z"))
    rnd.shuffle(rows)
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i * 150 : (i + 1) * 150], "k long, source string, e string, a string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k long, source string, e string, a string").option("maxFilesPerTrigger", 1).parquet(str(src))
    counts = CorrectedCounts(spark, str(tmp_path / "out"), ["source"])
    counts.start(stream, text_micros(F.col("e")), text_micros(F.col("a"))).awaitTermination(120)
    routed = late.route(spark.read.parquet(str(src)), text_micros(F.col("e")), text_micros(F.col("a")))
    want = {(r["source"], r["period_start"], r["n"], r["n_corrections"]) for r in late.current(routed, ["source"]).collect() if r["n"]}
    assert {(r["source"], r["period_start"], r["n"], r["n_corrections"]) for r in counts.current().collect()} == want
    assert counts.rejected().count() == routed.where("outcome = 'rejected'").count() > 0
    assert counts.upserts().select("batch").distinct().count() == 4


def test_last_upserts_of_retired_periods_are_whole(spark, tmp_path):
    at = lambda h: (dt.datetime(2026, 8, 3) + dt.timedelta(hours=h)).isoformat() + "Z"
    # the first two batches retire the first hour, the others deliver records of it that arrived within its cut-off
    batches = [[("x", at(0), at(0)), ("x", at(0.5), at(0.6)), (None, at(0.2), at(3))], [("x", at(60), at(60))], [("x", at(0.1), at(20)), (None, at(0.1), at(0.2))], [("x", at(0.3), at(22)), ("y", at(0.3), at(1))]]
    src = tmp_path / "in"
    src.mkdir()
    counts = CorrectedCounts(spark, str(tmp_path / "out"), ["source"])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "source string, e string, a string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("source string, e string, a string").parquet(str(src))
        counts.start(stream, text_micros(F.col("e")), text_micros(F.col("a"))).awaitTermination(120)
        assert counts.upserts().agg(F.max("batch")).first()[0] == i
    last = {(r["source"], r["period_start"]): (r["n"], r["n_corrections"]) for r in sorted(counts.upserts().collect(), key=lambda r: r["batch"])}
    assert last == {(r["source"], r["period_start"]): (r["n"], r["n_corrections"]) for r in counts.current().collect()}
    assert sorted(last.values()) == [(1, 0), (1, 0), (2, 1), (4, 2)]


def test_current_is_the_last_revision(spark):
    rows = [("a", 0, HOUR), ("a", 1, 3 * HOUR), ("a", 2, 30 * HOUR), ("b", 0, 30 * HOUR), (None, 5, 25 * HOUR), (None, 6, 25 * HOUR + 1)]
    routed = late.route(spark.createDataFrame(rows, "s string, e long, a long"), F.col("e"), F.col("a"))
    got = late.current(routed, ["s"])
    assert "Window" in plan_of(got)
    assert {tuple(r) for r in got.collect()} == {("a", 0, 2, 1, 1), ("b", 0, 0, 0, 1), (None, 0, 1, 1, 1)}


def test_replay_diverts_and_keeps_only_recent_state(spark, tmp_path):
    rnd = random.Random(9)
    rows = []
    for k in range(500):
        e = rnd.randrange(0, 60) * HOUR + rnd.randrange(HOUR)
        rows.append((k, rnd.choice(["x", "x", "y", None]), e, e + rnd.choice([0, HOUR, 5 * HOUR, 24 * HOUR, 26 * HOUR])))
    rnd.shuffle(rows)
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k long, source string, e long, a long").repartition(6).write.parquet(src)
    records = spark.read.parquet(src)
    counts = CorrectedCounts(spark, str(tmp_path / "out"), ["source"], ["k"]).replay(records, F.col("e"), F.col("a"), batches=6)
    routed = late.route(records, F.col("e"), F.col("a"))
    for kind, got in (("corrects", counts.corrections()), ("rejected", counts.rejected())):
        assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in routed.where(F.col("outcome") == kind).collect()) != []
    plain = lambda df: {(r["source"], r["period_start"], r["n"], r["n_corrections"]) for r in df.collect()}
    assert plain(counts.upserted()) == plain(counts.current())
    assert sorted(p.name for p in (tmp_path / "out" / "state").iterdir()) == ["batch=4", "batch=5"]
    assert list((tmp_path / "out" / "merged").iterdir()) == []


def test_replay_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "source string, e long, a long").write.parquet(str(tmp_path / "in"))
    counts = CorrectedCounts(spark, str(tmp_path / "out"), ["source"]).replay(spark.read.parquet(str(tmp_path / "in")), F.col("e"), F.col("a"))
    assert counts.current().count() == counts.upserted().count() == counts.corrections().count() == counts.rejected().count() == 0
