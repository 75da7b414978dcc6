from pyspark.sql import functions as F

from wardline.operators import merging, ranking, reviews


def test_upsert_policies_and_null_keys(spark):
    old = spark.createDataFrame([("a", 1, 0.1, "x"), ("b", None, 0.2, "y"), ("c", 3, 0.3, "z")], "k string, t int, s double, r string")
    new = spark.createDataFrame([("a", 1, None, None), ("b", None, 0.9, "w"), ("d", 4, 0.4, "v")], "k string, t int, s double, r string")
    got = {(r["k"], r["t"]): (r["s"], r["r"]) for r in merging.upsert(old, new, ["k", "t"], ["s"], ["r"]).collect()}
    assert got == {("a", 1): (None, "x"), ("b", None): (0.9, "w"), ("c", 3): (0.3, "z"), ("d", 4): (0.4, "v")}
    assert merging.upsert(old, new.where("false"), ["k", "t"], ["s"], ["r"]).count() == 3
    assert merging.upsert(old.where("false"), new, ["k", "t"], ["s"], ["r"]).count() == 3


def test_insert_replace_and_first(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in merging.insert_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "y")}
    assert sorted(tuple(r) for r in merging.replace_keys(old, new, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]
    assert [tuple(r) for r in merging.keep_first(new, ["k"], [F.col("v")]).orderBy("k").collect()] == [(2, "x"), (3, "y")]


def test_lookup_outcomes(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", 90, "1"), ("a", 95, "2"), ("a", 10, "0"), ("b", 10, "3"), ("d", None, "4")], "k string, f long, v string")
    got = sorted((r["k"], r["v"] or "", r["outcome"]) for r in merging.fresh_lookup(rows, cache, "k", F.col("f"), 100, 20).collect())
    assert got == [("a", "1", "hit"), ("a", "2", "hit"), ("b", "", "expired"), ("c", "", "miss")]


def test_queue(spark):
    q = spark.createDataFrame([("a", "pending", 3, 0), ("b", "pending", 1, 0), ("c", "processing", 0, 2), ("d", "processing", 0, 0), ("e", "pending", 2, 0)], "k string, status string, t int, attempts int")
    claimed = {r["k"]: r["status"] for r in merging.claim_oldest(q, "status", "t", "k", 2).collect()}
    assert claimed == {"a": "pending", "b": "processing", "c": "processing", "d": "processing", "e": "processing"}
    assert {(r["status"], r["n"], r["lag_seconds"]) for r in merging.queue_depth(q, "status", "t", 1_000_003).collect()} == {("pending", 3, 1.000002), ("processing", 2, 1.000003)}
    back = {r["k"]: (r["status"], r["attempts"]) for r in merging.requeue_failed(q, "status", "attempts").collect()}
    assert back["c"] == ("failed", 3) and back["d"] == ("pending", 1) and back["a"] == ("pending", 0)


def test_areas_with_ties_and_one_class(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.8, 1), (0.3, 0), (0.1, 0), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    good = [(s, y) for s, y in rows if s is not None and s == s]
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p, y in good if y for n, z in good if not z]
    one = ranking.areas(ranking.levels(df, F.col("s"), F.col("y") == 1)).first()
    assert abs(one["roc_auc"] - sum(pairs) / len(pairs)) < 1e-8 and (one["n_pos"], one["n_neg"]) == (3, 3)
    alone = ranking.areas(ranking.levels(df.where("y = 1"), F.col("s"), F.col("y") == 1)).first()
    assert alone["roc_auc"] is None
    assert ranking.areas(ranking.levels(df.where("false"), F.col("s"), F.col("y") == 1)).first()["roc_auc"] is None


def test_budget_shares_ties(spark):
    rows = [(0.9, 10.0, 1), (0.5, 20.0, 1), (0.5, 20.0, 0), (0.2, 100.0, 1), (0.0, 1000.0, 0)]
    df = spark.createDataFrame(rows, "s double, w double, y int")
    per = ranking.levels(df, F.col("s"), F.col("y") == 1, F.col("w"))
    one = ranking.budget(per, 30).first()
    assert one["threshold"] == 0.9 and abs(one["recall"] - (1 + 0.5) / 3) < 1e-8


def test_precision(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, None), (3, 0.5, 1), (4, float("nan"), 1), (5, None, 1)], "k int, s double, y int")
    got = {r["k"]: (r["n_evaluated"], r["n_hits"]) for r in ranking.precision_at(df, "s", F.col("y") > 0, "k", (1, 2, 10)).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 10: (3, 2)}


def test_update_where(spark):
    df = spark.createDataFrame([(1, True), (2, True), (None, True)], "k int, active boolean")
    assert [r["active"] for r in merging.update_where(df, F.col("k") == 1, {"active": F.lit(False)}).collect()] == [False, True, True]


def test_reviews(spark):
    day = 86_400_000_000
    d = spark.createDataFrame([(1, 1, "suppressed", 5 * day), (2, 1, "confirmed", 6 * day), (3, 2, "benign", day), (4, 3, "confirmed", 0), (5, None, "benign", 0)], "id long, cluster_id long, verdict string, created_at long")
    c = spark.createDataFrame([(1, 4 * day), (2, 0), (3, day), (4, 0)], "id long, created_at long")
    assert {(r["cluster_id"], r["verdict"]) for r in reviews.current_verdicts(d).collect()} == {(1, "confirmed"), (2, "benign"), (3, "confirmed")}
    assert tuple(reviews.confirmation_rate(d).first()) == (3, 2, 0.6667, "low")
    assert tuple(reviews.confirmation_rate(d.where("false")).first()) == (0, 0, None, "none")
    assert tuple(reviews.median_hours_to_review(c, d).first()) == (3, 24.0)
    assert tuple(reviews.per_day(c, 5 * day).first()) == (4, 0.8)
    assert reviews.per_day(c.where("false"), 5 * day).first()["n_in_window"] == 0
