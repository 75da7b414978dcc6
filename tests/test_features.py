import random

from pyspark.sql import functions as F

from wardline.operators import features as X


def frame(spark, n=240):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        bad = i % 2
        host = ("secure-login-" if bad else "shop") + "".join(rnd.choice("abcdefgh0123") for _ in range(8)) + (".zz" if bad else ".test")
        rows.append((i, host, bad, rnd.choice(["f1", "f2"]) if bad else None, f"2026-08-0{1 + i // 2 % 4}", f"AS{rnd.randrange(5)}", None if i % 7 else "Reg", float(rnd.randrange(5))))
    return spark.createDataFrame(rows, "id long, host string, label int, source string, ds string, asn string, registrar string, num_unique_ips double")


def test_vector_shape_and_models(spark):
    df = X.prepared(frame(spark), F.col("host"), {"asn": "asn", "reg": "registrar"})
    train, test, temporal = X.split_by_date(df, "ds", "label", "id", 20)
    assert temporal and train.count() + test.count() == 240
    for kind in ("boosted", "logistic"):
        model = X.fit(train, "id", kind)
        done = X.scored(model, test)
        assert done.first()["features"].size == 4371
        assert X.evaluate(done)["roc_auc"] > 0.95
    again = X.scored(X.fit(train, "id", "logistic"), test)
    assert again.agg(F.sum("score")).first() == done.agg(F.sum("score")).first()


def test_leave_one_source_out(spark):
    df = X.prepared(frame(spark), F.col("host"), {})
    got = X.leave_one_source_out(df, "source", "id")
    assert set(got) == {"f1", "f2"} and all(m["roc_auc"] > 0.9 for m in got.values())


def test_grams_categories_and_registration(spark):
    df = spark.createDataFrame([("abcd", "nan", " X ", 10, None, None), ("ab", None, "", None, None, None)], "h string, a string, b string, c long, e long, err string")
    rows = df.select(X.char_grams(F.col("h")).alias("g"), X.categories({"a": "a", "b": "b"}).alias("t")).collect()
    assert rows[0]["g"] == ["abc", "bcd", "abcd"] and rows[1]["g"] == [] and rows[0]["t"] == ["b=x"] and rows[1]["t"] == []
    r = X.with_registration(df, F.col("c"), F.col("e"), F.col("err"), F.col("c").isNotNull(), 86_400_000_010).collect()
    assert (r[0]["age_days"], r[0]["created_isnull"], r[0]["expires_isnull"]) == (1.0, 0, 1)
    assert (r[1]["age_days"], r[1]["created_isnull"], r[1]["expires_isnull"]) == (0.0, 0, 0)


def test_fallback_split_is_stratified_and_stable(spark):
    df = frame(spark).withColumn("ds", F.lit(None).cast("string"))
    train, test, temporal = X.split_by_date(df, "ds", "label", "id")
    assert not temporal and train.count() + test.count() == 240 and 0.1 < test.count() / 240 < 0.4
    assert {r["id"] for r in test.collect()} == {r["id"] for r in X.split_by_date(df.repartition(3), "ds", "label", "id")[1].collect()}


def test_fusion_thresholds_and_promotion(spark):
    df = spark.createDataFrame([(0.95, True), (0.95, False), (0.1, True), (0.1, None), (None, None)], "s double, h boolean")
    label, reason = X.fused(F.col("s"), F.col("h"), 0.9)
    assert [tuple(r) for r in df.select(label, reason).collect()] == [(1, "MISP_AND_ML"), (1, "ML_SCORE"), (1, "MISP_IOC"), (0, "BENIGN_BASELINE"), (0, "BENIGN_BASELINE")]
    nested = {"metrics": {"lgbm_full": {"threshold_at_1pct_fpr": 0.42}, "logreg_full": {"fpr_1pct_threshold": "0.5"}}, "threshold_at_1pct_fpr": 0.7}
    assert X.threshold(nested, "lgbm_full") == 0.42 and X.threshold(nested, "logreg_full") == 0.5 and X.threshold(nested, "other") == X.threshold(nested) == 0.7
    assert X.threshold({}) == X.threshold(None, "lgbm_full") == X.threshold({"metrics": {"lgbm_full": {"threshold_at_1pct_fpr": "x"}}, "fpr_1pct_threshold": None}, "lgbm_full") == 0.9

    def run(area=0.9, fpr=0.01, model="lgbm_full", **more):
        return {"n_pos": 5, "n_neg": 5, "used_temporal_split": True, "metrics": {model: {"roc_auc": area}}, "benign_holdout_fpr": {"fpr": fpr}} | more

    assert X.promotion(run(), None) == (True, "no champion", []) and X.promotion(run(), run()) == (True, "not worse", [])
    assert X.promotion(run(n_neg=0), None)[1] == "one class only" and X.promotion(run(area=float("nan")), None)[1] == "unknown area" and X.promotion(run(area=0.6), None)[1] == "below the floor"
    assert X.promotion(run(area=0.85), run())[1] == "area regressed" and X.promotion(run(fpr=0.2), run())[1] == "false positives regressed"
    assert X.promotion(run(model="logreg_full"), run(area=0.89)) == (True, "not worse", []) and X.promotion(run(), {"metrics": None}) == (True, "no champion", [])
    assert X.promotion(run(benign_holdout_fpr=None, used_temporal_split=False), run()) == (True, "not worse", ["no temporal split", "benign rate unknown of candidate"])
    assert X.primary({"logreg_full": 1, "lgbm_full": None}) == ("logreg_full", 1) and X.primary({"logreg_full": 1, "lgbm_full": 2}) == ("lgbm_full", 2)
    log = spark.createDataFrame([(1, "yes", None), (2 * 3_600_000_000, "no", "worse")], "at long, promoted string, reason string")
    assert X.gate_ran(log, "at", ["promoted", "reason"], 3 * 3_600_000_000, 2) == (True, "ok") and X.gate_ran(log, "at", ["promoted"], 9 * 3_600_000_000, 2) == (False, "too old")
    assert X.gate_ran(log.where("at = 1"), "at", ["promoted", "reason"], 2, 2) == (False, "incomplete: reason") and X.gate_ran(log.where("false"), "at", [], 0, 1) == (False, "no entry")
    assert [X.gap_band(0.9, x) for x in (0.88, 0.8, 0.5)] == ["likely shortcut", "unclear", "content matters"]


def test_rule_weights_and_sample(spark):
    rnd = random.Random(1)
    rows = [(rnd.random() < (0.8 if y else 0.1), rnd.random() < 0.5, rnd.random() < (0.1 if y else 0.6), y, 1.0) for y in [0, 1] * 200]
    w = X.rule_weights(spark.createDataFrame(rows, "good boolean, noise boolean, bad boolean, y int, w double"), ["good", "noise", "bad"], "y", "w")
    assert w["good"] > 0.6 and w["bad"] == 0 and abs(sum(w.values()) - 1) < 0.01
    hosts = spark.createDataFrame([("x" * (1 + i % 30) + str(i),) for i in range(900)] + [(None,)], "h string")
    got = X.stratified_sample(hosts, "h", {(1, 10): 20, (11, 20): 50, (21, 40): 1000})
    n = {r["bin"]: r["count"] for r in got.groupBy("bin").count().collect()}
    assert n[0] == 20 and n[1] == 50 and n[2] > 200
    assert {r["h"] for r in got.collect()} == {r["h"] for r in X.stratified_sample(hosts.repartition(5), "h", {(1, 10): 20, (11, 20): 50, (21, 40): 1000}).collect()}


def test_no_source_is_left_out(spark, monkeypatch):
    rows = [(i, 1, f"f{i:03}") for i in range(103)] + [(200 + i, 0, None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label int, source string").repartition(3)
    monkeypatch.setattr(X, "fit", lambda *_: None)
    monkeypatch.setattr(X, "scored", lambda _, test: test)
    monkeypatch.setattr(X, "evaluate", lambda _: {})
    assert list(X.leave_one_source_out(df, "source", "id")) == [f"f{i:03}" for i in range(103)]


def test_registration_from_whatever_is_there(spark):
    now = 100 * 86_400_000_000
    raw = spark.createDataFrame([("1970-01-31", "1970-05-01", "r"), (None, None, None)], "created string, whois_expires string, registrar string").withColumns({"age_days": F.lit(7.0), "has_error": F.lit(1)})
    got = [tuple(r) for r in X.registration_from(raw, now).select("age_days", "days_to_expiry", "created_isnull", "expires_isnull", "has_error").collect()]
    assert got == [(70.0, 20.0, 0, 0, 0), (0.0, 0.0, 0, 0, 0)]
    before = spark.createDataFrame([(7.0, None)], "age_days double, days_to_expiry double")
    assert X.registration_from(before, now).select(*X.REGISTRATION).first() == (7.0, 0.0, 0.0, 0.0, 0.0)


def test_shortcut_check_and_held_load(spark):
    from wardline.operators import ranking

    rnd = random.Random(8)
    rows = [(i, "bad-login%d.xyz" % i if y else "plain%s.test" % "".join(rnd.choice("abcdef") for _ in range(6)), y, rnd.randrange(4)) for i in range(120) for y in [i % 2]]
    df = X.prepared(spark.createDataFrame(rows, "id long, host string, label int, num_unique_ips int"), F.col("host"), {})
    got = X.shortcut_check(df.where("id < 80"), df.where("id >= 80"), "id")
    assert got["all"] > 0.9 and got["band"] == X.gap_band(got["all"], got["infrastructure"])
    old = ranking.levels(spark.createDataFrame([(0.1 * k, k % 3 == 0) for k in range(10)], "s double, p boolean"), F.col("s"), F.col("p"))
    new = ranking.levels(spark.createDataFrame([(0.01 * k, k % 2 == 0) for k in range(10)], "s double, p boolean"), F.col("s"), F.col("p"))
    assert abs(X.hold_load(old, 0.65, new).first()["threshold"] - 0.07) < 1e-12
