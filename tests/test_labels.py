from pyspark.sql import functions as F

from wardline.functions import labels as L


def test_verdicts_have_exclusive_bounds(spark):
    rows = [(0.995, False), (0.99, False), (0.90, False), (0.901, None), (0.70, True), (0.701, False), (0.40, False), (0.401, False), (0.0, True), (None, True), (None, None)]
    df = spark.createDataFrame(rows, "s double, b boolean")
    got = [tuple(r) for r in df.select(L.verdict(F.col("s"), F.col("b")), L.level(F.col("s"), F.col("b"))).collect()]
    assert got == [
        ("CONFIRMED_MALICIOUS_INFRA", "CRITICAL"), ("IMMINENT_PHISHING_THREAT", "CRITICAL"), ("HIGH_PROBABILITY_STAGING", "HIGH"), ("IMMINENT_PHISHING_THREAT", "CRITICAL"), ("SUSPICIOUS_PATTERN", "HIGH"), ("HIGH_PROBABILITY_STAGING", "HIGH"),
        ("BASELINE_NORMAL", "CLEAN"), ("SUSPICIOUS_PATTERN", "CLEAN"), ("SUSPICIOUS_PATTERN", "HIGH"), ("SUSPICIOUS_PATTERN", "HIGH"), ("BASELINE_NORMAL", "CLEAN"),
    ]


def test_rules_of_names(spark):
    df = spark.createDataFrame([("a-b-c1234.XYZ",), ("plain.com",), ("x",), ("",), (None,)], "d string")
    d = F.col("d")
    assert [round(r[0], 6) for r in df.select(L.baseline_score(d)).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(L.tld_bucket(d)).collect()] == ["other", "reliable", "other", "other", "other"]
    assert [r[0] for r in df.select(L.preferred(d, F.lit("u"))).collect()] == ["a-b-c1234.XYZ", "plain.com", "x", "u", "u"]
    assert [r[0] for r in df.select(L.label_of(F.when(d == "x", "benign_seed").when(d != "", "feed"))).collect()] == [1, 1, 0, 1, 1]


def test_ages_and_confidence(spark):
    df = spark.createDataFrame([(None,), (0.4,), (59.5,), (61.0,), (75.0,), (1440.0,), (2300.0,)], "m double")
    assert [r[0] for r in df.select(L.freshness(F.col("m"))).collect()] == ["unknown", "0m ago", "60m ago", "1.0h ago", "1.3h ago", "1.0d ago", "1.6d ago"]
    c = spark.createDataFrame([(0.5, 10), (0.5, 2), (0.99995, 1), (None, 3)], "c double, n int")
    got = [tuple(None if x is None else round(x, 6) if not isinstance(x, bool) else x for x in r) for r in c.select(*L.confidence_parts(F.col("c"), F.col("n"))).collect()]
    assert got == [(0.5, 1.0, False), (round(0.5 / 0.76, 6), 0.76, False), (1.0, 0.73, True), (None, None, None)]
