import random

from pyspark.sql import functions as F

from wardline.llm import topn


def test_against_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(6000):
        g = "hot" if rnd.random() < 0.4 else rnd.choice([None, "", f"g{rnd.randrange(200)}"])
        rows.append((g, rnd.choice([None, *range(500)]), rnd.choice([None, float("nan"), *[k / 10 for k in range(11)]])))
    df = spark.createDataFrame(rows, "g string, i long, s double").withColumns({"_g": F.lit(1), "rank": F.lit(0), "_salt": F.lit("z")}).repartition(5)
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), s), s)
    want = set()
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (h, i), s in best.items() if h == g))[:5]
        want |= {(g, i, -s, k + 1) for k, (s, i) in enumerate(ranked)}
    for salts in (1, 3, 64):
        assert {tuple(r) for r in topn.top_n(df, "g", "s", "i", 5, salts).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i long, s double")
    assert topn.top_n(df, "g", "s", "i", 3).columns == ["g", "i", "s", "rank"]
    assert topn.top_n(df, "g", "s", "i", 3).count() == 0


def test_unique_pairs_need_one_shuffle_less(spark):
    from tests.oracle import plan_of

    df = spark.createDataFrame([(f"g{i % 3}", i, float(i % 10)) for i in range(90)], "g string, i long, s double")
    a, b = topn.top_n(df, "g", "s", "i", 4), topn.top_n(df, "g", "s", "i", 4, unique=True)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()} and plan_of(b).count("Exchange") == plan_of(a).count("Exchange") - 1
