import random

from pyspark.sql import functions as F

from wardline.llm import asof


def test_against_brute_force(spark):
    rnd = random.Random(11)
    names = [None, "hot", *[f"d{k}" for k in range(40)]]
    pick = lambda: "hot" if rnd.random() < 0.35 else rnd.choice(names)
    events = [(i, pick(), rnd.choice([None, *[rnd.randrange(1000)] * 9])) for i in range(3000)]
    looks = [(pick(), rnd.choice([None, *[rnd.randrange(1000)] * 9]), rnd.choice([None, "a", "b", "c"]), rnd.choice([None, 1, 2])) for _ in range(900)]
    ev = spark.createDataFrame(events, "id long, e string, at long").withColumns({"bucket": F.lit("x"), "entity": F.lit("y"), "row": F.lit(0)}).repartition(4)
    lk = spark.createDataFrame(looks, "e string, f long, t string, n long")

    def kinds():
        return {"one": asof.versions(lk, "one", F.col("e"), F.col("f"), F.col("t"), F.col("n")), "two": asof.versions(lk.where("t = 'a'"), "two", F.col("e"), F.col("f"), F.col("t"))}

    def brute(e, at, rows):
        rows = [(f, (t is not None, t or ""), (n is not None, n or 0), t, n) for d, f, t, n in rows if d == e and f is not None and f <= at]
        return (*max(rows, key=lambda r: r[:3])[3:], True) if rows else (None, None, False)

    want = {}
    for i, e, at in events:
        if e is not None and at is not None:
            a = brute(e, at, looks)
            b = brute(e, at, [(d, f, t, None) for d, f, t, _ in looks if t == "a"])
            want[i] = (*a, *b)
    for size, slices in ((60_000, 100_000), (200, 30), (50, 7)):
        got = {r[0]: tuple(r)[1:] for r in asof.as_of(ev, "id", F.col("e"), F.col("at"), kinds(), size, slices).collect()}
        assert got == want


def test_empty_sides(spark):
    ev = spark.createDataFrame([(1, "a", 5)], "id long, e string, at long")
    lk = spark.createDataFrame([], "e string, f long, t string")
    kinds = {"k": asof.versions(lk, "k", F.col("e"), F.col("f"), F.col("t"))}
    assert [tuple(r) for r in asof.as_of(ev, "id", F.col("e"), F.col("at"), kinds).collect()] == [(1, None, None, False)]
    assert asof.as_of(ev.where("false"), "id", F.col("e"), F.col("at"), kinds).count() == 0


def test_long_lists_of_large_entities_are_joined_by_shuffle(spark):
    rnd = random.Random(8)
    events = [(i, f"d{rnd.randrange(6)}", rnd.randrange(10**9)) for i in range(2000)]
    looks = [(f"d{rnd.randrange(6)}", rnd.randrange(10**9), rnd.choice("abc")) for _ in range(600)]
    ev, lk = spark.createDataFrame(events, "id long, e string, at long"), spark.createDataFrame(looks, "e string, f long, t string")
    run = lambda **x: {tuple(r) for r in asof.as_of(ev, "id", F.col("e"), F.col("at"), {"k": asof.versions(lk, "k", F.col("e"), F.col("f"), F.col("t"))}, 40, 20, **x).collect()}
    want = run()
    assert len(want) == 2000 and any(r[3] for r in want)
    assert run(most_listed=0) == want == {tuple(r) for r in asof.as_of(ev, "id", F.col("e"), F.col("at"), {"k": asof.versions(lk, "k", F.col("e"), F.col("f"), F.col("t"))}).collect()}


def test_slices_hold_what_they_should(spark):
    lk = spark.createDataFrame([("a", i * 60_000_000 + j, "x") for i in range(50) for j in range(3)] + [("b", 5, "y")], "e string, f long, t string")
    cuts = {r["entity"]: r["_cuts"] for r in asof._cuts(asof.versions(lk, "k", F.col("e"), F.col("f"), F.col("t")), 10).collect()}
    assert set(cuts) == {"a"}
    bounds = [0, *[c // 60_000_000 for c in cuts["a"]], 50]
    assert all(3 * (b - a) <= 10 + 3 for a, b in zip(bounds, bounds[1:])) and bounds == sorted(set(bounds))
