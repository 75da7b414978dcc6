import random

import pytest
from pyspark.sql import functions as F

from wardline.llm import mixture


def test_counts_equal_the_tokenizer(spark):
    rnd = random.Random(2)
    words = ["hello", "  ", "\n", "naïve", "日本語", "'s", "x" * 40, "123", "​", "a.b-c"]
    texts = [None, "", " ", *["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(n)) for n in (1, 5, 50, 500)], "word " * 40_000, "z" * 30_000]
    df = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, tokens long")
    got = {r["doc_id"]: r["tokens"] for r in mixture.token_counts(df).collect()}
    encoder = mixture._encoder(mixture.TOKENIZER)
    assert got == {i: len(encoder.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert mixture.token_counts(df.where("false")).columns == ["doc_id", "source", "tokens"]


def test_water_fill():
    shares = mixture.water_fill({"a": 100, "b": 10, "c": 890}, {"a": (0.3, 2), "b": (0.2, 4), "c": (0.5, 5), "d": (0.0, 1), "e": (0.1, 9)}, 1000)
    assert shares["b"] == mixture.Share(4, True) and shares["a"] == mixture.Share(2, True)
    assert shares["c"].repeats == pytest.approx((1000 - 240) / 890) and shares["e"].repeats == 0
    assert mixture.water_fill({"a": 1}, {"a": (1.0, 2)}, 100)["a"] == mixture.Share(2, True)
    assert mixture.water_fill({}, {"a": (1.0, 2)}, 0)["a"] == mixture.Share(0.0, False)


def test_drawn_sizes_and_caps(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big"] * 8 + ["small", "mid", None]), rnd.randrange(50, 150)) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumns({"repeats": F.lit(9), "copies": F.lit(9)})
    targets = mixture.unique_targets(spark.createDataFrame([(" BIG", 0.4, 1), ("small", 0.4, 3), ("mid", 0.1, 2), ("MID ", 0.1, 5), ("gone", 0.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int"), F.lower(F.trim("source")))
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    entries, total = mixture.plan(per, targets)
    assert total == sum(t for _, _, t in rows)
    drawn = mixture.draw(sizes, mixture.as_table(spark, entries)).collect()
    cap = {"big": 1, "small": 3, "mid": 2}
    for e in entries:
        mine = [r for r in drawn if r["source"] == e["source"]]
        assert all(1 <= r["copies"] <= cap[e["source"]] for r in mine)
        got = sum(r["tokens"] * r["copies"] for r in mine)
        assert got == pytest.approx(e["repeats"] * e["tokens"], rel=0.05, abs=1)
    assert next(e for e in entries if e["source"] == "small")["clamped"]
    assert [r["source"] for r in mixture.short_sources(per, targets).orderBy("source").collect()] == [s for s in ("mid", "small") if next(e for e in entries if e["source"] == s)["tokens"] * cap[s] < {"mid": 0.2, "small": 0.4}[s] * total]


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2.0)], "source string, target_share double, max_repeats double")
    entries, total = mixture.plan(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets)
    assert total == 0 and mixture.draw(sizes, mixture.as_table(spark, entries)).count() == 0
    assert mixture.short_sources(sizes.select("source", "tokens"), targets).count() == 0


def test_long_texts_count_as_in_one_piece(monkeypatch):
    rnd = random.Random(2)
    encoder = mixture._encoder(mixture.TOKENIZER)
    alphabets = ["abcde", "日本語文字列", "abcXYZ0123456789+/", "ab'sd t'll ", "-.,'s\n  x1 ", "a\u0301é\x1c\x85\u3000 b'", "   \n"]
    monkeypatch.setattr(mixture, "PART_CHARS", 50)
    for k in range(140):
        text = "".join(rnd.choice(alphabets[k % 7]) for _ in range(700)) + "".join(rnd.choice("".join(alphabets)) for _ in range(300))
        parts = list(mixture._parts(text))
        assert "".join(parts) == text and (len(parts) > 5 or k % 7 in (0, 1, 6))
        assert sum(len(encoder.encode_ordinary(p)) for p in parts) == len(encoder.encode_ordinary(text))


def test_rounds_of_water_filling():
    shares = mixture.water_fill({"a": 10, "b": 40, "c": 1000}, {"a": (0.4, 2), "b": (0.2, 4), "c": (0.4, 9)}, 600)
    assert {s: x.round for s, x in shares.items()} == {"a": 1, "b": 2, "c": 0}
    assert sum(x.repeats * {"a": 10, "b": 40, "c": 1000}[s] for s, x in shares.items()) == pytest.approx(600)
