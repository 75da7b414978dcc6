import random
import re

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import leakage
from wardline.llm import windows as K

WORD = re.compile(r"[^\W_]+")


def words(t):
    return [w.lower() for w in WORD.findall(t or "")]


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def corpus():
    rnd = random.Random(13)
    vocabulary = ["Wort", "word", "mot", "слово", "λέξη", "x1", "7", "ß", "日本", "été", "a", "b"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 60))) for i in range(40)] + [(100, ""), (101, None), (102, "a " * 40), (None, text(30))]
    docs = []
    for d in range(300):
        t = text(rnd.randrange(0, 120))
        if d % 3 == 0:
            w = words(rnd.choice(items[:40])[1])
            a = rnd.randrange(len(w))
            part = w[a : a + rnd.choice([10, 11, 12, 13, 30])]
            t = t + ". " + rnd.choice([" ", ", ", "\n- ", "_", " "]).join(x.upper() if x != "ß" else x for x in part) + "! " + text(rnd.randrange(3))
        docs.append((d, t))
    return docs + [(900, None), (901, ""), (902, "a " * 3000), (903, docs[0][1]), (None, docs[0][1])], items


def test_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(5), "words": F.lit("w")}).repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in docs if x[0] is not None], [x for x in items if x[0] is not None])
    assert len(want) > 20
    for most in (leakage.MOST_SHIPPED, 0):
        runs = leakage.leaks(d, i, most)
        assert {(r["doc_id"], r["item_id"]) for r in runs.collect()} == want
        assert runs.agg(F.min("words")).first()[0] >= 12
    assert leakage.leaks(d.where("false"), i).count() == leakage.leaks(d, i.where("false")).count() == 0


def test_runs_are_maximal():
    shared = [f"w{k}" for k in range(30)]
    items = leakage.Items([4], ["zz " + " ".join(shared) + " yy"])
    found = leakage.matches(["aa bb " + " ".join(shared) + " cc"], items)
    assert found.tolist() == [[0, 0, 2, 1, 30]]


def test_words_of_any_script():
    for t in ["", "...", "Ä-ö_ü", "1a２b", "x́y", "\U0001d400\U0001d401 z", "İi", "a​b", "  lead", "trail  "]:
        hashes, offsets = K.word_arrays([t, "q", t])
        n = len(words(t))
        assert offsets.tolist() == [0, n, n + 1, 2 * n + 1]
        assert (hashes[:n] == hashes[n + 1 :]).all()
    a, _ = K.word_arrays(["ÄÖ β"])
    b, _ = K.word_arrays(["äö Β"])
    assert (a == b).all() and a[0] != a[1]


def test_pieces_cover_every_window(monkeypatch):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    whole = set(K.window_minima(h, 8).tolist())
    parts = set()
    for a, b in K.pieces(len(h), 8, 60):
        parts |= set((a + K.window_minima(h[a:b], 8)).tolist())
    assert parts == whole


def test_a_passage_that_all_have(spark):
    rnd = random.Random(6)
    common = " ".join(f"c{k}" for k in range(20))
    docs = [(d, f"{common} " + " ".join(f"w{rnd.randrange(50)}" for _ in range(40)) + f" {common}") for d in range(120)]
    items = [(i, " ".join(f"v{rnd.randrange(50)}" for _ in range(10)) + f" {common}") for i in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for most in (leakage.MOST_SHIPPED, 100):
        df = leakage.leaks(d, i, most)
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
        assert len(rows) == 2 * 120 * 60 and {(r["item_start"], r["words"]) for r in rows} == {(10, 20)}


def test_hits_in_parts_are_the_same(monkeypatch):
    rnd = random.Random(10)
    text = lambda n: " ".join(f"w{rnd.randrange(2)}" for _ in range(n))
    items = leakage.Items([1, 2], [text(300), text(200)])
    docs = [text(400), text(100)]
    whole = leakage.matches(docs, items)
    monkeypatch.setattr(leakage, "HITS", 7)
    assert (leakage.matches(docs, items) == whole).all() and len(whole)
