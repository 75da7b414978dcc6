import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import spans
from wardline.llm import windows as K


def brute(docs, n=300):
    at = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            at[t[i : i + n]].add(d)
    pairs, shared = set(), {}
    for ds in at.values():
        ds = sorted(ds)
        pairs |= {(a, b) for k, a in enumerate(ds) for b in ds[k + 1 :]}
    for d, t in docs:
        covered, until = 0, 0
        for i in range(len(t or "") - n + 1):
            if len(at[t[i : i + n]]) > 1:
                covered += i + n - max(i, until)
                until = i + n
        shared[d] = covered
    return pairs, shared


def corpus():
    rnd = random.Random(17)
    text = lambda n: "".join(rnd.choice("abcdefgh  \nö日") for _ in range(n))
    long, footer, nearly = text(2000), text(290), text(299)
    docs = [(i, text(rnd.randrange(0, 900))) for i in range(30)]
    for i in range(30, 60):
        a = rnd.randrange(1500)
        docs.append((i, text(rnd.randrange(200)) + long[a : a + rnd.choice([298, 299, 300, 301, 450])] + text(rnd.randrange(200))))
    docs += [(i, text(300) + footer) for i in range(60, 90)]
    docs += [(90, nearly), (91, "x" + nearly), (92, nearly + "y"), (93, "-" * 800), (94, "-" * 310), (95, ("line of a log, repeated\n") * 60), (96, "z" + ("line of a log, repeated\n") * 40)]
    docs += [(100 + k, long) for k in range(5)] + [(110, None), (111, ""), (112, long[:300]), (113, "short"), (114, "short")]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit("x"), "doc": F.lit(1), "rep": F.lit(2), "start": F.lit(3)}).repartition(6)
    pairs, shared = brute(docs)
    assert len(pairs) > 100
    sizes = defaultdict(list)
    for d, t in docs:
        if t and len(t) >= 300:
            sizes[t].append(d)
    for few in (64, 2, 0):
        found = spans.shared_spans(df, few)
        got = [tuple(r) for r in found.all_pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        rows = found.per_document(df).collect()
        assert len(rows) == len(docs)
        for r in rows:
            d = r["doc_id"]
            assert r["shared_chars"] == shared[d] and r["links"] == sum(d in p for p in pairs)
            t = dict(docs)[d]
            assert r["class_id"] == (min(sizes[t]) if t in sizes else d) and r["n_chars"] == len(t or "")


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a" * 400), (None, "a" * 400), (1, "a" * 400)], "doc_id long, text string")
    assert spans.shared_spans(df).all_pairs().count() == 0
    assert spans.shared_spans(df.where("false")).per_document(df.where("false")).count() == 0


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(5)
    for most in (6, 1 << 40):
        h = (rng.integers(0, most, 400).astype(np.uint64) << np.uint64(24)) | np.uint64(7)
        width = 12
        places = K.window_minima(h, width)
        left, right = K.cartesian_bounds(h[places], places, len(h))
        bounds = {int(c): (int(a), int(b)) for c, a, b in zip(places, left, right)}
        seen = set()
        for i in range(len(h)):
            for j in range(i + width - 1, len(h)):
                c = i + int(np.argmin(h[i : j + 1] >> np.uint64(24)))
                seen.add(c)
                assert bounds[c][0] <= i and j <= bounds[c][1]
        assert seen == set(bounds)


def test_very_long_text(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdef ") for _ in range(400_000))
    df = spark.createDataFrame([(1, base), (2, "q" + base[200_000:200_400] + "q" * 500)], "doc_id long, text string")
    found = spans.shared_spans(df)
    assert [tuple(r) for r in found.all_pairs().collect()] == [(1, 2)]
    assert {r["doc_id"]: r["shared_chars"] for r in found.per_document(df).collect()} == {1: 400, 2: 400}


def test_footers_are_counted_without_pairs(spark):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh \nxyz") for _ in range(n))
    footers = [text(320), text(330), text(305)]
    docs = []
    for i in range(240):
        mine = [f for k, f in enumerate(footers) if i % (k + 2) == 0]
        docs.append((i, text(200) + "".join(text(40) + f for f in mine) + text(30)))
    docs += [(300 + i, docs[i][1]) for i in range(0, 40, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    pairs, shared = brute(docs)
    few, deep = spans.FEW, spans.MOST_SETS
    for limit, most in ((few, deep), (20, deep), (20, 1), (20, 0)):
        spans.MOST_SETS = most
        try:
            found = spans.shared_spans(df, limit)
            got = {r["doc_id"]: (r["links"], r["shared_chars"]) for r in found.per_document(df).collect()}
        finally:
            spans.MOST_SETS = deep
        assert got == {d: (sum(d in p for p in pairs), shared[d]) for d, _ in docs}
    # a footer's groups, one per common length of its surroundings, are reduced to a few
    assert found.groups.select("g").distinct().count() < 12
    assert {tuple(r) for r in found.all_pairs().collect()} == pairs
    rows = found.groups.count()
    assert rows < 3 * len(docs)
    spans.GROUP_ROWS = 7
    try:
        assert {tuple(r) for r in found.all_pairs().collect()} == pairs
    finally:
        spans.GROUP_ROWS = 1000
