import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from wardline.operators import dense


def test_per_key_against_brute_force(spark):
    rnd = random.Random(1)
    data = [("hot" if k % 3 == 0 else rnd.choice([None, "", "ä", f"k{k % 90}"]), rnd.choice([None, float("nan"), round(rnd.uniform(-5, 5), 4)]), k) for k in range(4000)]
    df = spark.createDataFrame(data, "key string, n double, total long").repartition(6)
    want = defaultdict(list)
    for k, v, _ in data:
        want[k].append(v)
    got = {r["key"]: r for r in dense.per_key(df, F.col("key"), F.col("n"), dictionary_keys=50).collect()}
    assert set(got) == set(want)
    for k, vs in want.items():
        good = [v for v in vs if v is not None and not math.isnan(v)]
        r = got[k]
        assert (r["n"], r["n_valued"]) == (len(vs), len(good))
        if not good:
            assert (r["total"], r["least"], r["most"]) == (None, None, None)
            continue
        assert math.isclose(r["total"], sum(good), abs_tol=1e-6) and (r["least"], r["most"]) == (min(good), max(good))


def test_without_values_and_empty(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    got = {r["key"]: (r["n"], r["n_valued"], r["total"], r["least"]) for r in dense.per_key(df, F.col("k")).collect()}
    assert got == {"a": (2, 0, None, None), None: (1, 0, None, None)}
    assert dense.per_key(df.where("false"), F.col("k")).count() == 0
    assert dense.heavy_keys(df.where("false"), F.col("k")).count() == 0


def test_heavy_keys_count_all_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 90 + [("b",)] * 4 + [("c",)], "k string")
    assert {(r["key"], r["n"]) for r in dense.heavy_keys(df, F.col("k")).collect()} == {("a", 5)}


def test_blocks_hold_a_batch_of_keys(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(2)
    keys = sorted([f"k{rnd.randrange(700):03}" for _ in range(3000)] + ["k300"] * 900)
    keys = [None] * 250 + keys
    n = len(keys)
    table = pa.table({"key": pa.array(keys, pa.string()), "n": np.ones(n, np.int64), "n_valued": np.ones(n, np.int64), "total": np.arange(n), "least": np.arange(n, dtype=float), "most": np.arange(n, dtype=float)}, schema=dense._SCHEMA)
    held = []
    give = dense.Accumulators.give
    monkeypatch.setattr(dense.Accumulators, "give", lambda self: (held.append(len(self.codes)), give(self))[1])
    got = pa.Table.from_batches(dense._blocks(iter(table.to_batches(max_chunksize=100)))).to_pylist()
    assert max(held) <= 101
    assert len(got) == len(set(keys)) and [r["key"] for r in got] == list(dict.fromkeys(keys))
    for r in got:
        mine = [i for i, k in enumerate(keys) if k == r["key"]]
        assert (r["n"], r["total"], r["least"], r["most"]) == (len(mine), sum(mine), min(mine), max(mine))
