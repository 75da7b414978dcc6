import random

import numpy as np
import pytest

from wardline.operators import delivery

SCHEMA = "kafka_offset long, id string, domain string, ingest_ts timestamp_ntz, row long, ident string, high long"


def rows_of(spark, data):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in data], SCHEMA)


def brute(data):
    seen, gone = set(), set()
    for off, i, host, ts in sorted(data, key=lambda r: (r[3] is None, r[3], r[0])):
        key = (i or "").strip()
        if not key:
            continue
        h = (host or "").strip().lower().rstrip(".")
        k = (key, h[2:] if h.startswith("*.") else h)
        (gone.add(off) if k in seen else seen.add(k))
    return gone


def test_against_brute_force(spark):
    import datetime as dt

    rnd = random.Random(5)
    data = []
    for off in range(3000):
        i = rnd.choice([None, "", " ", "ct-1-0", "ct-1-1 ", *[f"ct-{k}-0" for k in range(300)]]) if off % 3 else "hot"
        host = rnd.choice([None, "", "a.test", "A.test.", "*.a.test", f"b{off % 7}.test"]) if off % 3 else "Hot.test"
        data.append((off, i, host, dt.datetime(2026, 8, 1) + dt.timedelta(seconds=rnd.randrange(50)) if rnd.random() > 0.02 else None))
    df = rows_of(spark, data).repartition(5)
    for size in (70, 200_000):
        got = [r[0] for r in delivery.copies(df, chunk_rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_with_nulls(data)
    kept = {r["kafka_offset"] for r in delivery.deliver_once(df).collect()}
    assert kept == {r[0] for r in data} - set(got)


def brute_with_nulls(data):
    import datetime as dt

    return brute([(o, i, h, t or dt.datetime(9999, 1, 1)) for o, i, h, t in data])


def test_empty_and_clashing_columns(spark):
    assert delivery.copies(rows_of(spark, [])).count() == 0
    assert delivery.deliver_once(rows_of(spark, [])).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_separator_cannot_be_forged(spark):
    import datetime as dt

    t = dt.datetime(2026, 8, 1)
    assert delivery.copies(rows_of(spark, [(1, "a:b", "c", t), (2, "a", "b:c", t), (3, "1:a", "", t), (4, "1", ":a", t)])).count() == 0


def test_quotient_table_is_exact():
    rng = np.random.default_rng(3)
    table, seen = delivery.QuotientTable(4), {}
    for _ in range(20):
        n = int(rng.integers(1, 400))
        # few distinct words, so that different texts collide on all 128 bits
        high = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(40)
        low = rng.integers(0, 2, n).astype(np.uint64)
        texts = np.array([f"{h}-{x}-{rng.integers(3)}" for h, x in zip(high, low)], dtype=object)
        rows = rng.integers(0, 1 << 40, n)
        new, first = table.insert(high, low, texts, rows)
        for t, fresh, row, brought in zip(texts, new, rows, first):
            assert fresh == (t not in seen)
            assert brought == seen.setdefault(t, row)
    assert table.count == len(seen)


def test_permutation_is_a_bijection():
    high, low = np.meshgrid(np.arange(64, dtype=np.uint64), np.arange(64, dtype=np.uint64))
    a, b = delivery.permute(high.ravel(), low.ravel())
    assert len(set(zip(a.tolist(), b.tolist()))) == 64 * 64


@pytest.mark.parametrize("long", ["x" * 100_000])
def test_long_text(spark, long):
    import datetime as dt

    t = dt.datetime(2026, 8, 1)
    assert [r[0] for r in delivery.copies(rows_of(spark, [(1, "i", long, t), (2, "i", long, t), (3, "i", long + "y", t)])).collect()] == [2]


def test_repeated_rows_and_missing_row_ids(spark):
    import datetime as dt

    t = dt.datetime(2026, 8, 1)
    data = [(1, "i", "a", t), (1, "i", "a", t), (2, "i", "a", t), (2, "i", "a", t), (None, "i", "a", t), (None, "j", None, None)]
    df = rows_of(spark, data).repartition(3)
    for size in (1, 200_000):
        assert {r[0] for r in delivery.copies(df, chunk_rows=size).collect()} == {2}
        assert sorted(str(r["kafka_offset"]) for r in delivery.deliver_once(df).collect()) == ["1", "1", "None", "None"]


def test_shards_share_tasks(spark):
    import datetime as dt

    rnd = random.Random(12)
    start = dt.datetime(2026, 8, 1)
    data = [(k, f"i{rnd.randrange(120)}", rnd.choice(["a", "b", "hot", "hot"]), start + dt.timedelta(seconds=rnd.randrange(500))) for k in range(3000)]
    df = rows_of(spark, data).repartition(5)
    want = {r[0] for r in delivery.copies(df).collect()}
    seen, kept = set(), set()
    for k, i, h, _ in sorted(data, key=lambda r: (r[3], r[0])):
        if (i, h) not in seen:
            kept.add(k)
        seen.add((i, h))
    assert want == {r[0] for r in data} - kept
    assert {r[0] for r in delivery.copies(df, chunk_rows=100, rows_per_shard=20).collect()} == want


def test_tasks_stay_bounded():
    bits, tasks = delivery.shards_and_tasks(10**12, delivery.ROWS_PER_SHARD, 2000)
    assert tasks == delivery.MOST_TASKS and 10**12 / 2**bits <= delivery.ROWS_PER_SHARD
    assert delivery.shards_and_tasks(0, 10, 8) == (6, 8) and delivery.shards_and_tasks(1000, 10, 8)[1] == 100
