import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.operators.delivery import QuotientTable, permute
from wardline.operators.dense import Accumulators


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.text("ab", max_size=2)), max_size=30), max_size=6))
def test_each_identifier_is_inserted_once(batches):
    table, seen = QuotientTable(3), set()
    for batch in batches:
        # one word for two texts is allowed: the text decides
        high = np.array([h for h, _, _ in batch], dtype=np.uint64)
        low = np.array([x % 5 for _, x, _ in batch], dtype=np.uint64)
        keys = [(int(h), int(x), t) for h, x, (_, _, t) in zip(high, low, batch)]
        texts = np.array([f"{h}/{x}/{t}" for h, x, t in keys], dtype=object)
        new, _ = table.insert(*permute(high, low), texts)
        for k, fresh in zip(keys, new):
            assert bool(fresh) == (k not in seen)
            seen.add(k)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.text("xyz", max_size=2)), st.one_of(st.just(float("nan")), st.integers(-9, 9).map(float))), min_size=1, max_size=20), min_size=1, max_size=5))
def test_sums_of_splits_equal_the_whole(splits):
    def fold(rows):
        acc = Accumulators()
        values = np.array([v for _, v in rows])
        acc.add_rows(pa.array([k for k, _ in rows], pa.string()), values, np.nan_to_num(values).astype(np.int64))
        return list(acc.give())

    total = Accumulators()
    for s in splits:
        for part in fold(s):
            total.add_parts(part)
    key = lambda r: (r["key"] is not None, r["key"])
    whole = [b for b in fold([r for s in splits for r in s])]
    assert sorted((r for b in total.give() for r in b.to_pylist()), key=key) == sorted((r for b in whole for r in b.to_pylist()), key=key)
