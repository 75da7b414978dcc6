import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardline.llm import leakage, mixture, spans
from wardline.llm import windows as K

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB1é_ .\n​日-", max_size=30), max_size=6))
def test_words_split_as_the_pattern_does(texts):
    hashes, offsets = K.word_arrays(texts)
    known = {}
    for i, t in enumerate(texts):
        own = hashes[offsets[i] : offsets[i + 1]].tolist()
        want = [w.lower() for w in WORD.findall(t)]
        assert len(own) == len(want)
        for w, h in zip(want, own):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abcd"), min_size=8, max_size=30))
def test_every_long_enough_run_is_found(before, after, shared):
    doc = " ".join([*before, *shared, *after])
    item = " ".join(shared)
    found = leakage.matches([doc], leakage.Items([1], [item]))
    w, v = doc.split(), item.split()
    n = leakage.SHARED_WORDS
    grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
    assert bool(len(found)) == any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))
    for _, _, a, b, k in found.tolist():
        assert w[a : a + k] == v[b : b + k] and k >= n


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(300, 330), st.integers(0, 200), st.integers(0, 200), st.booleans())
def test_equal_spans_share_a_compact_window(seed, n, a, b, periodic):
    rng = np.random.default_rng(seed)
    text = lambda k: "".join(rng.choice(list("ab "), k)) if k else ""
    span = ("abcdefg" * 60)[:n] if periodic else text(n)
    x, y = text(a) + span + text(b), text(b) + span + text(a)
    windows = []
    for _, h, c, left, right in spans._compact([x, y]):
        windows.append({(int(k), int(p)): (int(lo), int(hi)) for k, p, lo, hi in zip(h, c, left, right)})
    ours = {k for (k, p), (lo, hi) in windows[0].items() if lo <= a and a + n - spans.GRAM <= hi and a <= p <= a + n - spans.GRAM}
    theirs = {k for (k, p), (lo, hi) in windows[1].items() if lo <= b and b + n - spans.GRAM <= hi and b <= p <= b + n - spans.GRAM}
    # the window that holds the whole span, or in it any stretch of 300 characters, has one signature in both
    assert ours == theirs and {k for k, _ in windows[0]} & {k for k, _ in windows[1]}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 1000), st.floats(0, 1), st.integers(0, 5)), min_size=1), st.integers(0, 5000))
def test_water_filling_is_feasible_and_fills(sources, size):
    tokens = {s: t for s, (t, _, _) in sources.items()}
    shares = mixture.water_fill(tokens, {s: (w, c) for s, (_, w, c) in sources.items()}, size)
    for s, (_, _, cap) in sources.items():
        assert 0 <= shares[s].repeats <= cap + 1e-9
    used = sum(shares[s].repeats * tokens[s] for s in sources)
    room = sum(t * c for t, w, c in sources.values() if w > 0)
    assert used <= size + 1e-6 * max(1, size) or all(x.clamped for s, x in shares.items() if x.repeats)
    assert abs(used - min(size, room)) <= 1e-6 * max(1, size, room)
