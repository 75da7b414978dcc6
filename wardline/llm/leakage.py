"""Evaluation texts leaking into training text: winnowed fingerprints, extended hits.

Both sides are read as words (maximal runs of Unicode letters and digits,
lower-cased). Of every ``WINDOW`` consecutive hashes of ``GRAM`` words the least is
kept, on both sides by the same rule, so a shared run of GRAM + WINDOW - 1 words
always shares a kept hash. Hits are extended word by word to the whole shared run.

The test side's fingerprints go to every task, ``MOST_SHIPPED`` at a time: a larger
test side is cut into slices, and the corpus is one pass without a shuffle for
each. No fingerprint is a key of a shuffle, so one that every text has costs no
task more than others.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import windows as K
from wardline.shipping import ship

GRAM, SHARED_WORDS = 5, 12
WINDOW = SHARED_WORDS - GRAM + 1
MOST_SHIPPED = 1_000_000
#: Hits that are extended at a time, some 100 MB.
HITS = 1 << 20
BATCH_CHARS = 1 << 21
SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, words int"


class Sums:
    """Prefix sums of a sequence of words, by which any two stretches compare at once."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = K.powers(len(words))
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(K.mix(words) * up[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the ``n`` words from each start."""
        return (self.sums[start + n] - self.sums[start]) * self.down[start]


class Items:
    """The test side: words, and fingerprints sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids = np.asarray(ids, dtype=np.int64)
        self.words, self.offsets = K.word_arrays(texts)
        self.sums = Sums(self.words)
        grams, item, place = _fingerprints(self.words, self.offsets)
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], place[order]

    def __getstate__(self) -> dict:
        # what can be computed again doesn't travel
        return {k: v for k, v in self.__dict__.items() if k != "sums"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.sums = Sums(self.words)


def _fingerprints(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes of each text, the text's number and the place in all words."""
    grams = K.gram_hashes(words, GRAM)
    marked = np.zeros(len(grams), dtype=bool)
    for start, stop in K.pieces(len(grams), WINDOW):
        marked[start + K.window_minima(grams[start:stop], WINDOW)] = True
    place = np.flatnonzero(marked)
    text = np.searchsorted(offsets, place, side="right") - 1
    inside = place + GRAM <= offsets[text + 1]
    place, text = place[inside], text[inside]  # windows over two texts only add to what is kept
    return grams[place], text, place


def _longest(most: np.ndarray, same: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Per hit the greatest length up to ``most`` at which the two stretches are the same, by halving."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        good = same(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def _extend(sums: Sums, offsets: np.ndarray, text: np.ndarray, place: np.ndarray, items: Items, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, item, start in text, start in item, words) of runs of at least SHARED_WORDS, each once."""
    back = np.minimum(place - offsets[text], at - items.offsets[item])
    ahead = np.minimum(offsets[text + 1] - place, items.offsets[item + 1] - at)
    left = _longest(back, lambda n: sums.of(place - n, n) == items.sums.of(at - n, n))
    right = _longest(ahead, lambda n: sums.of(place, n) == items.sums.of(at, n))
    long = left + right >= SHARED_WORDS
    rows = np.stack([text, item, place - left - offsets[text], at - left - items.offsets[item], left + right], axis=1)[long]
    return np.unique(rows, axis=0)


def matches(texts: list[str], items: Items) -> np.ndarray:
    """Shared runs of a batch of texts with all items; see ``_extend``."""
    words, offsets = K.word_arrays(texts)
    grams, text, place = _fingerprints(words, offsets)
    first = np.searchsorted(items.grams, grams, side="left")
    many = np.searchsorted(items.grams, grams, side="right") - first
    hit = np.flatnonzero(many)
    if not len(hit):
        return np.empty((0, 5), dtype=np.int64)
    sums = Sums(words)
    ends = np.cumsum(many[hit])
    found = []
    for low in range(0, int(ends[-1]), HITS):
        k = np.arange(low, min(low + HITS, int(ends[-1])))
        x = np.searchsorted(ends, k, side="right")
        which = hit[x]
        entry = first[which] + (k - (ends[x] - many[which]))
        found.append(_extend(sums, offsets, text[which], place[which], items, items.item[entry], items.place[entry]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found), axis=0)


def batches_of(ids: Iterator[tuple[list, list[str | None]]], most: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Regroup (ids, texts) so that a group has about ``most`` characters; null texts are left out."""
    held_ids, held, size = [], [], 0
    for some_ids, texts in ids:
        for i, t in zip(some_ids, texts):
            if not t:
                continue
            held_ids.append(i)
            held.append(t)
            size += len(t)
            if size >= most:
                yield held_ids, held
                held_ids, held, size = [], [], 0
    if held:
        yield held_ids, held


def _rows(ids: list[int], found: np.ndarray, items: Items) -> pa.RecordBatch:
    doc = np.asarray(ids, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[found[:, 0]]), pa.array(items.ids[found[:, 1]]), *(pa.array(found[:, k].astype(np.int32)) for k in (2, 3, 4))], ["doc_id", "item_id", "doc_start", "item_start", "words"]
    )


def _prepared(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    return docs, items


def leaks(docs: DataFrame, items: DataFrame, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """All maximal runs of at least SHARED_WORDS words that a document shares with a test item.

    ``doc_id``, ``item_id``, the word each run starts with in either text (from 0),
    and its ``words``. Null texts and texts of fewer words have none; empty tables
    give no rows; other columns are not read. Repeated documents each count.
    ``most_shipped`` only chooses the number of passes, not the result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs, items = _prepared(docs, items)
    chars, n_items = items.agg(F.sum(F.length("text")), F.count("*")).first()
    # a word takes two characters at least, and of WINDOW + 1 fingerprints two are kept on average
    slices = min(max(n_items, 1), math.ceil((chars or 0) / (WINDOW + 1) / max(most_shipped, 1)) or 1)
    passes = []
    for i in range(slices):
        mine = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i)
        table = mine.orderBy("item_id").toArrow()  # bounded by most_shipped fingerprints on average
        if table.num_rows or not i:
            passes.append(docs.mapInArrow(_finder(spark.sparkContext.broadcast(Items(table.column("item_id").to_pylist(), table.column("text").to_pylist()))), SCHEMA))
    return functools.reduce(DataFrame.unionByName, passes)


def _finder(side) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches_of((b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for b in batches):
            yield _rows(ids, matches(texts, side.value), side.value)

    return find
