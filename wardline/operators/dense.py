"""A few keys holding most rows: dense accumulator arrays.

Every input split encodes its keys by a dictionary of its own and adds its rows
into dense arrays by code (``numpy.bincount`` and scatter-reduce), whatever the
keys' frequencies; a split therefore costs what its rows cost. What leaves it is
one entry per key and split. Entries are dealt to blocks by key and sorted in
them; a block encodes the keys of one batch at a time, sums the arrays of all
splits and gives a key away as soon as the next one comes, so it holds a batch's
keys however many the block has. Where a key is in every split, that is as many
entries as splits and no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.shipping import ship

#: A split gives its arrays on when its dictionary has so many keys, and starts anew.
DICTIONARY_KEYS = 500_000
_PARTS = "key string, n long, n_valued long, total long, least double, most double"
_SCHEMA = pa.schema([("key", pa.string()), ("n", pa.int64()), ("n_valued", pa.int64()), ("total", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])


class Accumulators:
    """Dense arrays over a growing dictionary of keys."""

    def __init__(self) -> None:
        self.codes: dict[str | None, int] = {}
        self.room = 0
        self._grow(1024)

    def _grow(self, room: int) -> None:
        def wider(a: np.ndarray | None, fill: float, kind: type) -> np.ndarray:
            b = np.full(room, fill, dtype=kind)
            if a is not None:
                b[: self.room] = a
            return b

        old = self.room > 0
        self.n = wider(self.n if old else None, 0, np.int64)
        self.n_valued = wider(self.n_valued if old else None, 0, np.int64)
        self.total = wider(self.total if old else None, 0, np.int64)
        self.least = wider(self.least if old else None, np.inf, np.float64)
        self.most = wider(self.most if old else None, -np.inf, np.float64)
        self.room = room

    def encode(self, keys: pa.Array) -> np.ndarray:
        """Codes of the keys; the batch's own dictionary is looked up once per distinct key."""
        local = pc.dictionary_encode(keys, null_encoding="encode")
        codes = self.codes
        known = np.fromiter((codes.setdefault(k, len(codes)) for k in local.dictionary.to_pylist()), dtype=np.int64, count=len(local.dictionary))
        if len(codes) > self.room:
            self._grow(max(2 * self.room, len(codes)))
        return known[local.indices.to_numpy()]

    def add_rows(self, keys: pa.Array, values: np.ndarray, units: np.ndarray) -> None:
        """Rows of the input: count each, and fold in those with a value (not NaN)."""
        code = self.encode(keys)
        size = len(self.codes)
        self.n[:size] += np.bincount(code, minlength=size)
        good = ~np.isnan(values)
        code, values, units = code[good], values[good], units[good]
        self.n_valued[:size] += np.bincount(code, minlength=size)
        np.add.at(self.total, code, units)
        np.minimum.at(self.least, code, values)
        np.maximum.at(self.most, code, values)

    def add_parts(self, batch: pa.RecordBatch) -> None:
        """Entries that splits gave on."""
        code = self.encode(batch.column("key"))
        for name, fold in (("n", np.add), ("n_valued", np.add), ("total", np.add), ("least", np.minimum), ("most", np.maximum)):
            fold.at(getattr(self, name), code, batch.column(name).to_numpy())

    def give(self) -> Iterator[pa.RecordBatch]:
        size = len(self.codes)
        if size:
            yield from pa.Table.from_arrays([pa.array(self.codes, pa.string()), *(pa.array(getattr(self, k)[:size]) for k in _SCHEMA.names[1:])], schema=_SCHEMA).to_batches(max_chunksize=20_000)


def _splits(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulators()
        for batch in batches:
            acc.add_rows(batch.column("key"), batch.column("value").to_numpy(zero_copy_only=False), batch.column("units").to_numpy(zero_copy_only=False))
            if len(acc.codes) >= most:
                yield from acc.give()
                acc = Accumulators()
        yield from acc.give()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum entries that come sorted by key; the last key of a batch waits for the next one."""
    acc = Accumulators()
    for batch in batches:
        if not batch.num_rows:
            continue
        acc.add_parts(batch)
        last = batch.column("key")[-1].as_py()
        for part in acc.give():
            is_last = pc.equal(part.column("key"), last) if last is not None else pc.is_null(part.column("key"))
            is_last = pc.fill_null(is_last, False)
            done = part.filter(pc.invert(is_last))
            if done.num_rows:
                yield done
            if done.num_rows < part.num_rows:
                waiting = part.filter(is_last)
        acc = Accumulators()
        acc.add_parts(waiting)
    yield from acc.give()


def per_key(df: DataFrame, key: Column, value: Column | None = None, scale: int = 1_000_000, dictionary_keys: int = DICTIONARY_KEYS) -> DataFrame:
    """Per key: rows ``n``, rows with a value ``n_valued``, their ``total``, ``least`` and ``most``.

    Null is a key like any other. Values that are null or NaN only count in
    ``n``; a key without values has null as total, least and most. The total adds
    values rounded to ``1/scale``, in whole numbers, so that it is the same in
    every order. An empty table has no keys. ``dictionary_keys`` only bounds a
    split's memory; a block's is bounded by a batch.
    """
    ship(df.sparkSession)
    v = (F.lit(None) if value is None else value).cast("double")
    v = F.coalesce(v, F.lit(float("nan")))
    rows = df.select(key.cast("string").alias("key"), v.alias("value"), F.when(F.isnan(v), 0).otherwise(F.round(v * scale)).cast("long").alias("units"))
    parts = rows.mapInArrow(_splits(dictionary_keys), _PARTS)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = parts.repartition(width, F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(_blocks, _PARTS)
    some = F.col("n_valued") > 0
    return sums.select("key", "n", "n_valued", F.when(some, F.col("total") / F.lit(scale)).alias("total"), F.when(some, F.col("least")).alias("least"), F.when(some, F.col("most")).alias("most"))


def heavy_keys(df: DataFrame, key: Column, percent: int = 5) -> DataFrame:
    """Keys (not null) that hold at least ``percent`` of 100 rows, counting all rows."""
    total = df.count()
    return per_key(df, key).where(F.col("key").isNotNull() & (F.col("n") * 100 >= F.lit(percent * total))).select("key", "n")
