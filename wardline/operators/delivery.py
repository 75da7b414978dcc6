"""Messages delivered more than once: exact quotient hash tables.

The identifier of a message (its trimmed id and its cleaned host) becomes a
fixed-width word of 128 bits. A bijection permutes the word; its leading bits,
the quotient, name the shard and the home slot there, and the slot stores the
complete rest, the remainder, with its distance from home. Quotient and
remainder together are the whole word, so a table hit is a hit of all 128 bits;
the identifier's text is compared then too, so there are no false matches.

Messages are inserted in order of arrival, so the copy that stays is the one
with the earliest arrival and, at equal times, the lowest row id. Each input
chunk first inserts into a table of its own: of a message that holds a third of
the log, every chunk sends on one copy, and no shard gets more than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.hosts import clean_host, trimmed
from wardline.functions.times import micros
from wardline.scratch import shuffle_width
from wardline.shipping import ship

CHUNK_ROWS = 200_000
ROWS_PER_SHARD = 400_000
#: A task takes several shards one after the other where there are more than this, so that mappers times tasks stays bounded.
MOST_TASKS = 20_000
_U = np.uint64


def permute(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of 128-bit words: four Feistel rounds of 64-bit halves."""
    high, low = high.copy(), low.copy()
    for key in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
        mixed = (low ^ _U(key)) * _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        mixed *= _U(0xD6E8FEB86659FD93)
        mixed ^= mixed >> _U(32)
        high, low = low, high ^ mixed
    return high, low


class QuotientTable:
    """An exact set of 128-bit words with the text each stands for; grows at half load."""

    def __init__(self, bits: int = 12) -> None:
        self.texts = np.empty(1 << bits, dtype=object)
        self.count = 0
        self._words = np.empty((2, 1 << bits), dtype=np.uint64)
        self._rows = np.empty(1 << bits, dtype=np.int64)
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits = bits
        size = 1 << bits
        self.owner = np.full(size, -1, dtype=np.int64)
        self.distance = np.zeros(size, dtype=np.int32)
        self.rest_high = np.zeros(size, dtype=np.uint64)
        self.rest_low = np.zeros(size, dtype=np.uint64)

    def _place(self, high: np.ndarray, low: np.ndarray, texts: np.ndarray | None, number: np.ndarray) -> np.ndarray:
        """Insert words in order; ``number`` is where each one's text lies. Gives the number under which each now stands."""
        slots, shift = (1 << self.bits) - 1, _U(64 - self.bits)
        home = (high >> shift).astype(np.int64)
        rest = high & _U((1 << (64 - self.bits)) - 1)
        stands = np.full(len(high), -1, dtype=np.int64)
        away = np.zeros(len(high), dtype=np.int32)
        todo = np.arange(len(high))
        while len(todo):
            slot = (home[todo] + away[todo]) & slots
            owner = self.owner[slot]
            taken = owner >= 0
            same = taken & (self.distance[slot] == away[todo]) & (self.rest_high[slot] == rest[todo]) & (self.rest_low[slot] == low[todo])
            if texts is None:  # a rebuild: all stored words stand for different texts
                same[:] = False
            elif same.any():
                hit = np.flatnonzero(same)
                same[hit] = self.texts[owner[hit]] == texts[todo[hit]]
            stands[todo[same]] = owner[same]
            away[todo[taken & ~same]] += 1
            open_ = np.flatnonzero(~taken)
            at, first = np.unique(slot[open_], return_index=True)
            won = todo[open_[first]]
            self.owner[at] = number[won]
            self.distance[at] = away[won]
            self.rest_high[at] = rest[won]
            self.rest_low[at] = low[won]
            stands[won] = number[won]
            todo = todo[stands[todo] < 0]
        return stands

    def insert(self, high: np.ndarray, low: np.ndarray, texts: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Insert identifiers in order: which were not yet there, and the row that first brought each."""
        need = self.count + len(high)
        if need * 2 > 1 << self.bits:
            self._clear(max(self.bits + 1, int(need * 2 - 1).bit_length()))
            self.texts = np.concatenate([self.texts[: self.count], np.empty((1 << self.bits) - self.count, dtype=object)])
            self._words = np.concatenate([self._words[:, : self.count], np.empty((2, (1 << self.bits) - self.count), dtype=np.uint64)], axis=1)
            self._rows = np.concatenate([self._rows[: self.count], np.empty((1 << self.bits) - self.count, dtype=np.int64)])
            self._place(*self._words[:, : self.count], None, np.arange(self.count))
        # numbers go out before it is known which words are new, and are packed afterwards
        number = np.arange(self.count, need)
        self.texts[self.count : need] = texts
        stands = self._place(high, low, texts, number)
        new = stands == number
        kept = np.flatnonzero(new)
        packed = self.count + np.arange(len(kept))
        back = np.full(len(high), -1, dtype=np.int64)
        back[kept] = packed
        moved = self.owner >= self.count
        self.owner[moved] = back[self.owner[moved] - self.count]
        self.texts[packed] = texts[kept]
        self.texts[self.count + len(kept) : need] = None
        self._words[0, packed], self._words[1, packed] = high[kept], low[kept]
        if rows is not None:
            self._rows[packed] = rows[kept]
        self.count += len(kept)
        late = stands >= self.count - len(kept)
        stands[late] = back[stands[late] - (need - len(high))]
        return new, self._rows[stands]


def _columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    high, low, ts, row = (batch.column(k).to_numpy(**({"zero_copy_only": False} if isinstance(batch, pa.RecordBatch) else {})) for k in ("high", "low", "ts", "row"))
    texts = np.array(batch.column("ident").to_pylist(), dtype=object)
    return high.view(np.uint64), low.view(np.uint64), ts, row, texts


def _settle(chunk: pa.Table, bits: int) -> pa.RecordBatch:
    """Mark the copies that a chunk of the input can tell by itself."""
    high, low, ts, row, texts = _columns(chunk)
    high, low = permute(high, low)
    order = np.lexsort((row, ts))
    new, first = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=np.int64)
    new[order], first[order] = QuotientTable().insert(high[order], low[order], texts[order], row[order])
    apart_from_repeats = new | (first != row)  # a row that comes again is no copy of itself
    high, low, ts, row, texts, new = (x[apart_from_repeats] for x in (high, low, ts, row, texts, new))
    # a settled copy needs no shard: it travels alone, spread by its row id
    apart = permute(row.view(np.uint64), row.view(np.uint64))[0]
    shard = (np.where(new, high, apart) >> _U(64 - bits)).astype(np.int64)
    texts[~new] = None
    return pa.RecordBatch.from_arrays(
        [pa.array(shard), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(ts), pa.array(row), pa.array(texts, pa.string()), pa.array(~new)],
        ["shard", "high", "low", "ts", "row", "ident", "copy"],
    )


def _within_chunks(most: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield _settle(pa.Table.from_batches(held), bits)
                held, rows = [], 0
        if rows:
            yield _settle(pa.Table.from_batches(held), bits)

    return run


def _within_shards(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per shard, which comes in order of arrival: insert the rest once each, give back the row ids of copies; a shard's table ends with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = QuotientTable(), None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            found = []
            for start, stop in zip(cuts, cuts[1:]):
                if shard[start] != at:
                    table, at = QuotientTable(), shard[start]
                part = batch.slice(start, stop - start)
                settled = part.column("copy").to_numpy(zero_copy_only=False)
                found.append(part.column("row").to_numpy(zero_copy_only=False)[settled])
                rest = part.filter(pa.array(~settled))
                if rest.num_rows:
                    high, low, _, row, texts = _columns(rest)
                    # the leading bits named the shard; the home slot is named by those after them
                    new, first = table.insert((high << _U(bits)) | (high >> _U(64 - bits)), low, texts, row)
                    found.append(row[~new & (first != row)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["row"])

    return run


def identifier(id_: Column, host: Column) -> Column:
    """The text that two copies share; null for a message without id, which has no copies."""
    i = trimmed(id_)
    return F.when(i != "", F.concat(F.length(i).cast("string"), F.lit(":"), i, F.coalesce(clean_host(host), F.lit(""))))


def shards_and_tasks(rows: int, rows_per_shard: int, width: int) -> tuple[int, int]:
    """Bits that name a shard, and tasks. Tasks are the session's ``width``, or more for more rows up to ``MOST_TASKS``; shards are eight a task at least."""
    wanted = max(1, -(-rows // rows_per_shard))
    tasks = min(max(wanted, width), max(width, MOST_TASKS))
    return max(4, (max(wanted, 8 * tasks) - 1).bit_length()), tasks


def copies(df: DataFrame, id_col: str = "id", host_col: str = "domain", arrival: str = "ingest_ts", row_id: str = "kafka_offset", chunk_rows: int = CHUNK_ROWS, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Row ids of every copy but the kept one, in a column named as ``row_id``.

    Messages with the same trimmed id and the same cleaned host (null counts as
    empty) are one message; a null or empty id makes a message of its own. Kept
    is the earliest arrival, then the lowest row id; an arrival of null counts as
    the latest. ``row_id`` must be unique: rows that repeat one are taken for the
    same row and stay or go together; rows without one take no part and stay. An
    empty log has no copies; further columns are not read. ``chunk_rows`` and ``rows_per_shard`` only bound memory.
    """
    spark = df.sparkSession
    ship(spark)
    ident = identifier(F.col(f"`{id_col}`"), F.col(f"`{host_col}`"))
    rows = df.select(
        ident.alias("ident"),
        F.coalesce(micros(df, arrival), F.lit(2**63 - 1)).alias("ts"),
        F.col(f"`{row_id}`").cast("long").alias("row"),
    ).where("ident is not null and row is not null")
    words = rows.select(F.xxhash64("ident").alias("high"), F.xxhash64(F.lit(7), "ident").alias("low"), "ts", "row", "ident")
    # rows are counted from the files' footers; no column is read
    bits, tasks = shards_and_tasks(df.count(), rows_per_shard, shuffle_width(spark, 0, 1))
    chunked = words.mapInArrow(_within_chunks(chunk_rows, bits), "shard long, high long, low long, ts long, row long, ident string, copy boolean")
    found = chunked.repartition(tasks, "shard").sortWithinPartitions("shard", "ts", "row").mapInArrow(_within_shards(bits), "row long")
    return found.select(F.col("row").alias(row_id))


def deliver_once(df: DataFrame, id_col: str = "id", host_col: str = "domain", arrival: str = "ingest_ts", row_id: str = "kafka_offset") -> DataFrame:
    """The log with exactly one row per message, all columns as they are; see ``copies``."""
    gone = copies(df, id_col, host_col, arrival, row_id)
    return df.join(gone, row_id, "left_anti")
