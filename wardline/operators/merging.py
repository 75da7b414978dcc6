"""Upserts, lookups and queues as joins over snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order, which should be total. Nulls in keys are keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """``old`` with ``new`` merged in by keys: ``replace`` columns take the new value even if null, ``fill`` columns only where it isn't.

    ``new`` must be unique by keys (see ``keep_first``); keys compare null-safe.
    Columns are the keys, ``replace`` and ``fill``.
    """
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), condition, "full")
    is_new = F.col("n._new").isNotNull()
    out = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in [*keys, *replace]]
    return joined.select(*out, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fill])


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks, once per key by their smallest row."""
    fresh = keep_first(new, keys, [F.col(c) for c in new.columns if c not in keys]).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose keys ``new`` doesn't have."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def update_where(df: DataFrame, condition: Column, changes: Mapping[str, Column]) -> DataFrame:
    """The rows with some columns set where a condition holds (null doesn't), such as a soft delete."""
    holds = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(holds, v).otherwise(F.col(c)) for c, v in changes.items()})


def fresh_lookup(rows: DataFrame, cache: DataFrame, key: str, fetched: Column, now: int, ttl: int) -> DataFrame:
    """``rows`` with all cache rows of their key younger than ``ttl``; ``hit`` tells them from misses and expired ones.

    ``fetched``, ``now`` and ``ttl`` are microseconds; ``outcome`` is ``hit``, ``expired`` or ``miss``.
    """
    seen = cache.withColumns({"_fetched": fetched}).where("_fetched is not null")
    fresh = seen.where(F.col("_fetched") > now - ttl).withColumn("_hit", F.lit(True)).drop("_fetched")
    stale = seen.select(key).distinct().withColumn("_stale", F.lit(True))
    joined = rows.join(fresh, key, "left").join(stale, key, "left")
    return joined.withColumn("outcome", F.when(F.col("_hit"), "hit").when(F.col("_stale"), "expired").otherwise("miss")).drop("_hit", "_stale")


def claim_oldest(queue: DataFrame, status: str, enqueued: str, key: str, n: int, to: str = "processing") -> DataFrame:
    """The queue with its ``n`` oldest pending items claimed."""
    taken = queue.where(F.col(status) == "pending").orderBy(enqueued, key).limit(n).select(key).withColumn("_taken", F.lit(True))
    return queue.join(taken, key, "left").withColumn(status, F.when(F.col("_taken"), to).otherwise(F.col(status))).drop("_taken")


def requeue_failed(queue: DataFrame, status: str, attempts: str, most: int = 3) -> DataFrame:
    """Items in processing go back to pending with one more attempt, or to failed at the last."""
    busy = F.col(status) == "processing"
    tried = F.col(attempts) + F.when(busy, 1).otherwise(0)
    return queue.select(*[c for c in queue.columns if c not in (status, attempts)], F.when(busy & (tried >= most), "failed").when(busy, "pending").otherwise(F.col(status)).alias(status), tried.alias(attempts))


def queue_depth(queue: DataFrame, status: str, enqueued: str, now: int) -> DataFrame:
    """Per status the items, the oldest enqueue time and its age in seconds; times in microseconds."""
    per = queue.groupBy(status).agg(F.count("*").alias("n"), F.min(enqueued).alias("oldest"))
    return per.select(status, "n", "oldest", ((F.lit(now) - F.col("oldest")) / F.lit(1e6)).alias("lag_seconds"))


def complete(queue: DataFrame, done: DataFrame, status: str, key: str) -> DataFrame:
    """Items in processing whose key is in ``done`` become done."""
    finished = done.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_done", F.lit(True))
    ends = F.col("_done") & (F.col(status) == "processing")
    return queue.join(finished, key, "left").withColumn(status, F.when(ends, "done").otherwise(F.col(status))).drop("_done").select(*queue.columns)


def recover_stale(queue: DataFrame, status: str) -> DataFrame:
    """After a crash, what was in processing is pending again; attempts don't change."""
    return queue.withColumn(status, F.when(F.col(status) == "processing", "pending").otherwise(F.col(status)))


def failed_ledger(queue: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """The queue without its failed items, and these as the ledger."""
    failed = F.coalesce(F.col(status) == "failed", F.lit(False))
    return queue.where(~failed), queue.where(failed)


def not_in_flight(items: DataFrame, queue: DataFrame, key: str, status: str) -> DataFrame:
    """Items whose key isn't pending or in processing; items with a null key stay."""
    return items.join(queue.where(F.col(status).isin("pending", "processing")).select(key), key, "left_anti")


def of_keys(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys, all together, are in ``wanted``; each once however often the keys come there. A null in a key meets nothing."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def touched_parents(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], members: DataFrame, row_id: str, parent: str) -> DataFrame:
    """The distinct parents that have a member among the stored rows of the wanted composite keys."""
    return members.join(of_keys(stored, wanted, keys).select(row_id), row_id, "left_semi").select(parent).where(F.col(parent).isNotNull()).distinct()


def lineage(rows: DataFrame, source: str, expected: Sequence[str]) -> DataFrame:
    """Per source of a union its rows ``n`` and their ``share``, sources that are ``missing`` with 0 rows; raises ``ValueError`` where there is no row at all.

    Rows without a source are listed under null. One missing source stops nothing.
    """
    total = rows.count()
    if not total:
        raise ValueError(f"no rows of any source ({', '.join(sorted(expected))})")
    per = rows.groupBy(source).agg(F.count("*").alias("n"))
    asked = rows.sparkSession.createDataFrame([(s,) for s in sorted(set(expected))], f"`{source}` string")
    both = per.join(asked, source, "full")
    return both.select(source, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.lit(float(total)), 8).alias("share"), F.col("n").isNull().alias("missing"))
