"""References to records that do not exist: a merge of sorted, co-partitioned streams.

References and parent keys are hashed to the same partitions, sorted by key and
merged linearly: the sort-merge join asked for by hint. A parent key carries a
validity interval, from its creation to its deletion (open where it still
exists), and the interval tells missing, deleted and late targets apart. Parent
keys are unique before the merge, so a key that holds a third of the references
adds rows to one side only; where the session has adaptive execution (the
default), such a partition is split and its few parent rows are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = 2**63 - 1


def parent_intervals(key: Column, created: Column, parents: DataFrame, gone_key: Column | None = None, gone_at: Column | None = None, gone: DataFrame | None = None) -> DataFrame:
    """One row per parent key: ``key``, ``valid_from``, ``valid_to`` (both in microseconds).

    An existing parent is valid from its creation on, whatever a log of deletions
    says of an earlier one of the same key. A key that is only in the log was valid
    until its last logged deletion; ``valid_from`` is null then.
    """
    both = parents.select(key.alias("key"), created.alias("born"), F.lit(None).cast("long").alias("died"), F.lit(1).alias("here"))
    if gone is not None:
        both = both.unionByName(gone.select(gone_key.alias("key"), F.lit(None).cast("long").alias("born"), F.coalesce(gone_at, F.lit(0)).alias("died"), F.lit(0).alias("here")))
    per_key = both.where("key is not null").groupBy("key").agg(F.max("here").alias("here"), F.min("born").alias("valid_from"), F.max("died").alias("died"))
    return per_key.select("key", "valid_from", F.when(F.col("here") == 1, F.lit(FOREVER)).otherwise(F.col("died")).alias("valid_to"))


def orphans(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """References whose target doesn't hold, with ``kind``; the columns of ``refs`` stay.

    ``refs`` has ``key`` and ``at`` (microseconds) beside what is to be kept; a
    column of its own named ``kind`` is replaced. A null key refers to nothing and
    is no orphan. ``missing``: no such parent was ever known; ``deleted``: only the
    log of deletions knows it; ``late``: it was created after the reference. A
    creation or reference time of null counts as in time. Without parents all keys
    are missing; without references there are no rows.
    """
    kept = [c for c in refs.columns if c != "kind"]
    inner = refs.where("key is not null").select("key", "at", F.struct(*kept).alias("ref"))
    parents = intervals.select(F.col("key").alias("_key"), "valid_from", "valid_to")
    merged = inner.join(parents.hint("merge"), F.col("key") == F.col("_key"), "left")
    kind = F.when(F.col("_key").isNull(), "missing").when(F.col("valid_to") != FOREVER, "deleted").when(F.col("valid_from") > F.col("at"), "late")
    return merged.select("ref.*", kind.alias("kind")).where("kind is not null")
