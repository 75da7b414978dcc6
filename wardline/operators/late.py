"""Late and out-of-order events: event-time periods corrected until a cut-off.

Each record carries the time it happened and the time it arrived. A period is
open until ``lateness`` after its end; its aggregate is then emitted, and every
record that arrives later but within ``cutoff`` of the end corrects it: the
keyed state of the period is updated and upserted again, with the next revision.
What arrives beyond the cut-off changes nothing and is diverted. The watermark
of a record is its own arrival time, so the outcome doesn't depend on how the
log is cut into batches, and a replay of the log equals the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.times import HOUR, MINUTE, from_micros

PERIOD, LATENESS, CUTOFF = HOUR, 10 * MINUTE, 24 * HOUR


def route(df: DataFrame, event: Column, arrival: Column, period: int = PERIOD, lateness: int = LATENESS, cutoff: int = CUTOFF) -> DataFrame:
    """Add ``period_start``, ``arrived`` (microseconds) and ``outcome`` to each record with both times.

    ``on_time``: in the period's first result; ``corrects``: changes it later;
    ``rejected``: beyond the cut-off. Records without a usable time are left out:
    nobody can tell their period. Early records are on time. Columns that already
    have one of the three names are replaced.
    """
    # a generator computes both times once; conditions on them would otherwise be pushed
    # below the projection and parse the texts again and again
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("period_start", "arrived", "outcome")]
    timed = df.select(*kept, F.inline(F.array(F.struct(event.alias("period_start"), arrival.alias("arrived"))))).where("period_start is not null and arrived is not null")
    timed = timed.withColumn("period_start", F.col("period_start") - F.pmod("period_start", F.lit(period)))
    behind = F.col("arrived") - (F.col("period_start") + period)
    return timed.withColumn("outcome", F.when(behind <= lateness, "on_time").when(behind <= cutoff, "corrects").otherwise("rejected"))


def _revisions(routed: DataFrame, keys: list[str], step: int = HOUR, period: int = PERIOD, lateness: int = LATENESS) -> DataFrame:
    """The keyed state after each step that changes it: counts so far per key and period, ``_step`` null for the diverted records, which come last."""
    fired = F.col("period_start") + period + lateness
    after = F.when(F.col("outcome") == "on_time", F.lit(0).cast("long")).when(F.col("outcome") == "corrects", F.ceil((F.col("arrived") - fired) / F.lit(step)).cast("long"))
    kinds = {"n": F.col("outcome") != "rejected", "n_corrections": F.col("outcome") == "corrects", "n_rejected": F.col("outcome") == "rejected"}
    deltas = routed.withColumn("_step", after).groupBy(*keys, "period_start", "_step").agg(*[F.count_if(c).alias(f"_{k}") for k, c in kinds.items()])
    in_order = Window.partitionBy(*keys, "period_start").orderBy(F.col("_step").asc_nulls_last())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select(*keys, "period_start", "_step", (F.row_number().over(in_order) - 1).alias("revision"), from_micros(fired + F.col("_step") * step).alias("emitted_at"), *[F.sum(f"_{k}").over(so_far).alias(k) for k in kinds])


def upserts(routed: DataFrame, keys: list[str], step: int = HOUR, period: int = PERIOD, lateness: int = LATENESS) -> DataFrame:
    """What the keyed state emits: per key and period, its first result and each corrected one.

    Corrections that arrive in the same ``step`` (counted from the first result)
    are emitted together. Columns: the keys, ``period_start``, ``revision`` (0 for
    the first result; a period that only got late records starts at its first
    correction), ``emitted_at``, ``n`` and ``n_corrections`` so far. Records are
    pre-aggregated before the shuffle, so a hot key costs as many rows as it has
    periods and steps. A null in a key is a key of its own.
    """
    return _revisions(routed.where("outcome <> 'rejected'"), keys, step, period, lateness).drop("_step", "n_rejected")


def current(routed: DataFrame, keys: list[str]) -> DataFrame:
    """The state after all upserts, with the rejected beside it: ``n``, ``n_corrections``, ``n_rejected``.

    It is the last of the revisions that ``upserts`` emits. A period whose records
    were all rejected is reported with ``n`` 0.
    """
    last = F.max_by(F.struct("n", "n_corrections", "n_rejected"), "revision")
    return _revisions(routed, keys).groupBy(*keys, "period_start").agg(last.alias("_last")).select(*keys, "period_start", "_last.*")
