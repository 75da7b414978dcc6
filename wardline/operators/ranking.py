"""Evaluation of rankings: precision at K, ROC and PR area, thresholds, budgets.

Whatever needs a running total over a whole ranking is first aggregated to
distinct score levels, and these to blocks; the one-partition window runs over
blocks, of which there are at most a million between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DIGITS = 6


def levels(rows: DataFrame, score: Column, positive: Column, weight: Column | None = None, digits: int | None = None) -> DataFrame:
    """Per score level, highest first: rows, positives, weight, and their running totals.

    Levels are the exact scores, or scores rounded to ``digits`` where that is
    enough. Running totals are taken within blocks of scores that agree to
    ``BLOCK_DIGITS``, plus the totals of the blocks above, so no window runs over all levels.
    """
    w = F.lit(1.0) if weight is None else weight
    per = rows.select((score if digits is None else F.round(score, digits)).alias("score"), positive.cast("long").alias("p"), w.alias("w")).where("score is not null and not isnan(score)")
    per = per.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.coalesce("p", F.lit(0))).alias("n_pos"), F.sum("w").alias("weight")).withColumn("_block", F.round("score", BLOCK_DIGITS))
    totals = per.groupBy("_block").agg(F.sum("n").alias("_n"), F.sum("n_pos").alias("_p"), F.sum("weight").alias("_w"))
    over = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    above = totals.select("_block", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in ("_n", "_p", "_w")])
    down = Window.partitionBy("_block").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = per.join(above, "_block")
    return both.select("score", "n", "n_pos", "weight", (F.col("_n") + F.sum("n").over(down)).alias("above"), (F.col("_p") + F.sum("n_pos").over(down)).alias("above_pos"), (F.col("_w") + F.sum("weight").over(down)).alias("above_weight"))


def precision_at(rows: DataFrame, score: str, positive: Column, key: str, ks: Sequence[int]) -> DataFrame:
    """Per K: rows looked at, hits among them, precision. Ties by key; a missing label is no hit."""
    top = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).alias("s"), F.col(key).alias("k"), positive.alias("p")).orderBy(F.col("s").desc(), "k").limit(max(ks))
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.col("s").desc(), "k")))
    each = ranked.withColumn("top", F.explode(F.array(*[F.lit(k) for k in ks]))).where("r <= top")
    got = each.groupBy("top").agg(F.count("*").alias("n_evaluated"), F.count_if(F.coalesce("p", F.lit(False))).alias("n_hits"))
    return got.select(F.col("top").alias("k"), "n_evaluated", "n_hits", (F.col("n_hits") / F.col("n_evaluated")).alias("precision"))


def areas(per_level: DataFrame) -> DataFrame:
    """One row: ROC area by rank sums with ties halved, average precision, positives, negatives; null areas without both classes."""
    total = Window.partitionBy()
    t = per_level.withColumns({"all_pos": F.sum("n_pos").over(total), "all_neg": F.sum(F.col("n") - F.col("n_pos")).over(total)})
    negatives = F.col("n") - F.col("n_pos")
    beaten = F.col("all_neg") - (F.col("above") - F.col("above_pos"))
    sums = t.agg(
        F.max("all_pos").alias("n_pos"),
        F.max("all_neg").alias("n_neg"),
        F.sum(F.col("n_pos") * beaten + F.col("n_pos") * negatives / 2).alias("u"),
        F.sum(F.col("n_pos") * F.col("above_pos") / F.col("above")).alias("ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select("n_pos", "n_neg", F.round(F.when(both, F.col("u") / (F.col("n_pos") * F.col("n_neg"))), 8).alias("roc_auc"), F.round(F.when(both, F.col("ap") / F.col("n_pos")), 8).alias("average_precision"))


def threshold_at_fpr(per_level: DataFrame, most: float) -> DataFrame:
    """One row: the lowest threshold whose false-positive rate is at most ``most``, and the recall there."""
    total = Window.partitionBy()
    t = per_level.withColumns({"all_pos": F.sum("n_pos").over(total), "all_neg": F.sum(F.col("n") - F.col("n_pos")).over(total)})
    ok = t.where((F.col("above") - F.col("above_pos")) / F.col("all_neg") <= most)
    return ok.agg(F.min("score").alias("threshold"), F.round(F.max(F.col("above_pos") / F.col("all_pos")), 8).alias("recall"))


def budget(per_level: DataFrame, volume: float) -> DataFrame:
    """One row: the lowest threshold whose weight at or above it is at most ``volume``, and the share of positives in that volume.

    The level that crosses the volume counts in proportion for the share, since ties have no order.
    """
    total = Window.partitionBy()
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(float(volume)) - (F.col("above_weight") - F.col("weight"))) / F.col("weight")))
    t = per_level.withColumns({"all_pos": F.sum("n_pos").over(total), "_got": F.col("n_pos") * part})
    return t.agg(F.min(F.when(F.col("above_weight") <= volume, F.col("score"))).alias("threshold"), F.round(F.sum("_got") / F.max("all_pos"), 8).alias("recall"))
