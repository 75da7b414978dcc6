"""Measures of review: current verdicts, rates with their sample size, time to the first look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates over fewer cases are marked as noisy.
LOW_SAMPLE = 10


def current_verdicts(dispositions: DataFrame) -> DataFrame:
    """Per cluster the verdict of its greatest ``id``, the newest entry whatever its time says."""
    return dispositions.where("cluster_id is not null").groupBy("cluster_id").agg(F.max_by("verdict", "id").alias("verdict"))


def sample_note(n: Column) -> Column:
    """What a number of cases allows to say."""
    return F.when(n == 0, "none").when(n < LOW_SAMPLE, "low").otherwise("ok")


def confirmation_rate(dispositions: DataFrame) -> DataFrame:
    """One row with the share of reviewed clusters whose current verdict is ``confirmed``; null without any."""
    one = current_verdicts(dispositions).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "confirmed").alias("n_confirmed"))
    return one.select("n", "n_confirmed", F.round(F.col("n_confirmed") / F.nullif("n", F.lit(0)), 4).alias("rate"), sample_note(F.col("n")).alias("note"))


def median_hours_to_review(clusters: DataFrame, dispositions: DataFrame) -> DataFrame:
    """One row with the median hours from a cluster's creation to its first verdict, none below 0; times in microseconds."""
    first = dispositions.groupBy("cluster_id").agg(F.min("created_at").alias("_first"))
    hours = F.greatest(F.lit(0.0), (F.col("_first") - F.col("created_at")) / F.lit(3.6e9))
    return clusters.join(first, clusters["id"] == first["cluster_id"]).agg(F.count("*").alias("n"), F.round(F.percentile(hours, 0.5), 2).alias("median_hours"))


def per_day(clusters: DataFrame, now: int, window_days: int = 7) -> DataFrame:
    """One row with clusters per day over the window, or over the history where that is shorter (a day at least)."""
    day = 86_400_000_000
    one = clusters.agg(F.min("created_at").alias("_first"), F.count_if(F.col("created_at") >= now - window_days * day).alias("n_in_window"))
    span = F.greatest(F.lit(1.0), F.least(F.lit(float(window_days)), (F.lit(now) - F.col("_first")) / F.lit(float(day))))
    return one.select("n_in_window", F.round(F.col("n_in_window") / span, 2).alias("per_day"))


def suppression_rate(clusters: DataFrame) -> DataFrame:
    """One row with the share of all clusters, reviewed or not, that are at stage ``suppressed``; null without any."""
    one = clusters.agg(F.count("*").alias("n_total"), F.count_if(F.col("stage") == "suppressed").alias("n_suppressed"))
    return one.select("n_total", "n_suppressed", F.round(F.col("n_suppressed") / F.nullif("n_total", F.lit(0)), 4).alias("rate"))
