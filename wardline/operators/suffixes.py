"""Host names and suffix tables: registered domains and indicator ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public suffix list is a few ten thousand rules; a larger table isn't broadcast.
MOST_RULES = 50_000


def ancestors(df: DataFrame, host: str) -> DataFrame:
    """One row per suffix of each host: ``suffix``, ``depth`` (labels left out before it)."""
    labels = F.split(F.col(host), r"\.")
    return df.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("depth", "suffix"))


def registered_domain(df: DataFrame, host: str, rules: DataFrame) -> DataFrame:
    """``host`` and ``registered_domain``: one label more than the longest public suffix.

    ``rules`` has a ``rule`` per row, with ``*.`` for any label and ``!`` for
    exceptions. Without a rule the last label is the suffix; a host that is a
    suffix itself, and a null host, have none (null). One row per distinct host.
    """
    known = rules.select(F.lower("rule").alias("rule")).where("rule is not null").distinct()
    if known.limit(MOST_RULES + 1).count() <= MOST_RULES:
        known = F.broadcast(known)
    hosts = df.select(F.col(host).alias("_h")).where("_h is not null").distinct()
    walked = ancestors(hosts, "_h").withColumn("_parent", F.when(F.col("suffix").contains("."), F.concat(F.lit("*."), F.regexp_replace("suffix", r"^[^.]*\.", ""))))
    keys = walked.withColumn("_key", F.explode(F.array_compact(F.array(F.col("suffix"), F.col("_parent"), F.concat(F.lit("!"), F.col("suffix"))))))
    hits = keys.join(known, F.col("_key") == F.col("rule"))
    # an exception names the registered domain itself; any other rule leaves one label before it
    at = F.when(F.col("rule").startswith("!"), F.col("depth") - 1000).otherwise(F.col("depth") - 1)
    best = hits.groupBy("_h").agg(F.min(at).alias("_at"))
    labels = F.split("_h", r"\.")
    cut = F.when(F.col("_at") < -1, F.col("_at") + 1000).otherwise(F.coalesce("_at", F.size(labels) - 2))
    return hosts.join(best, "_h", "left").select(F.col("_h").alias(host), F.when(cut >= 0, F.array_join(F.slice(labels, cut + 1, F.size(labels)), ".")).alias("registered_domain"))


def ancestor_hits(df: DataFrame, host: str, indicators: DataFrame, stops: DataFrame) -> DataFrame:
    """Distinct hosts that are an indicator or lie below one, the walk ending at public suffixes.

    ``indicators`` has ``indicator``, ``stops`` has ``rule``. Suffixes that are
    public themselves never count. Columns: ``host``, ``indicator`` (the longest).
    """
    hosts = df.select(F.col(host).alias("_h")).where("_h is not null").distinct()
    walked = ancestors(hosts, "_h").join(stops.select(F.col("rule").alias("suffix")).distinct(), "suffix", "left_anti")
    hits = walked.join(indicators.select(F.col("indicator").alias("suffix")).distinct(), "suffix")
    return hits.groupBy("_h").agg(F.min_by("suffix", "depth").alias("indicator")).withColumnRenamed("_h", host)
