"""Labels, bands and rules that turn a number or a name into a word."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.text import count_of

# Last labels that the baseline counts as risky, and those whose registries answer reliably.
RISKY_TLDS = ["top", "xyz", "cn", "cyou", "sbs", "icu", "click", "cfd", "gq", "tk", "ml", "cc", "buzz", "rest", "beauty", "bar", "lol"]
RELIABLE_TLDS = ["com", "net", "org"]


def preferred(first: Column, second: Column) -> Column:
    """The first text where it isn't blank, else the second, else the empty text; the one chosen stays as it is."""
    return F.when(F.btrim(first) != "", first).when(F.btrim(second) != "", second).otherwise("")


def verdict(score: Column, brand_hit: Column) -> Column:
    """What a score says; bounds are exclusive, and a brand hit lifts the lowest verdict by one. A null score counts as none reached."""
    hit = F.coalesce(brand_hit, F.lit(False))
    return (
        F.when(score > 0.99, "CONFIRMED_MALICIOUS_INFRA")
        .when(score > 0.90, "IMMINENT_PHISHING_THREAT")
        .when(score > 0.70, "HIGH_PROBABILITY_STAGING")
        .when((score > 0.40) | hit, "SUSPICIOUS_PATTERN")
        .otherwise("BASELINE_NORMAL")
    )


def level(score: Column, brand_hit: Column) -> Column:
    """Three levels; a brand hit is high whatever the score."""
    return F.when(score > 0.90, "CRITICAL").when((score > 0.70) | F.coalesce(brand_hit, F.lit(False)), "HIGH").otherwise("CLEAN")


def baseline_score(domain: Column, risky: Sequence[str] = RISKY_TLDS) -> Column:
    """The rule that any model must beat: 0.5 for a risky last label, 0.3 for four digits in a row, 0.2 for two hyphens; null counts as empty."""
    d = F.coalesce(domain, F.lit(""))
    tld = F.lower(F.substring_index(d, ".", -1))
    return F.when(tld.isin(list(risky)), 0.5).otherwise(0.0) + F.when(d.rlike("[0-9]{4,}"), 0.3).otherwise(0.0) + F.when(count_of(d, "-") >= 2, 0.2).otherwise(0.0)


def tld_bucket(domain: Column, reliable: Sequence[str] = RELIABLE_TLDS) -> Column:
    """P25: ``reliable`` or ``other`` by the last label; names without a dot, and null, are other."""
    known = domain.contains(".") & F.lower(F.substring_index(domain, ".", -1)).isin(list(reliable))
    return F.when(known, "reliable").otherwise("other")


def _one_digit(x: Column) -> Column:
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def freshness(minutes: Column) -> Column:
    """An age in minutes as text; null is unknown. Halves round up."""
    return (
        F.when(minutes.isNull(), "unknown")
        .when(minutes < 60, F.concat(F.floor(minutes + 0.5).cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(_one_digit(minutes / 60), F.lit("h ago")))
        .otherwise(F.concat(_one_digit(minutes / 1440), F.lit("d ago")))
    )


def confidence_parts(confidence: Column, members: Column) -> tuple[Column, Column, Column]:
    """The highest risk and the corroboration that a confidence stands for, and whether it is at its limit; all null for null."""
    corroboration = F.lit(0.7) + F.lit(0.3) * F.least(members, F.lit(10)) / F.lit(10.0)
    known = confidence.isNotNull()
    return F.when(known, F.least(F.lit(1.0), confidence / corroboration)), F.when(known, corroboration), F.when(known, confidence >= 0.9999)


def label_of(source: Column, benign: str = "benign_seed") -> Column:
    """SC16: 0 for the benign source, 1 for any other, a missing one too."""
    return F.when(source == benign, 0).otherwise(1)
