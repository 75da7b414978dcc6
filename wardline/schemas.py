"""Declared schemas, and fitting tables of drifting shape to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("tld", T.StringType()),
        T.StructField("event_ts", T.StringType()),
        T.StructField("producer_ts", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("triage_score", T.DoubleType()),
        T.StructField("triage_reasons", T.ArrayType(T.StringType())),
    ]
)
CERTIFICATE = "data struct<leaf_cert: struct<all_domains: array<string>>>"
SILVER = T.StructType([T.StructField(c, T.StringType()) for c in ("domain", "url", "label", "source")] + [T.StructField("first_seen", T.TimestampType())])
INDICATOR = T.StructType([T.StructField(c, T.StringType()) for c in ("indicator", "type", "category", "orgc", "event_id", "tags", "galaxies", "source")])


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> tuple[DataFrame, list[str]]:
    """The table with exactly the schema's columns, cast where possible (else null), and the names that were added.

    Names compare without case; columns the schema doesn't know are dropped.
    """
    have = {c.lower(): c for c in df.columns}
    added = [f.name for f in schema.fields if f.name.lower() not in have]
    fill = defaults or {}

    def column(f: T.StructField) -> Column:
        base = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(fill.get(f.name))
        return base.try_cast(f.dataType).alias(f.name)

    return df.select(*map(column, schema.fields)), added


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that the table has, or null without any."""
    have = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
