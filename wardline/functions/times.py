"""Times as microseconds since the epoch in UTC, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?$"


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp column of either kind as microseconds; a value without zone means UTC."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(f"`{name}`"))
    if kind == "date":
        return F.unix_date(F.col(f"`{name}`")).cast("long") * F.lit(24 * HOUR)
    raise TypeError(f"{name} is no time but {kind}")


def text_micros(c: Column) -> Column:
    """Microseconds of a usable time written as text, else null.

    Usable are ISO date and time (UTC where no offset is written) and epoch
    numbers of 13 digits (ms) or 10 digits (s); the calendar time must exist.
    """
    t = F.upper(F.btrim(c, F.lit(" \t\n\r\f\x0b")))
    # the usual spellings come first and cost no further pattern
    full = (
        F.when(t.endswith("Z") | t.rlike(r"[+-]\d{2}:\d{2}$"), t)
        .when(t.rlike(r"[+-]\d{4}$") & t.contains(":"), F.regexp_replace(t, r"\s?([+-]\d{2})(\d{2})$", "$1:$2"))
        .when(t.rlike(r":\d{2}.*[+-]\d{2}$"), F.concat(t, F.lit(":00")))
        .otherwise(F.concat(t, F.lit("Z")))
    )
    with_seconds = F.when(t.rlike(r"^.{10}[T ]\d{2}:\d{2}([Z +-]|$)"), F.regexp_replace(full, r"^(.{10}[T ]\d{2}:\d{2})\s?(Z|[+-])", "$1:00$2")).otherwise(full)
    return (
        F.when(t.rlike(_ISO), F.unix_micros(with_seconds.try_cast("timestamp")))
        .when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1000)
        .when(t.rlike(r"^\d{10}$"), t.try_cast("long") * 1_000_000)
    )


def hour_start(us: Column) -> Column:
    """The start of the UTC hour."""
    return us - F.pmod(us, F.lit(HOUR))


def from_micros(us: Column) -> Column:
    """A timestamp without zone, in UTC."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(us / F.lit(1_000_000)).cast("decimal(18,6)"))
