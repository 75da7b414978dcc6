"""Column expressions on host names and free text, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def trimmed(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Trimmed and lower-cased: how brands, sources, user names and registrars compare."""
    return F.lower(trimmed(c))


def is_missing(c: Column) -> Column:
    """Null, or after trimming and lower-casing empty, ``nan`` or ``none``."""
    return c.isNull() | folded(c).isin("", "nan", "none")


def present(c: Column) -> Column:
    """The folded text, or null where the value is missing."""
    return F.when(~is_missing(c), folded(c))


def clean_host(c: Column) -> Column:
    """Trimmed, lower-cased, without trailing dots, then without one leading ``*.``."""
    bare = F.rtrim(folded(c), F.lit("."))
    return F.when(bare.startswith("*."), F.substring(bare, 3, 1 << 20)).otherwise(bare)


def clean_host_all_wildcards(c: Column) -> Column:
    """The batch normaliser's variant: every ``*.`` is removed, wherever it stands."""
    return F.replace(F.rtrim(folded(c), F.lit(".")), F.lit("*."), F.lit(""))


def present_host(c: Column) -> Column:
    """The cleaned host, or null where the value is missing or nothing is left of it."""
    host = clean_host(c)
    return F.when(~is_missing(c) & (host != ""), host)


def digits(c: Column) -> Column:
    """The digits of an AS number, so that spellings compare equal; null without digits."""
    only = F.regexp_replace(c, "[^0-9]", "")
    return F.when(only != "", only)


def is_host(c: Column) -> Column:
    """Whether all characters may stand in a host name or pattern."""
    return c.rlike(r"^[A-Za-z0-9\-\._*]+$")


def last_label(host: Column) -> Column:
    """The text after the last dot, or null for a name without dots."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def under(host: Column, suffix: Column) -> Column:
    """Whether the host is the suffix or lies below it."""
    return (host == suffix) | host.endswith(F.concat(F.lit("."), suffix))
