"""String statistics, tokens and parsing as Catalyst expressions; one Python function at the end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty text, null for null."""
    n = F.length(c)
    parts = F.transform(F.array_distinct(F.split(c, "")), lambda ch: (n - F.length(F.replace(c, ch, F.lit("")))) / n)
    bits = F.aggregate(F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(c == "", 0.0).otherwise(bits)


def count_of(c: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(c, F.lit(pattern))


def tokens(host: Column) -> Column:
    """Parts between dots, hyphens and underscores, reduced to their letters; empty ones drop out."""
    return F.filter(F.transform(F.split(host, "[._-]"), lambda t: F.regexp_replace(t, r"[^\p{L}]", "")), lambda t: t != "")


def collapse_homoglyphs(token: Column) -> Column:
    """``rn`` read as ``m``."""
    return F.replace(token, F.lit("rn"), F.lit("m"))


def edit_budget(keyword: Column) -> Column:
    """How many edits a keyword tolerates: none up to five letters, else one."""
    return F.when(F.length(keyword) <= 5, 0).otherwise(1)


def lexical_statistics(host: Column) -> dict[str, Column]:
    """Ten numbers that describe a host name."""
    n, digits, hyphens = F.length(host), count_of(host, "[0-9]"), count_of(host, "-")
    return {
        "length": n,
        "digits": digits,
        "hyphens": hyphens,
        "dots": count_of(host, r"\."),
        "digit_ratio": digits / (n + 1e-6),
        "hyphen_ratio": hyphens / (n + 1e-6),
        "entropy": entropy(host),
        "xn_punycode": host.contains("xn--").cast("int"),
        "labels": count_of(host, r"\.") + 1,
        "tld_len": F.length(F.substring_index(host, ".", -1)),
    }


def url_host(c: Column) -> Column:
    """The host of a URL of any scheme, or of a bare host, without user and port, lower-cased; null where there is none."""
    t = F.btrim(c, F.lit(" \t\n\r\f\x0b"))
    rest = F.regexp_replace(t, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.lower(host), F.lit(""))


def indicator_host(c: Column) -> Column:
    """An indicator as a host: of a URL, or cut at ``/`` then ``:``; no trailing dot, ``*.`` or ``www.``; must hold a dot."""
    t = F.lower(F.btrim(c, F.lit(" \t\n\r\f\x0b")))
    bare = F.when(t.contains("://"), url_host(t)).otherwise(F.substring_index(F.substring_index(t, "/", 1), ":", 1))
    host = F.regexp_replace(F.regexp_replace(F.rtrim(bare, F.lit(".")), r"^\*\.", ""), r"^www\.", "")
    return F.when(host.contains("."), host)


def html_title(c: Column) -> Column:
    """The first title of a page, white space collapsed, 256 characters at most; null without one."""
    t = F.btrim(F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.nullif(F.substring(t, 1, 256), F.lit(""))


def has_password_field(c: Column) -> Column:
    """Whether a page asks for a password."""
    return F.coalesce(c.rlike(r"(?i)<input[^>]+type\s*=\s*[\"']?password"), F.lit(False))


def content_fingerprint(status: Column, title: Column, password: Column) -> Column:
    """SHA-256 over status, title and password field; absent values read ``None``, truth ``True`` or ``False``."""
    return F.sha2(F.concat_ws("|", F.coalesce(status.cast("string"), F.lit("None")), F.coalesce(title, F.lit("None")), F.when(password, "True").otherwise("False")), 256)


def country_code(code: Column, name: Column) -> Column:
    """A code of 8 characters at most, else a name of 3 at most, both trimmed, else null; nothing is cut."""
    c, n = F.btrim(code), F.btrim(name)
    return F.when((c != "") & (F.length(c) <= 8), c).when((n != "") & (F.length(n) <= 3), n)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def md5_bucket(n: int, *parts: Column) -> Column:
    """One of ``n`` buckets by the MD5 of the parts, which any SQL engine has too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long") % n


def redact(c: Column, secrets: list[str]) -> Column:
    """The text with each secret masked."""
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit("***"))
    return c


def model_tag(name: Column, trained: Column) -> Column:
    """``name@yyyyMMddTHHmmssZ``, or the bare name where the time can't be read."""
    t = F.date_format(trained.try_cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
    return F.coalesce(F.concat(name, F.lit("@"), t), name)


@F.pandas_udf(StringType())
def _idna(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def encode(host: str | None) -> str | None:
        try:
            return host.encode("idna").decode("ascii") if host else host
        except UnicodeError:
            return host

    for hosts in batches:
        yield hosts.map(encode, na_action="ignore")


def idna(host: Column) -> Column:
    """The ASCII form of a host, best effort; there is no built-in, so only names that need it go to Python."""
    return F.when(host.rlike(r"[^\x00-\x7f]"), _idna(F.when(host.rlike(r"[^\x00-\x7f]"), host))).otherwise(host)
