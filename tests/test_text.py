import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.functions import hosts as H
from wardline.functions import text as X
from wardline.functions.times import from_micros, micros, text_micros


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, want",
    [(" *.A.Test.. ", "a.test"), ("*.*.b.test", "*.b.test"), ("", ""), (None, None), ("...", ""), ("\tx.y\n", "x.y"), ("*.", "*")],
)
def test_clean_host(spark, given, want):
    assert one(spark, given, H.clean_host) == want


@pytest.mark.parametrize("given, want", [(None, True), (" ", True), ("NaN", True), (" None", True), ("nano", False), ("0", False)])
def test_missing(spark, given, want):
    assert one(spark, given, H.is_missing) == want


@pytest.mark.parametrize("s", ["", "aaaaaaaa", "abababab", "héllo wörld", "x" * 5000 + "y", "a.b-c"])
def test_entropy(spark, s):
    n = Counter(s)
    want = -sum(c / len(s) * math.log2(c / len(s)) for c in n.values()) if s else 0.0
    assert one(spark, s, X.entropy) == pytest.approx(want, abs=1e-9)


def test_tokens_lose_digits_and_break_at_marks(spark):
    assert one(spark, "secure-apple1id_x.t2k..--9", X.tokens) == ["secure", "appleid", "x", "tk"]
    assert one(spark, "", X.tokens) == []


@pytest.mark.parametrize(
    "given, want",
    [
        ("https://User:pw@Host.Test:8443/a?b=http://c.d", "host.test"),
        ("ftp://h.test", "h.test"),
        ("h.test/path:1", "h.test"),
        ("h.test:80", "h.test"),
        ("", None),
        (None, None),
        ("//", None),
    ],
)
def test_url_host(spark, given, want):
    assert one(spark, given, X.url_host) == want


@pytest.mark.parametrize("given, want", [("http://www.a.test/x", "a.test"), ("*.b.test.", "b.test"), ("c.test:8080/x", "c.test"), ("localhost", None), (None, None)])
def test_indicator_host(spark, given, want):
    assert one(spark, given, X.indicator_host) == want


def test_pages(spark):
    page = "<TITLE lang='x'>\n A \n  B </title><input name=p type='Password'>"
    assert one(spark, page, X.html_title) == "A B"
    assert one(spark, page, X.has_password_field) is True
    assert one(spark, None, X.has_password_field) is False
    assert one(spark, "<p>", X.html_title) is None
    assert len(one(spark, f"<title>{'t' * 1000}</title>", X.html_title)) == 256
    got = one(spark, page, lambda c: X.content_fingerprint(F.lit(200), X.html_title(c), X.has_password_field(c)))
    assert got == hashlib.sha256(b"200|A B|True").hexdigest()
    assert one(spark, None, lambda c: X.content_fingerprint(F.lit(None), c, F.lit(False))) == hashlib.sha256(b"None|None|False").hexdigest()


def test_idna(spark):
    assert one(spark, "bücher.example", X.idna) == "xn--bcher-kva.example"
    assert one(spark, "plain.example", X.idna) == "plain.example"
    assert one(spark, None, X.idna) is None


def test_small_functions(spark):
    assert one(spark, "x key y", lambda c: X.redact(c, ["key"])) == "x *** y"
    assert one(spark, float("inf"), X.finite, "double") is None and one(spark, 1.5, X.finite, "double") == 1.5
    assert one(spark, "2026-08-01T10:00:00Z", lambda c: X.model_tag(F.lit("m"), c)) == "m@20260801T100000Z"
    assert one(spark, "soon", lambda c: X.model_tag(F.lit("m"), c)) == "m"
    assert one(spark, "Germany", lambda c: X.country_code(F.lit(None), c)) is None
    assert one(spark, "UK", lambda c: X.country_code(F.lit("toolongcode"), c)) == "UK"
    stats = spark.createDataFrame([("a-1.b",)], "h string").select(*[v.alias(k) for k, v in X.lexical_statistics(F.col("h")).items()]).first()
    assert (stats["length"], stats["digits"], stats["hyphens"], stats["dots"], stats["labels"], stats["tld_len"]) == (5, 1, 1, 1, 2, 1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        us = 1785715200_123456
        given = {
            "2026-08-03T00:00:00.123456Z": us,
            "2026-08-03 00:00:00.123456": us,
            "2026-08-03T05:30:00.123456+05:30": us,
            "2026-08-02T20:00:00.123456-0400": us,
            "2026-08-02T20:00:00-04": us - 123456,
            "2026-08-03T00:00": us - 123456,
            " 1785715200 ": us - 123456,
            "1785715200123": us - 456,
            "2026-02-30T00:00:00Z": None,
            "2026-08-03": None,
            "2026-08-03T24:61:00Z": None,
            "178571520": None,
            "yesterday": None,
            "": None,
        }
        df = spark.createDataFrame([(k,) for k in given], "t string").select("t", text_micros(F.col("t")).alias("u"))
        assert {r["t"]: r["u"] for r in df.collect()} == given
        back = df.select("u", from_micros(F.col("u")).alias("n")).where("u is not null")
        assert back.select(F.count_if(micros(back, "n") != F.col("u"))).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
