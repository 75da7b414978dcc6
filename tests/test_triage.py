import random
import zlib

from pyspark.sql import functions as F

from wardline.operators import campaigns, suffixes, triage

R = triage.Rules()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def under(h, s):
    return h == s or h.endswith("." + s)


def words_of(h):
    parts = (p for label in h.split(".") for p in label.replace("_", "-").split("-"))
    return [t for t in ("".join(c for c in p if c.isalpha()) for p in parts) if t]


def hits(h, rules):
    everywhere = {*rules.infra_suffixes, *(s for own in rules.own_domains.values() for s in own)}
    found = []
    for k in rules.keywords:
        near = lambda t, k=k: len(k) > 5 and len(t) >= 4 and t[0] == k[0] and distance(t, k) <= 1
        if any(t == k or t.replace("rn", "m") == k or near(t) for t in words_of(h)) and not any(under(h, s) for s in rules.own_domains.get(k, everywhere)):
            found.append(k)
    return sorted(set(found))


HOSTS = [
    "secure-apple-id.tk", "paypai-login.top", "binanse-exchange-login.com", "micros0ft-support.tk", "rnicrosoft.com", "nzapplesandpears.com", "rappleyplumbingandheating.com", "apps.curdil.com", "box.wappl.com",
    "applied-pedagogy.com", "s3.amazonaws.com", "paypal-login.s3.amazonaws.com", "a.paypal.com.evil.tk", "accounts.google.com", "login.pages.dev", "a", "a.b", "...", "", "xn--bcher-kva.example", "Upper.Case.TOP.",
    "1234567890.99999.com", "qwertzuiopasdfghjklyxcv.com", "a-b-c-d-e.com", "l" * 60 + ".com", "ups-parcel.net", "upps.net",
]


def corpus():
    rnd = random.Random(3)
    parts = ["login", "paypal", "paypa", "pypal", "appel", "rn", "bank", "verify", "x9", "netflix", "netflixx", "office", "the", "shop"]
    tails = ["com", "tk", "top", "pages.dev", "google.com", "cloudfront.net", "amazonaws.com", "test"]
    return HOSTS + ["-".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5))) + "." + rnd.choice(tails) for _ in range(400)]


def test_keyword_hits_against_plain_python(spark):
    hosts = sorted({h.strip().lower().rstrip(".") for h in corpus()})
    df = spark.createDataFrame([(h,) for h in hosts] + [(None,)], "h string")
    got = {r["h"]: sorted(r["brands"] + r["words"]) for r in triage.keyword_hits(df, "h", triage.keyword_table(spark, R)).collect()}
    assert got == {h: x for h in hosts if (x := hits(h, R))}


def test_scores_and_routes(spark):
    df = spark.createDataFrame([(h,) for h in corpus()] + [(None,)], "domain string").withColumn("host", F.lit("clash"))
    rows = {r["host"]: r for r in triage.triage(df, "domain", R).collect()}
    assert "" in rows and rows[""]["score"] == 0 and rows[""]["reasons"] == []
    for h, r in rows.items():
        found = hits(h, R)
        brands = [k for k in found if k in R.own_domains]
        names = {x.split(":")[0] for x in r["reasons"]}
        assert ("brand_match" in names) == bool(brands) and ("sensitive_word" in names) == bool(set(found) - set(brands))
        tld = h.rsplit(".", 1)[-1] if "." in h else ""
        assert ("suspicious_tld" in names) == (tld in R.suspicious_tlds)
        assert abs(r["score"] - min(1, sum(R.weights[n] for n in names))) < 1e-9
        sampled = bool(found) or tld in R.suspicious_tlds or zlib.crc32(h.encode()) % 10000 < 1000
        assert r["decision"] == ("forward" if r["score"] >= R.pass_threshold else "spool" if sampled else "drop")
    assert "excessive_digits:0.83" in rows["1234567890.99999.com"]["reasons"]
    assert "excessive_hyphens:4" in rows["a-b-c-d-e.com"]["reasons"] and "punycode" in rows["xn--bcher-kva.example"]["reasons"]
    assert "free_subdomain_provider:pages.dev" in rows["login.pages.dev"]["reasons"] and "long_domain:64" in rows["l" * 60 + ".com"]["reasons"]


def test_everything_is_kept_at_full_rate(spark):
    df = spark.createDataFrame([("plain.test",)], "d string")
    assert triage.triage(df, "d", triage.Rules(sample_rate=1.0)).first()["decision"] == "spool"
    assert triage.triage(df.where("false"), "d").count() == 0


def test_attribution_takes_the_next_brand_on_own_domains(spark):
    brands = [("paypal", ["paypalinc"], 200), ("microsoft", ["msft"], 150), ("apple", [], 150)]
    aliases = campaigns.alias_table(spark, brands, {"paypal": ["paypal.com"]})
    df = spark.createDataFrame([("apple-msft.x",), ("paypal-apple.paypal.com",), ("paypai.x",), ("rnicrosoft.x",), ("none.x",), (None,)], "h string")
    assert {r["h"]: r["brand"] for r in campaigns.attribute(df, "h", aliases).collect()} == {"apple-msft.x": "apple", "paypal-apple.paypal.com": "apple", "paypai.x": "paypal"}
    assert campaigns.attribute(df, "h", aliases, homoglyphs=True).where("h = 'rnicrosoft.x'").first()["brand"] == "microsoft"


def test_registered_domains(spark):
    rules = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), ("pages.dev",), (None,)], "rule string")
    want = {"a.b.com": "b.com", "x.y.co.uk": "y.co.uk", "co.uk": None, "com": None, "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "q.www.ck": "www.ck", "s.pages.dev": "s.pages.dev", "host": None, "m.unknown": "m.unknown", "n.m.unknown": "m.unknown"}
    df = spark.createDataFrame([(h,) for h in want] + [(None,)], "h string")
    assert {r["h"]: r["registered_domain"] for r in suffixes.registered_domain(df, "h", rules).collect()} == want


def test_ancestor_hits_stop_at_public_suffixes(spark):
    stops = spark.createDataFrame([("com",), ("pages.dev",), ("dev",)], "rule string")
    indicators = spark.createDataFrame([("evil.com",), ("com",), ("pages.dev",), ("x.evil.com",)], "indicator string")
    df = spark.createDataFrame([("a.evil.com",), ("y.x.evil.com",), ("good.com",), ("a.pages.dev",), ("evil.com",), (None,)], "h string")
    assert {r["h"]: r["indicator"] for r in suffixes.ancestor_hits(df, "h", indicators, stops).collect()} == {"a.evil.com": "evil.com", "y.x.evil.com": "x.evil.com", "evil.com": "evil.com"}
