"""Triage of host names: fuzzy keyword join, nine rules, score, routing.

The keyword match is a theta join on edit distance, run as an equi-join: every
token gives its candidate keys (itself, its collapsed form, first letter with
length), every keyword the keys it can be met under, and only key hits are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.hosts import under
from wardline.functions.text import collapse_homoglyphs, count_of, edit_budget, entropy, tokens

# The default rules' words, lists and weights, which results depend on.
SUSPICIOUS_TLDS = ["tk", "top", "xyz", "icu", "cfd", "rest", "gq", "ml", "buzz", "cn", "work", "click", "link", "live", "monster", "quest", "sbs", "cyou", "bond", "lol", "zip", "mov"]
KEYWORDS = [
    "paypal", "apple", "appleid", "microsoft", "amazon", "google", "netflix", "facebook", "instagram", "whatsapp", "coinbase", "binance", "bank", "login", "signin", "secure",
    "verify", "account", "wallet", "update", "support", "billing", "invoice", "password", "fedex", "ups", "dhl", "usps", "chase", "wellsfargo", "hsbc", "bankofamerica",
    "santander", "metamask", "ledger", "outlook", "office", "onedrive", "teams", "crypto", "blockchain",
]
PROVIDERS = [
    "duckdns.org", "repl.co", "web.app", "firebaseapp.com", "pages.dev", "netlify.app", "vercel.app", "herokuapp.com", "github.io", "glitch.me", "000webhostapp.com", "weebly.com",
    "blogspot.com", "wordpress.com", "azurewebsites.net", "no-ip.org",
]
OWN_DOMAINS = {
    "amazon": ["amazonaws.com", "amazon.com", "media-amazon.com", "ssl-images-amazon.com", "amazontrust.com", "amazon.dev", "aws.dev"],
    "google": ["google.com", "googleapis.com", "gstatic.com", "googleusercontent.com", "googlevideo.com", "withgoogle.com", "google-analytics.com", "googletagmanager.com", "1e100.net"],
    "microsoft": ["microsoft.com", "microsoftonline.com", "windows.net", "azureedge.net", "office.com", "office365.com", "live.com", "msn.com", "microsoft-int.com", "microsoft-falcon.net", "ppe-microsoft-falcon.net", "microsoft"],
    "apple": ["apple.com", "cdn-apple.com", "icloud.com", "mzstatic.com"],
    "facebook": ["facebook.com", "fbcdn.net", "fb.com"],
    "instagram": ["instagram.com", "cdninstagram.com", "fbcdn.net"],
    "whatsapp": ["whatsapp.com", "whatsapp.net"],
    "netflix": ["netflix.com", "nflxvideo.net", "nflximg.net", "nflxext.com"],
    "paypal": ["paypal.com", "paypalobjects.com"],
    "coinbase": ["coinbase.com"],
    "binance": ["binance.com", "binance.org"],
    "deloitte": ["deloitte.com", "deloitte.co.uk", "deloitte.ca", "deloitte.de"],
    "fedex": ["fedex.com"],
    "ups": ["ups.com"],
    "dhl": ["dhl.com"],
    "usps": ["usps.com"],
    "chase": ["chase.com"],
    "wellsfargo": ["wellsfargo.com"],
    "hsbc": ["hsbc.com", "hsbc.co.uk"],
    "bankofamerica": ["bankofamerica.com"],
    "santander": ["santander.com"],
    "metamask": ["metamask.io"],
    "ledger": ["ledger.com"],
    "outlook": ["outlook.com"],
    "office": ["office.com", "office365.com"],
    "onedrive": ["onedrive.com", "onedrive.live.com"],
    "teams": ["teams.microsoft.com"],
}
INFRA_SUFFIXES = ["cloudfront.net", "akamaized.net", "akamaihd.net", "fastly.net", "cloudflare.net"]
WEIGHTS = {
    "suspicious_tld": 0.0431,
    "high_entropy": 0.1076,
    "brand_match": 0.3044,
    "sensitive_word": 0.2835,
    "excessive_hyphens": 0.0473,
    "excessive_digits": 0.027,
    "long_domain": 0.0,
    "punycode": 0.0,
    "free_subdomain_provider": 0.1872,
}


@dataclass
class Rules:
    """Everything triage is configured by; the defaults are the fixed values above."""

    suspicious_tlds: list[str] = field(default_factory=lambda: SUSPICIOUS_TLDS)
    keywords: list[str] = field(default_factory=lambda: KEYWORDS)
    providers: list[str] = field(default_factory=lambda: PROVIDERS)
    own_domains: dict[str, list[str]] = field(default_factory=lambda: OWN_DOMAINS)
    infra_suffixes: list[str] = field(default_factory=lambda: INFRA_SUFFIXES)
    weights: dict[str, float] = field(default_factory=lambda: WEIGHTS)
    pass_threshold: float = 0.198
    sample_rate: float = 0.1
    bypass_brand: bool = True
    bypass_tld: bool = True
    entropy_threshold: float = 3.8
    max_hyphens: int = 3
    max_digit_ratio: float = 0.3
    max_length: int = 45


def keyword_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``key``, ``keyword``, ``is_brand``, ``exempt`` (the suffixes it is silent under): one row per key of a keyword."""
    everywhere = sorted({*rules.infra_suffixes, *(s for own in rules.own_domains.values() for s in own)})
    rows = [(k, k in rules.own_domains, rules.own_domains.get(k, everywhere)) for k in dict.fromkeys(rules.keywords)]
    table = spark.createDataFrame(rows, "keyword string, is_brand boolean, exempt array<string>")
    fuzzy = F.when(edit_budget(F.col("keyword")) > 0, F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(F.substring("keyword", 1, 1), (F.length("keyword") + d).cast("string"))))
    return table.select(F.explode(F.concat(F.array(F.concat(F.lit("="), "keyword")), F.coalesce(fuzzy, F.array().cast("array<string>")))).alias("key"), "keyword", "is_brand", "exempt")


def keyword_hits(df: DataFrame, host: str, keywords: DataFrame, homoglyphs: bool = True) -> DataFrame:
    """``host``, ``brands``, ``words``: the keywords each distinct host matches, sorted; hosts without any are absent.

    A token meets a keyword exactly, with ``rn`` read as ``m``, or, from four
    letters on and with the same first letter, within the keyword's edit budget.
    Brands are silent on their own domains, other words on all exempt ones.
    """
    hosts = df.select(F.col(host).alias("_h")).where("_h is not null").distinct()
    each = hosts.select("_h", F.explode(F.array_distinct(tokens(F.col("_h")))).alias("_t"))
    exact = [F.concat(F.lit("="), "_t")] + ([F.concat(F.lit("="), collapse_homoglyphs(F.col("_t")))] if homoglyphs else [])
    near = F.when(F.length("_t") >= 4, F.concat(F.substring("_t", 1, 1), F.length("_t").cast("string")))
    keyed = each.select("_h", "_t", F.explode(F.array_distinct(F.array_compact(F.array(*exact, near)))).alias("key"))
    met = keyed.join(F.broadcast(keywords), "key")  # a few rows per configured keyword
    met = met.where(F.col("key").startswith("=") | (F.levenshtein("_t", "keyword", 1) >= 0))
    loud = met.where(~F.exists("exempt", lambda s: under(F.col("_h"), s)))
    found = loud.groupBy("_h").agg(
        F.array_sort(F.collect_set(F.when(F.col("is_brand"), F.col("keyword")))).alias("brands"),
        F.array_sort(F.collect_set(F.when(~F.col("is_brand"), F.col("keyword")))).alias("words"),
    )
    return found.withColumnRenamed("_h", host)


def normalized(c: Column) -> Column:
    """Trimmed, lower-cased, without trailing dots; empty for null."""
    return F.rtrim(F.lower(F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\f\x0b"))), F.lit("."))


def triage(df: DataFrame, host: str, rules: Rules | None = None) -> DataFrame:
    """One row per distinct normalized host: ``host``, ``score``, ``reasons``, ``decision``.

    ``forward`` from the threshold on; below it ``spool`` where sampled (by CRC-32, with
    bypasses for suspicious TLDs and keyword hits), else ``drop``. A weight of 0
    leaves its rule in the reasons. The empty host fires nothing.
    """
    r = rules or Rules()
    spark = df.sparkSession
    hosts = df.select(normalized(F.col(host)).alias("_h")).distinct()
    hits = keyword_hits(hosts, "_h", keyword_table(spark, r))
    h = F.col("_h")
    labels = F.split(h, r"\.")
    inner = F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels)
    core = F.aggregate(inner, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    digits, alnum = count_of(h, r"\p{Nd}"), F.greatest(count_of(h, r"[\p{L}\p{N}]"), F.lit(1))
    provider = F.get(F.filter(F.array(*[F.lit(p) for p in r.providers]), lambda p: under(h, p)), F.lit(0))
    tld = F.when(h.contains("."), F.substring_index(h, ".", -1))
    facts = hosts.join(hits, "_h", "left").withColumns(
        {"_tld": tld, "_core": core, "_entropy": entropy(core), "_hyphens": count_of(h, "-"), "_ratio": digits / alnum, "_provider": provider, "_puny": h.rlike(r"(^|\.)xn--")}
    )
    named = {
        "suspicious_tld": F.when(F.col("_tld").isin(r.suspicious_tlds), F.concat(F.lit("suspicious_tld:"), "_tld")),
        "high_entropy": F.when((F.length("_core") >= 8) & (F.col("_entropy") >= r.entropy_threshold), F.format_string("high_entropy:%.2f", "_entropy")),
        "brand_match": F.when(F.size("brands") > 0, F.concat(F.lit("brand_match:"), F.array_join("brands", ","))),
        "sensitive_word": F.when(F.size("words") > 0, F.concat(F.lit("sensitive_word:"), F.array_join("words", ","))),
        "excessive_hyphens": F.when(F.col("_hyphens") > r.max_hyphens, F.format_string("excessive_hyphens:%d", "_hyphens")),
        "excessive_digits": F.when(F.col("_ratio") > r.max_digit_ratio, F.format_string("excessive_digits:%.2f", "_ratio")),
        "long_domain": F.when(F.length(h) > r.max_length, F.format_string("long_domain:%d", F.length(h))),
        "punycode": F.when(F.col("_puny"), F.lit("punycode")),
        "free_subdomain_provider": F.when(F.col("_provider").isNotNull(), F.concat(F.lit("free_subdomain_provider:"), "_provider")),
    }
    fired = facts.withColumns({f"_{k}": v for k, v in named.items()})
    total = sum((F.when(F.col(f"_{k}").isNotNull(), r.weights.get(k, 0.0)).otherwise(0.0) for k in named), F.lit(0.0))
    scored = fired.withColumns({"score": F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), "reasons": F.array_compact(F.array(*[F.col(f"_{k}") for k in named]))})
    sampled = F.lit(r.sample_rate >= 1) | (F.crc32(h.cast("binary")) % 10000 < int(r.sample_rate * 10000))
    if r.bypass_tld:
        sampled = sampled | F.col("_suspicious_tld").isNotNull()
    if r.bypass_brand:
        sampled = sampled | F.col("_brand_match").isNotNull() | F.col("_sensitive_word").isNotNull()
    decision = F.when(F.col("score") >= r.pass_threshold, "forward").when(sampled, "spool").otherwise("drop")
    return scored.select(h.alias("host"), "score", "reasons", decision.alias("decision"))
