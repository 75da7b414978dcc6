"""Campaign assembly: brand attribution, clusters, membership scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import under
from wardline.functions.text import collapse_homoglyphs, edit_budget, tokens
from wardline.scratch import materialize


#: Distinct hosts of one campaign that a task compares with all of the campaign's.
HOSTS_PER_TASK = 1000
#: Registrar rules are written by people, one at a time; more than this are refused.
MOST_PATTERNS = 1000


def alias_table(spark: SparkSession, brands: Sequence[tuple[str, Sequence[str], int]], own: Mapping[str, Sequence[str]]) -> DataFrame:
    """``key``, ``alias``, ``brand``, ``priority``, ``own``: one row per key an alias can be met under."""
    rows = [(a.lower(), name.lower(), prio, list(own.get(name.lower(), []))) for name, aliases, prio in brands for a in dict.fromkeys([name, *aliases]) if a]
    table = spark.createDataFrame(rows, "alias string, brand string, priority int, own array<string>")
    near = F.when(edit_budget(F.col("alias")) > 0, F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(F.substring("alias", 1, 1), (F.length("alias") + d).cast("string"))))
    return table.select(F.explode(F.concat(F.array(F.concat(F.lit("="), "alias")), F.coalesce(near, F.array().cast("array<string>")))).alias("key"), "alias", "brand", "priority", "own")


def attribute(df: DataFrame, host: str, aliases: DataFrame, homoglyphs: bool = False) -> DataFrame:
    """``host``, ``brand``: the brand of highest priority (then the first by name) a distinct host imitates.

    A brand is skipped for hosts on its own domains, and the next one counts.
    Hosts that imitate none, and null hosts, are absent.
    """
    hosts = df.select(F.col(host).alias("_h")).where("_h is not null").distinct()
    each = hosts.select("_h", F.explode(F.array_distinct(tokens(F.lower("_h")))).alias("_t"))
    exact = [F.concat(F.lit("="), "_t")] + ([F.concat(F.lit("="), collapse_homoglyphs(F.col("_t")))] if homoglyphs else [])
    near = F.when(F.length("_t") >= 4, F.concat(F.substring("_t", 1, 1), F.length("_t").cast("string")))
    met = each.select("_h", "_t", F.explode(F.array_distinct(F.array_compact(F.array(*exact, near)))).alias("key")).join(F.broadcast(aliases), "key")  # a few rows per configured alias
    met = met.where((F.col("key").startswith("=") | (F.levenshtein("_t", "alias", 1) >= 0)) & ~F.exists("own", lambda s: under(F.col("_h"), s)))
    return met.groupBy("_h").agg(F.min(F.struct((-F.col("priority")).alias("p"), F.col("brand").alias("b"))).alias("m")).select(F.col("_h").alias(host), F.col("m.b").alias("brand"))


def lexical_family(host: Column) -> Column:
    """The last label and whether the host has three or more hyphens."""
    tld = F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")
    return F.concat(tld, F.lit(":"), F.when(F.regexp_count(host, F.lit("-")) >= 3, "h").otherwise("l"))


def cluster_key(brand: Column, day: Column, family: Column) -> Column:
    """SHA-1 of brand, UTC day and family."""
    return F.sha1(F.concat_ws("|", brand, day, family))


def confidence(risk: Column, n: Column) -> Column:
    """The highest risk, tempered by how many members corroborate it."""
    return F.least(F.lit(1.0), risk * (F.lit(0.7) + F.lit(0.3) * F.least(n, F.lit(10)) / F.lit(10.0)))


def assemble(candidates: DataFrame, attributed: DataFrame) -> DataFrame:
    """Clusters of candidates (``id``, ``host``, ``at`` microseconds, ``day``, ``risk_score``) by brand, day and family."""
    named = candidates.join(attributed, "host").withColumn("family", lexical_family(F.col("host")))
    per = named.groupBy("brand", "day", "family").agg(F.count("*").alias("n_members"), F.max("risk_score").alias("max_risk"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    return per.select("brand", "day", "family", cluster_key(F.col("brand"), F.col("day"), F.col("family")).alias("cluster_key"), "n_members", "max_risk", "first_seen", "last_seen", F.round(confidence(F.col("max_risk"), F.col("n_members")), 8).alias("confidence"))


def summary_text(n: Column, brand: Column, day: Column, family: Column) -> Column:
    """A cluster in one sentence."""
    return F.format_string("%d domain(s) impersonating %s in a cert-issuance burst on %s (family %s)", n.cast("long"), brand, day, family)


def merge_clusters(existing: DataFrame, made: DataFrame) -> DataFrame:
    """M3: clusters made from new candidates merged into the existing ones of the same key; none is split or dropped.

    Both have ``cluster_key``, ``brand``, ``day``, ``family``, ``n_members``,
    ``max_risk``, ``first_seen``, ``last_seen``, each key once. Times are widened (a
    null one gives way), members are added up, and the confidence is that of the
    higher risk and all members. ``outcome`` is ``created``, ``merged`` or ``kept``.
    """
    both = existing.withColumn("_old", F.lit(1)).unionByName(made.withColumn("_old", F.lit(0)), allowMissingColumns=True)
    per = both.groupBy("cluster_key").agg(
        *[F.max_by(c, "_old").alias(c) for c in ("brand", "day", "family")], F.sum("n_members").alias("n_members"), F.max("max_risk").alias("max_risk"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("_old").alias("_low"), F.max("_old").alias("_high"),
    )
    outcome = F.when(F.col("_high") == 0, "created").when(F.col("_low") == 0, "merged").otherwise("kept")
    return per.select("cluster_key", "brand", "day", "family", "n_members", "max_risk", "first_seen", "last_seen", F.round(confidence(F.col("max_risk"), F.col("n_members")), 8).alias("confidence"), outcome.alias("outcome"))


def workflow(members: DataFrame, group: str, host: str, keywords: DataFrame) -> DataFrame:
    """``group``, ``workflow``: the category of least ``priority`` any member's token meets, else ``generic``.

    ``keywords`` has ``keyword``, ``category``, ``priority``.
    """
    near = F.when(edit_budget(F.col("keyword")) > 0, F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(F.substring("keyword", 1, 1), (F.length("keyword") + d).cast("string"))))
    keyed = keywords.select(F.explode(F.concat(F.array(F.concat(F.lit("="), "keyword")), F.coalesce(near, F.array().cast("array<string>")))).alias("key"), "keyword", "category", "priority")
    each = members.select(group, F.explode(tokens(F.lower(F.col(host)))).alias("_t")).distinct()
    fuzzy = F.when(F.length("_t") >= 4, F.concat(F.substring("_t", 1, 1), F.length("_t").cast("string")))
    met = each.select(group, "_t", F.explode(F.array_compact(F.array(F.concat(F.lit("="), "_t"), fuzzy))).alias("key")).join(F.broadcast(keyed), "key")  # a few rows per configured keyword
    best = met.where(F.col("key").startswith("=") | (F.levenshtein("_t", "keyword", 1) >= 0)).groupBy(group).agg(F.min_by("category", "priority").alias("workflow"))
    return members.select(group).distinct().join(best, group, "left").select(group, F.coalesce("workflow", F.lit("generic")).alias("workflow"))


def membership_scores(members: DataFrame, decimals: int = 4) -> DataFrame:
    """A score of how well each member fits its cluster's other members.

    ``members``: ``cluster_id``, ``observation_id`` (unique pairs), ``host``, ``at``
    (microseconds), ``asn``, ``registrar``. The score is 0.30 + 0.25 burst + 0.20
    lexical + 0.15 network + 0.10 registrar. Burst is nearness to the upper median
    of the others' times (0.5 without any), lexical the mean edit similarity to the
    others' distinct hosts weighted by their frequency, the last two the share of
    others, among those that have one, with the same value.

    Equal hosts, networks and registrars are counted per cluster first, so the one
    pairwise step, which the definition asks for, is between distinct hosts of a
    cluster; its pairs are summed as they are met and never kept. No window runs
    over a whole cluster: the middle is found by minutes, of which only the central ones are sorted.
    """
    m, _ = materialize(members.select("cluster_id", "observation_id", "host", "at", F.lower("asn").alias("asn"), F.lower("registrar").alias("registrar")), "members")

    def with_overlap(df: DataFrame, c: str) -> DataFrame:
        same = m.where(F.col(c).isNotNull()).groupBy("cluster_id", c).agg(F.count("*").alias("_same"))
        having = same.groupBy("cluster_id").agg(F.sum("_same").alias("_having"))
        share = F.when(F.col(c).isNull() | (F.coalesce("_having", F.lit(0)) <= 1), 0.0).otherwise((F.col("_same") - 1) / (F.col("_having") - 1))
        return df.join(same, ["cluster_id", c], "left").join(having, "cluster_id", "left").withColumn(f"_{c}", share).drop("_same", "_having")

    # the others' upper median is the whole's element at n/2, or the one before it, by whether one's own place is before it
    minute = F.floor(F.col("at") / F.lit(60_000_000))
    timed = m.where("at is not null").select("cluster_id", "observation_id", "at", minute.alias("_minute"))
    per_minute = timed.groupBy("cluster_id", "_minute").agg(F.count("*").alias("_n"))
    cluster = Window.partitionBy("cluster_id")
    before = F.coalesce(F.sum("_n").over(cluster.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = per_minute.select("cluster_id", "_minute", "_n", before.alias("_before"), F.sum("_n").over(cluster).alias("n_at")).withColumn("_middle", F.floor((F.col("n_at") - 1) / 2))
    central = placed.where((F.col("_before") <= F.col("_middle") + 1) & (F.col("_before") + F.col("_n") > F.col("_middle")))
    # only the minutes around the middle are sorted
    ranked = timed.join(central, ["cluster_id", "_minute"]).withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy("cluster_id", "_minute").orderBy("at", "observation_id")) - 1)
    at_place = lambda k: F.min(F.when(F.col("_place") == F.col("_middle") + k, F.struct("at", "observation_id")))
    middles = ranked.groupBy("cluster_id").agg(F.max("n_at").alias("n_at"), at_place(0).alias("_lower"), at_place(1).alias("_upper"))
    first_half = F.struct("at", "observation_id") <= F.col("_lower")
    middle = F.when(F.col("at").isNull() | ~first_half, F.col("_lower.at")).otherwise(F.col("_upper.at"))
    alone = F.coalesce("n_at", F.lit(0)) <= F.when(F.col("at").isNull(), 0).otherwise(1)
    near = F.when(F.col("at").isNull() | alone, 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(F.col("at") - middle) / F.lit(3.6e9), F.lit(24.0)) / F.lit(24.0)))

    hosts = m.where("host is not null and host <> ''").groupBy("cluster_id", "host").agg(F.count("*").alias("k"))
    hosts, _ = materialize(hosts, "cluster-hosts")
    # a cluster of many hosts is dealt to several tasks, each of which meets all of its hosts
    tasks = hosts.groupBy("cluster_id").agg(F.ceil(F.count("*") / F.lit(HOSTS_PER_TASK)).cast("int").alias("_tasks"))
    own = hosts.join(tasks, "cluster_id").select("cluster_id", "host", F.pmod(F.xxhash64("host"), F.col("_tasks")).cast("int").alias("_task"))
    other = hosts.join(tasks, "cluster_id").select("cluster_id", F.col("host").alias("_o"), F.col("k").alias("_k"), F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"))
    alike = 1 - F.levenshtein("host", "_o") / F.greatest(F.length("host"), F.length("_o"), F.lit(1))
    sums = own.join(other, ["cluster_id", "_task"]).groupBy("cluster_id", "host").agg(F.sum(alike * F.col("_k")).alias("_sum"), F.sum("_k").alias("_all"))
    lexical = F.when(F.col("_all") > 1, (F.col("_sum") - 1) / (F.col("_all") - 1)).otherwise(0.0)

    full = with_overlap(with_overlap(m.join(middles, "cluster_id", "left").withColumn("_burst", near), "asn"), "registrar").join(sums, ["cluster_id", "host"], "left")
    score = F.lit(0.30) + 0.25 * F.col("_burst") + 0.20 * F.coalesce(lexical, F.lit(0.0)) + 0.15 * F.col("_asn") + 0.10 * F.col("_registrar")
    return full.select("cluster_id", "observation_id", F.bround(score, decimals).alias("score"))


def matching_rule(observations: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Each observation's first live suppression rule: ``id``, ``rule_id``.

    ``rules``: ``rule_id``, ``rule_type`` (domain, registrar, asn), ``match_value``,
    ``expires`` (microseconds or null), ``active``. Domain rules meet hosts by their
    ancestors and ASN rules by value, both as equi-joins; registrar rules match parts
    of the name and are compared with each distinct registrar.
    """
    live = rules.where(F.col("active") & (F.col("expires").isNull() | (F.col("expires") > now)) & (F.btrim("match_value") != "")).select("rule_id", "rule_type", F.lower(F.btrim("match_value")).alias("v"))
    o = observations.select("id", F.lower("host").alias("host"), F.lower("domain").alias("domain"), F.lower("registrar").alias("registrar"), F.lower("asn").alias("asn"))
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_name = o.select("id", F.explode(F.array_distinct(F.array_compact(F.array_append(F.coalesce(up, F.array().cast("array<string>")), F.col("domain"))))).alias("v")).join(live.where("rule_type = 'domain'"), "v").select("id", "rule_id")
    by_asn = o.join(live.where("rule_type = 'asn'"), F.col("asn") == F.col("v")).select("id", "rule_id")
    patterns = live.where("rule_type = 'registrar'").select("v", "rule_id").limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} registrar rules")
    listed = F.array(*[F.when(F.col("registrar").contains(p["v"]), F.lit(p["rule_id"])) for p in patterns], F.lit(None).cast("long"))
    names = o.select("registrar").where("registrar is not null").distinct()
    hits = names.select("registrar", F.array_min(listed).alias("rule_id")).where("rule_id is not null")
    by_registrar = o.join(hits, "registrar").select("id", "rule_id")
    return by_name.unionByName(by_asn).unionByName(by_registrar).groupBy("id").agg(F.min("rule_id").alias("rule_id"))
