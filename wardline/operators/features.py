"""Features of hosts and models over them: vectors, fitting, splits, evaluation, fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import is_missing, trimmed
from wardline.functions.text import lexical_statistics, md5_bucket
from wardline.operators import ranking

GRAM_BUCKETS, CATEGORY_BUCKETS = 4096, 256
LEXICAL = ["length", "digits", "hyphens", "dots", "digit_ratio", "hyphen_ratio", "entropy", "xn_punycode", "labels", "tld_len"]
INFRASTRUCTURE = ["num_unique_ips", "has_ipv6", "num_countries", "num_asns"]
REGISTRATION = ["age_days", "days_to_expiry", "created_isnull", "expires_isnull", "has_error"]
ALL_PARTS = ("grams", "lexical", "infrastructure", "categories", "registration")
#: Fitting reads at most so many labelled rows, chosen by a hash of their key; everything else covers all rows.
MOST_TRAINING_ROWS = 2_000_000


def char_grams(host: Column, least: int = 3, most: int = 5) -> Column:
    """All runs of ``least`` to ``most`` characters; shorter hosts give none of that length."""

    def of(n: int) -> Column:
        return F.when(F.length(host) >= n, F.transform(F.sequence(F.lit(1), F.length(host) - n + 1), lambda i: F.substring(host, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(least, most + 1)])


def categories(columns: Mapping[str, str]) -> Column:
    """Tokens ``prefix=value`` of the columns that have a value."""
    return F.array_compact(F.array(*[F.when(~is_missing(F.col(c)), F.concat(F.lit(f"{p}="), F.lower(trimmed(F.col(c))))) for p, c in columns.items()]))


def with_registration(df: DataFrame, created: Column, expires: Column, error: Column, any_record: Column, now: int) -> DataFrame:
    """Registration features from times in microseconds; all zero where there is no record at all."""

    def days(c: Column) -> Column:
        return F.when(any_record & c.isNotNull(), c / F.lit(8.64e10)).otherwise(0.0)

    return df.withColumns(
        {
            "age_days": days(F.lit(now) - created),
            "days_to_expiry": days(expires - F.lit(now)),
            "created_isnull": F.when(any_record, created.isNull().cast("int")).otherwise(0),
            "expires_isnull": F.when(any_record, expires.isNull().cast("int")).otherwise(0),
            "has_error": F.when(any_record, error.isNotNull().cast("int")).otherwise(0),
        }
    )


#: Names that tables use for the same registration field, the first present one counts.
REGISTRATION_ALIASES = {"created": ("whois_created", "created", "creation_date"), "expires": ("whois_expires", "expires", "expiration_date"), "error": ("whois_error", "error"), "registrar": ("registrar", "whois_registrar"), "status": ("whois_status", "status")}


def registration_from(df: DataFrame, now: int) -> DataFrame:
    """SC3: registration features from whatever columns the table has.

    Raw fields, under the first of their names that is there, beat features that
    were computed before; only a table without any raw time keeps those, missing ones as 0.
    """
    have = {c.lower(): c for c in df.columns}
    found = {k: next((have[n] for n in names if n in have), None) for k, names in REGISTRATION_ALIASES.items()}
    if found["created"] is None and found["expires"] is None:
        return df.withColumns({c: F.coalesce(F.col(have[c]).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in REGISTRATION})

    def at(k: str) -> Column:
        return F.unix_micros(F.col(found[k]).try_cast("timestamp")) if found[k] else F.lit(None).cast("long")

    def text(k: str) -> Column:
        return F.when(~is_missing(F.col(found[k]).cast("string")), F.col(found[k]).cast("string")) if found[k] else F.lit(None).cast("string")

    any_record = at("created").isNotNull() | at("expires").isNotNull() | text("registrar").isNotNull() | text("status").isNotNull() | text("error").isNotNull()
    return with_registration(df, at("created"), at("expires"), text("error"), any_record, now)


def prepared(df: DataFrame, host: Column, category_columns: Mapping[str, str]) -> DataFrame:
    """The rows with grams, category tokens and lexical numbers; missing infrastructure and registration numbers are 0."""
    rows = df.withColumns({"grams": char_grams(host), "tokens": categories(category_columns), **lexical_statistics(host)})
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in [*LEXICAL, *INFRASTRUCTURE, *REGISTRATION]})


def vectorizer(parts: Sequence[str] = ALL_PARTS) -> list:
    """Pipeline stages from prepared rows to ``features``: 4,371 columns with all parts."""
    stages: list = [HashingTF(inputCol="grams", outputCol="gram_counts", numFeatures=GRAM_BUCKETS), Normalizer(inputCol="gram_counts", outputCol="gram_vector"), HashingTF(inputCol="tokens", outputCol="category_vector", numFeatures=CATEGORY_BUCKETS)]
    inputs = {"grams": ["gram_vector"], "lexical": LEXICAL, "infrastructure": INFRASTRUCTURE, "categories": ["category_vector"], "registration": REGISTRATION}
    return [*stages, VectorAssembler(inputCols=[c for p in parts for c in inputs[p]], outputCol="features")]


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Row weights that give both classes half of the weight."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    total = sum(n.values())
    weight = F.lit(0.0)
    for k, c in n.items():
        weight = F.when(F.col(label) == k, total / (len(n) * c)).otherwise(weight)
    return df.withColumn("weight", weight)


def bounded(df: DataFrame, key: str, most: int = MOST_TRAINING_ROWS) -> DataFrame:
    """At most about ``most`` rows for fitting, chosen by hash of the key."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit(23), key), F.lit(1_000_000)) < int(most / n * 1_000_000))


def fit(train: DataFrame, key: str, kind: str = "boosted", parts: Sequence[str] = ALL_PARTS, most: int = MOST_TRAINING_ROWS, rounds: int = 20, depth: int = 4, rate: float = 0.1) -> PipelineModel:
    """Fit boosted trees (``rounds`` of ``depth``) or a logistic regression on prepared, labelled rows, classes balanced."""
    rows = balanced(bounded(train.withColumn("label", F.col("label").cast("double")), key, most))
    if kind == "boosted":
        model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=42)
    else:
        model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=100, regParam=1e-3)
    return Pipeline(stages=[*vectorizer(parts), model]).fit(rows)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with ``score``, the probability of the positive class."""
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def split_by_date(df: DataFrame, date: str, label: str, key: str, least: int = 30) -> tuple[DataFrame, DataFrame, bool]:
    """Training and test rows: the latest date held out where both sides have ``least`` of each class, else a stratified quarter by hash rank."""
    last = df.agg(F.max(date)).first()[0]
    if last is not None:
        counts = df.groupBy((F.col(date) == F.lit(last)).alias("held"), label).agg(F.count("*").alias("n")).where("held is not null").collect()  # four rows
        if len(counts) == 4 and min(r["n"] for r in counts) >= least:
            return df.where(F.col(date) < F.lit(last)), df.where(F.col(date) == F.lit(last)), True
    held = md5_bucket(4, F.lit(42), F.col(label), F.col(key)) == 0
    return df.where(~held), df.where(held), False


def evaluate(rows: DataFrame, label: str = "label") -> dict:
    """ROC and precision-recall areas, threshold and recall at one percent false positives."""
    per = ranking.levels(rows, F.col("score"), F.col(label) == 1)
    return ranking.areas(per).first().asDict() | ranking.threshold_at_fpr(per, 0.01).first().asDict()


def leave_one_source_out(df: DataFrame, source: str, key: str, kind: str = "logistic", parts: Sequence[str] = ("lexical", "infrastructure")) -> dict[str, dict]:
    """Evaluation on each source's positives with all other sources' for training, all sources in order; negatives are halved by hash."""
    half = F.pmod(F.xxhash64(F.lit(5), key), F.lit(2)) == 0
    out = {}
    for (s,) in sorted(df.where("label = 1").select(source).where(F.col(source).isNotNull()).distinct().collect()):  # feeds are configured one by one
        mine = F.col(source) == s
        train = df.where((F.col("label") == 1) & ~mine | (F.col("label") == 0) & half)
        test = df.where((F.col("label") == 1) & mine | (F.col("label") == 0) & ~half)
        if train.where("label = 1").limit(1).count():
            out[s] = evaluate(scored(fit(train, key, kind, parts), test))
    return out


def shortcut_check(train: DataFrame, test: DataFrame, key: str, kind: str = "logistic") -> dict[str, object]:
    """SC10: areas on the test rows with all features and with infrastructure alone, and the band of their difference."""
    areas = {name: evaluate(scored(fit(train, key, kind, parts), test))["roc_auc"] for name, parts in (("all", ALL_PARTS), ("infrastructure", ("infrastructure",)))}
    known = None not in areas.values()
    return areas | {"band": gap_band(areas["all"], areas["infrastructure"]) if known else None}


def gap_band(all_features: float, infrastructure_only: float) -> str:
    """How much better all features are than infrastructure alone: under 0.05 a likely shortcut, under 0.15 unclear."""
    gap = all_features - infrastructure_only
    return "likely shortcut" if gap < 0.05 else "unclear" if gap < 0.15 else "content matters"


def threshold(meta: Mapping[str, object] | None, model: str | None = None) -> float:
    """SC5: the threshold that a model's metadata names: under ``metrics`` of that model, else at the top level, else 0.90."""
    metrics = (meta or {}).get("metrics")
    own = metrics.get(model) if isinstance(metrics, Mapping) and model else None
    for place in (own, meta):
        for k in ("threshold_at_1pct_fpr", "fpr_1pct_threshold"):
            try:
                return float(place[k])  # a value that is missing or no number leaves it to the next
            except (KeyError, TypeError, ValueError):
                pass
    return 0.90


def primary(models: Mapping[str, PipelineModel | None]) -> tuple[str, PipelineModel]:
    """SC4: the model that decides: the boosted one where there is one, else the regression."""
    for name in PRIMARY:
        if models.get(name) is not None:
            return name, models[name]
    raise ValueError("no model")


def fused(score: Column, hit: Column, cut: float) -> tuple[Column, Column]:
    """The final label, model or indicator, and which of them decided."""
    ml, ioc = F.coalesce(score >= cut, F.lit(False)), F.coalesce(hit, F.lit(False))
    reason = F.when(ml & ioc, "MISP_AND_ML").when(ioc, "MISP_IOC").when(ml, "ML_SCORE").otherwise("BENIGN_BASELINE")
    return (ml | ioc).cast("int"), reason


def rule_weights(hits: DataFrame, rules: Sequence[str], label: str, weight: str, total: float = 1.0) -> dict[str, float]:
    """Weights of boolean rule columns by weighted logistic regression: negative ones are 0, the rest sums to ``total``."""
    rows = hits.select(*[F.col(r).cast("double").alias(r) for r in rules], F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(rules), outputCol="features"), LogisticRegression(weightCol="weight", maxIter=100)]).fit(rows)
    positive = [max(0.0, float(c)) for c in model.stages[-1].coefficients]
    scale = sum(positive) or 1.0
    return {r: round(total * c / scale, 4) for r, c in zip(rules, positive)}


def hold_load(old: DataFrame, old_cut: float, new: DataFrame) -> DataFrame:
    """SC11: the threshold under new weights that lets no more weight through than ``old_cut`` did under the old ones, and the share of positives then.

    ``old`` and ``new`` are score levels (``ranking.levels``).
    """
    volume = old.where(F.col("score") >= old_cut).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    return ranking.budget(new, volume)


def stratified_sample(df: DataFrame, host: str, quotas: Mapping[tuple[int, int], int], seed: int = 42, holdout: float = 0.2) -> DataFrame:
    """``quota`` hosts of each length bin (from, to), lowest seeded hash first, with ``holdout`` marked by hash."""
    bin_ = F.lit(None).cast("int")
    quota = F.lit(None).cast("long")
    for i, ((a, b), q) in enumerate(quotas.items()):
        inside = (F.length(host) >= a) & (F.length(host) <= b)
        bin_, quota = F.when(inside, i).otherwise(bin_), F.when(inside, q).otherwise(quota)
    h = F.xxhash64(F.lit(seed), host)
    rows = df.select(host).where(F.col(host).isNotNull()).distinct().withColumns({"bin": bin_, "_q": quota, "_h": h}).where("bin is not null")
    # a constant bound lets the rows beyond it be dropped before the shuffle
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy("_h", host))).where(F.col("_r") <= max(quotas.values(), default=0))
    return first.where("_r <= _q").select(host, "bin", (F.pmod(F.xxhash64(F.lit(seed + 1), host), F.lit(1000)) < int(holdout * 1000)).alias("held_out"))


#: The models of a run, the one that decides first.
PRIMARY = ("lgbm_full", "logreg_full")


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) and x == x else None


def primary_area(meta: Mapping[str, object] | None) -> tuple[str, float] | None:
    """The model that decides and its area, from a run's metadata; none where neither model has one."""
    metrics = (meta or {}).get("metrics")
    for name in PRIMARY:
        own = metrics.get(name) if isinstance(metrics, Mapping) else None
        area = _number(own.get("roc_auc")) if isinstance(own, Mapping) else None
        if area is not None:
            return name, area
    return None


def _benign_rate(meta: Mapping[str, object] | None) -> float | None:
    held = (meta or {}).get("benign_holdout_fpr")
    return _number(held.get("fpr")) if isinstance(held, Mapping) else None


def promotion(candidate: Mapping[str, object], champion: Mapping[str, object] | None, floor: float = 0.70, most_loss: float = 0.02, most_fpr_gain: float = 0.02) -> tuple[bool, str, list[str]]:
    """SC13: whether a candidate's metadata lets it replace the champion, why, and warnings that don't decide.

    Metadata has ``n_pos``, ``n_neg``, ``metrics`` by model with ``roc_auc``,
    ``benign_holdout_fpr`` with ``fpr`` and ``used_temporal_split``.
    """
    notes = [] if candidate.get("used_temporal_split") else ["no temporal split"]
    if min(_number(candidate.get("n_pos")) or 0, _number(candidate.get("n_neg")) or 0) <= 0:
        return False, "one class only", notes
    new = primary_area(candidate)
    if new is None:
        return False, "unknown area", notes
    if new[1] < floor:
        return False, "below the floor", notes
    old = primary_area(champion)
    if old is None:
        return True, "no champion", notes
    if old[1] - new[1] > most_loss:
        return False, "area regressed", notes
    rates = [_benign_rate(candidate), _benign_rate(champion)]
    if None in rates:
        lacking = " and ".join(n for n, r in zip(("candidate", "champion"), rates) if r is None)
        return True, "not worse", [*notes, f"benign rate unknown of {lacking}"]
    if rates[0] - rates[1] > most_fpr_gain:
        return False, "false positives regressed", notes
    return True, "not worse", notes


def gate_ran(log: DataFrame, at: str, needed: Sequence[str], now: int, most_hours: float) -> tuple[bool, str]:
    """Whether the promotion log's newest entry (time in microseconds) is complete and recent, and why not."""
    row = log.where(F.col(at).isNotNull()).orderBy(F.col(at).desc()).limit(1).first()
    if row is None:
        return False, "no entry"
    lacking = [k for k in needed if k not in row or row[k] is None]
    if lacking:
        return False, f"incomplete: {', '.join(lacking)}"
    return (True, "ok") if now - row[at] <= most_hours * 3.6e9 else (False, "too old")
