"""Queries of the training-data problems of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.functions.hosts import digits, folded, present, present_host
from wardline.functions.times import from_micros, micros
from wardline.llm import asof, leakage, mixture, spans, splits, topn
from wardline.plans.dealt import fold_sql, host_sql, missing_sql
from wardline.scratch import materialize
from wardline.tables import table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
N_BEST = 5


def _feed(name: str = "source"):
    """The partner feed, or null for the general stream and missing sources."""
    s = present(F.col(name))
    return F.when(s != "certstream", s)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Domains tied by partner feeds, with the smallest of their group."""
    rows = table(spark, d, "ct_observations").select(present_host(F.col("registered_domain")).alias("domain"), _feed().alias("feed"))
    tied = splits.components(splits.star_edges(rows, "domain", "feed"))
    return tied.select(F.col("node").alias("registered_domain"), F.col("component").alias("group_domain"))


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of every observation."""
    done = splits.split_records(table(spark, d, "ct_observations"), present_host(F.col("registered_domain")), _feed(), "id", PROPORTIONS)
    return done.select(F.col("id").alias("observation_id"), "group", "split")


def p1_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups of each split beside the wanted proportion."""
    per = p1_split(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("group").alias("n_groups"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in PROPORTIONS.items() for x in kv]), F.col("split"))
    return per.select("split", "n", "n_groups", wanted.alias("wanted_share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The best observations of each brand's campaigns."""
    return _best(spark, d).select("target_brand", "observation_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with score and rank."""
    return _best(spark, d).select("target_brand", "observation_id", "risk_score", "rank")


def _best(spark: SparkSession, d: str) -> DataFrame:
    brands = table(spark, d, "campaign_clusters").select(F.col("id").alias("cluster_id"), present(F.col("target_brand")).alias("target_brand")).where("target_brand is not null")
    members = table(spark, d, "cluster_members").select("cluster_id", "observation_id").where("cluster_id is not null")
    pairs = members.join(brands, "cluster_id").select("target_brand", "observation_id").distinct()
    scores = table(spark, d, "ct_observations").select(F.col("id").alias("observation_id"), "risk_score").where("risk_score is not null and not isnan(risk_score)")
    # pairs are distinct and observation ids unique
    return topn.top_n(pairs.join(scores, "observation_id"), "target_brand", "risk_score", "observation_id", N_BEST, unique=True)


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "ct_observations")
    whois = table(spark, d, "whois_cache")
    geo = table(spark, d, "dns_geo_cache")
    kinds = {
        "whois": asof.versions(whois.where("error is null"), "whois", present_host(F.col("domain")), micros(whois, "fetched_at"), folded(F.col("registrar")), micros(whois, "created")),
        "geo": asof.versions(geo.where("asn is not null"), "geo", present_host(F.col("puny_domain")), micros(geo, "fetched_at"), digits(F.col("asn"))),
    }
    return rows, asof.as_of(rows, "id", present_host(F.col("registered_domain")), micros(rows, "event_ts"), kinds)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored attributes that differ from what was known at the event, or weren't known."""
    rows, known = _known(spark, d)
    stored = rows.where("event_ts is not null and (registrar is not null or whois_created is not null or sample_asn is not null)").select(
        "id", folded(F.col("registrar")).alias("registrar"), micros(rows, "whois_created").alias("created"), F.col("sample_asn").alias("asn_text"), digits(F.col("sample_asn")).alias("asn")
    )
    wrong = F.array_compact(
        F.array(
            F.when(F.col("registrar").isNotNull() & ~F.col("registrar").eqNullSafe(F.col("whois_v1")), F.lit("registrar")),
            F.when(F.col("created").isNotNull() & ~F.col("created").eqNullSafe(F.col("whois_v2")), F.lit("whois_created")),
            F.when(F.col("asn_text").isNotNull() & ~F.coalesce("asn", F.lit("")).eqNullSafe(F.col("geo_v1")), F.lit("sample_asn")),
        )
    )
    return stored.join(known, "id").select(F.col("id").alias("observation_id"), F.explode(wrong).alias("field"))


def p7_known(spark: SparkSession, d: str) -> DataFrame:
    """Every observation with the attributes known at its event; without a time or a domain nothing is known."""
    rows, known = _known(spark, d)
    # those the as-of join leaves out are added back by its own condition, which needs no second shuffle of all rows
    undated = rows.where(present_host(F.col("registered_domain")).isNull() | micros(rows, "event_ts").isNull())
    nothing = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("whois_v1", "whois_v2", "geo_v1")]
    known = known.unionByName(undated.select("id", *nothing, F.lit(False).alias("whois_known"), F.lit(False).alias("geo_known")), allowMissingColumns=True)
    return known.select(F.col("id").alias("observation_id"), F.col("whois_v1").alias("registrar"), from_micros(F.col("whois_v2")).alias("whois_created"), F.col("geo_v1").alias("asn_digits"), "whois_known", "geo_known")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items they leak."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents, and the longest shared run in words."""
    runs = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    per = runs.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"))
    return per.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest_run"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", folded(F.col("source")).alias("source"), "text")
    return mixture.token_counts(docs)


def _chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", folded(F.col("source")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return mixture.unique_targets(table(spark, d, "mix_targets"), folded(F.col("source")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their share of the mixture."""
    per, _ = materialize(_sizes(spark, d).groupBy("source").agg(F.sum("tokens").alias("tokens")), "source-tokens")
    return mixture.short_sources(per, _targets(spark, d))


def _mixed(spark: SparkSession, d: str, measured: Callable[[SparkSession, str], DataFrame] = _sizes) -> tuple[DataFrame, DataFrame, int]:
    sizes, _ = materialize(measured(spark, d), "tokens")
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    entries, total = mixture.plan(per, _targets(spark, d))
    planned = mixture.as_table(spark, entries)
    return mixture.draw(sizes, planned), planned, total


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture with their number of copies."""
    return _mixed(spark, d)[0]


def _shares(drawn: DataFrame, planned: DataFrame, total: int) -> DataFrame:
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("most_copies"))
    rows = planned.join(got, "source", "left")
    drawn_tokens = F.coalesce("drawn", F.lit(0))
    mixed = F.sum(drawn_tokens).over(Window.partitionBy())  # one row per target source
    return rows.select(
        "source", "tokens", "target_share", "max_repeats", "repeats", "clamped", "round", drawn_tokens.alias("drawn_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        (drawn_tokens / F.greatest(mixed, F.lit(1))).alias("reached_share"), (drawn_tokens / F.lit(float(max(total, 1)))).alias("share_of_corpus"),
    )


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares per source."""
    return _shares(*_mixed(spark, d)).drop("round")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the mixture's shares, per source: no record over the cap, the size drawn between the whole copies and one more, clamped sources drawn whole."""
    rows = _shares(*_mixed(spark, d))
    whole = F.floor("repeats") * F.col("tokens")
    return rows.select(
        "source", (F.col("round") == 1).alias("short"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), F.col("drawn_tokens").between(whole, whole + F.col("tokens")).alias("within_draw"),
        (~F.col("clamped") | (F.col("drawn_tokens") == F.floor(F.col("max_repeats") * F.col("tokens")))).alias("clamped_whole"),
    )


def p9_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with sizes in characters, which SQL can count too."""
    return _mixed(spark, d, _chars)[0].select("doc_id", "source", F.col("tokens").alias("chars"), "copies")


def p9_chars_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares per source, sizes in characters."""
    rows = _shares(*_mixed(spark, d, _chars))
    return rows.select("source", F.col("tokens").alias("chars"), "round", F.round("repeats", 8).alias("repeats"), F.col("drawn_tokens").alias("drawn_chars"), F.round("reached_share", 8).alias("reached_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a long span."""
    return spans.shared_spans(table(spark, d, "documents")).all_pairs()


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class, its number of partners and the characters that also stand elsewhere."""
    docs = table(spark, d, "documents")
    return spans.shared_spans(docs).per_document(docs)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_split, p1_sizes, p6_found, p6_ranked, p7_found, p7_known, p8_found, p8_items, p9_found, p9_mixture, p9_shares, p9_checks, p9_chars, p9_chars_shares, p10_found, p10_documents)
}

_BEST = f"""with pairs as (
  select distinct {fold_sql("c.target_brand")} as target_brand, m.observation_id
  from cluster_members m join campaign_clusters c on c.id = m.cluster_id where not {missing_sql("c.target_brand")}),
ranked as (
  select p.target_brand, p.observation_id, o.risk_score,
         row_number() over (partition by p.target_brand order by o.risk_score desc, o.id)::integer as rank
  from pairs p join ct_observations o on o.id = p.observation_id where o.risk_score is not null and not isnan(o.risk_score))"""
_DOMAIN = "case when not {m} then nullif({h}, '') end"


def _domain(c: str) -> str:
    return _DOMAIN.format(m=missing_sql(c), h=host_sql(c))


_KNOWN = f"""with w as (
  select {_domain("domain")} as domain, fetched_at, max(struct_pack(r := coalesce({fold_sql("registrar")}, ''), c := coalesce(created, timestamp '0001-01-01'))) as v
  from whois_cache where error is null group by 1, 2),
g as (select {_domain("puny_domain")} as domain, fetched_at, max(nullif(regexp_replace(asn, '[^0-9]', '', 'g'), '')) as asn from dns_geo_cache where asn is not null group by 1, 2),
o as (select id, {_domain("registered_domain")} as domain, event_ts, {fold_sql("registrar")} as registrar, whois_created, sample_asn from ct_observations),
known as (
  select o.*, nullif(w.v.r, '') as known_registrar, nullif(w.v.c, timestamp '0001-01-01') as known_created, g.asn as known_asn, w.domain is not null as whois_known, g.domain is not null as geo_known
  from o asof left join w on o.domain = w.domain and o.event_ts >= w.fetched_at asof left join g on o.domain = g.domain and o.event_ts >= g.fetched_at
)"""
_DATED = "domain is not null and event_ts is not null"
_TIES = f"""with recursive pairs as (
  select distinct {_domain("registered_domain")} as d, {fold_sql("source")} as s from ct_observations where not {missing_sql("source")} and {fold_sql("source")} <> 'certstream'),
edges as (
  select d as a, least_d as b from (select d, min(d) over (partition by s) as least_d from pairs where d is not null) where d <> least_d
  union select least_d, d from (select d, min(d) over (partition by s) as least_d from pairs where d is not null) where d <> least_d),
reach as (select a as node, a as seen from edges union select r.node, e.b from reach r join edges e on e.a = r.seen),
tied as (select node, min(seen) as component from reach group by node)"""
_SEED = 17


def _uniform(*parts: str) -> str:
    return f"((('0x' || left(md5({' || chr(124) || '.join(parts)}), 13))::bigint::double + 0.5) / {float(2**52)!r}::double)"


def _score(key: str, split: str, weight: str) -> str:
    quoted = f"'{split}'"
    return f"({weight})::double / -ln({_uniform(repr(str(_SEED)), quoted, key)})"


_NAMES = sorted(PROPORTIONS)
_ROOM = ", ".join(f"{PROPORTIONS[k]!r}::double / {sum(PROPORTIONS.values())!r}::double * (select sum(n) from sizes)" for k in _NAMES)
# splits are numbered in the order of their names; the large groups are placed one after the other
_SPLIT = f"""{_TIES},
entities as (select d, count(*) as n from (select {_domain("registered_domain")} as d from ct_observations) where d is not null group by 1),
named as (select d, n, coalesce(component, d) as g from entities left join tied on node = d),
sizes as (select g, sum(n)::bigint as n from named group by 1),
large as (select row_number() over (order by n desc, g) as k, g, n, [x.i for x in list_reverse_sort([{", ".join("struct_pack(s := " + _score("g", k, repr(PROPORTIONS[k])) + f", i := {i + 1})" for i, k in enumerate(_NAMES))}])] as ord
  from sizes where n >= greatest(2, 0.001::double * (select sum(n) from sizes))),
placed as (select 0::bigint as k, null::varchar as g, 0 as split, [{_ROOM}] as room
  union all select k, g, i, [case when j = i then room[j] - n else room[j] end for j in [1, 2, 3]] from (
    select large.k, large.g, large.n, room, coalesce([i for i in ord if room[i] >= n][1], [i for i in ord if room[i] = list_max(room)][1]) as i from placed join large on large.k = placed.k + 1)),
left_over as (select [greatest(x, 0.0) for x in arg_max(room, k)] as w from placed),
chosen as (select g, {_NAMES}[coalesce(split, list_position(scores, list_max(scores)))] as split from (
  select sizes.g, placed.split, [{", ".join(f"case when w[{i + 1}] > 0 then " + _score("sizes.g", k, f"w[{i + 1}]") + " else -1 end" for i, k in enumerate(_NAMES))}] as scores from sizes cross join left_over left join placed on placed.g = sizes.g)),
split_of as (select id as observation_id, named.g as "group", case when o.d is null then {_NAMES}[list_position(alone, list_max(alone))] else chosen.split end as split from (
  select id, {_domain("registered_domain")} as d, [{", ".join(_score("id::varchar", k, repr(PROPORTIONS[k])) for k in _NAMES)}] as alone from ct_observations) o left join named on named.d = o.d left join chosen on chosen.g = named.g)"""
_TARGETS = f"select {fold_sql('source')} as source, sum(target_share) as share, min(max_repeats)::double as cap from mix_targets group by 1"
_FILLED = f"""with recursive sized as (select doc_id, {fold_sql("source")} as source, coalesce(length(text), 0)::bigint as chars from documents),
per as (select source, sum(chars)::bigint as chars from sized group by 1),
t as (select source, share, cap, coalesce(chars, 0) as chars from ({_TARGETS}) left join per using (source)),
total as (select sum(chars)::double as size from sized),
fill as (select 0 as k, (select list(struct_pack(source := source, share := share, room := chars * cap)) from t where share > 0) as free, [null::varchar] as out, (select size from total) as remaining, 0.0::double as held
  union all select k + 1, [x for x in free if not list_contains(gone, x.source)], gone, greatest(0.0, (select size from total) - held - lost), held + lost from (
    select *, coalesce(list_sum([x.room for x in free if list_contains(gone, x.source)]), 0) as lost from (
      select *, [x.source for x in free if remaining * x.share / list_sum([y.share for y in free]) > x.room] as gone from fill)) where len(gone) > 0),
rounds as (select unnest(out) as source, k as round from fill where k > 0),
rest as (select arg_max(remaining, k) as remaining, (select list_sum([y.share for y in arg_max(free, k)]) from fill) as weight from fill),
planned as (select source, t.chars, coalesce(round, 0)::integer as round, case when share <= 0 or t.chars = 0 then 0.0 when round is not null then cap else remaining * share / weight / t.chars end as repeats
  from t left join rounds using (source) cross join rest),
drawn as (select doc_id, source, sized.chars, (floor(repeats) + case when {_uniform(repr(str(_SEED)), "doc_id::varchar")} < repeats - floor(repeats) then 1 else 0 end)::integer as copies from sized join planned using (source)),
mixed as (select source, sum(chars * copies)::bigint as n from drawn group by 1)"""

ORACLES = {
    "p1_found": f"{_TIES} select node as registered_domain, component as group_domain from tied",
    "p1_split": f'{_SPLIT} select observation_id, "group", split from split_of',
    "p1_sizes": f"""{_SPLIT} select split, count(*) as n, count(distinct "group") as n_groups, map({_NAMES}, {[PROPORTIONS[k] for k in _NAMES]}::double[])[split] as wanted_share from split_of group by 1""",
    "p6_found": f"{_BEST} select target_brand, observation_id from ranked where rank <= {N_BEST}",
    "p6_ranked": f"{_BEST} select target_brand, observation_id, risk_score, rank from ranked where rank <= {N_BEST}",
    "p7_found": f"""{_KNOWN}
      select id as observation_id, 'registrar' as field from known where {_DATED} and registrar is not null and registrar is distinct from known_registrar
      union all select id, 'whois_created' from known where {_DATED} and whois_created is not null and whois_created is distinct from known_created
      union all select id, 'sample_asn' from known where {_DATED} and sample_asn is not null and regexp_replace(sample_asn, '[^0-9]', '', 'g') is distinct from known_asn""",
    "p7_known": f"{_KNOWN} select id as observation_id, known_registrar as registrar, known_created as whois_created, known_asn as asn_digits, whois_known, geo_known from known",
    "p8_found": """with d as (select doc_id as id, [lower(x) for x in regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')] as w from documents),
      i as (select item_id as id, [lower(x) for x in regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')] as w from eval_items),
      dg as (select id, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) as g from d where len(w) >= 12),
      ig as (select distinct id, unnest([array_to_string(w[k:k + 11], ' ') for k in range(1, len(w) - 10)]) as g from i where len(w) >= 12)
      select distinct dg.id as doc_id, ig.id as item_id from dg join ig using (g)""",
    "p8_items": """with d as (select doc_id as id, [lower(x) for x in regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')] as w from documents),
      i as (select item_id as id, [lower(x) for x in regexp_extract_all(text, '[\\p{L}\\p{Nd}]+')] as w from eval_items),
      dg as (select id, k, array_to_string(w[k:k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
      ig as (select id, k, array_to_string(w[k:k + 11], ' ') as g from (select id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12)),
      hits as (select dg.id as doc_id, ig.id as item_id, dg.k, dg.k - ig.k as diagonal, dg.k - row_number() over (partition by dg.id, ig.id, dg.k - ig.k order by dg.k) as island from dg join ig using (g)),
      runs as (select doc_id, item_id, count(*) + 11 as words from hits group by doc_id, item_id, diagonal, island)
      select item_id, count(distinct doc_id) as n_docs, max(words)::integer as longest_run from runs group by 1""",
    # any common way to count tokens gives the same cases; here words, digits and marks
    "p9_found": f"""with t as (select {fold_sql("source")} as source, len(regexp_extract_all(text, '[a-zA-Z\u00c0-\u024f]+|[0-9]{{1,3}}|[^\\sa-zA-Z0-9\u00c0-\u024f]')) as n from documents),
      per as (select source, sum(n) as n from t group by 1)
      select source from (select {fold_sql("source")} as source, sum(target_share) as share, min(max_repeats) as cap from mix_targets group by 1) left join per using (source)
      where coalesce(n, 0) * cap < share * (select sum(n) from t)""",
    "p9_checks": f"""with t as (select {fold_sql("source")} as source, len(regexp_extract_all(text, '[a-zA-Z\u00c0-\u024f]+|[0-9]{{1,3}}|[^\\sa-zA-Z0-9\u00c0-\u024f]')) as n from documents),
      per as (select source, sum(n) as n from t group by 1)
      select source, coalesce(n, 0) * cap < share * (select sum(n) from t) as short, true as within_cap, true as within_draw, true as clamped_whole from ({_TARGETS}) left join per using (source)""",
    "p9_chars": f"{_FILLED} select doc_id, source, chars, copies from drawn where copies > 0",
    "p9_chars_shares": f"""{_FILLED} select source, chars, round, round(repeats, 8) as repeats, coalesce(n, 0) as drawn_chars,
      round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) over (), 1)::double, 8) as reached_share from planned left join mixed using (source)""",
    "p10_documents": """with t as (select doc_id, text, coalesce(length(text), 0)::bigint as n from documents),
      p as (select doc_id, k, md5(substring(text, k, 300)) as h from (select doc_id, text, unnest(range(1, n - 298)) as k from t where n >= 300)),
      shared as (select * from p where h in (select h from p group by h having count(distinct doc_id) > 1)),
      links as (select a.doc_id, count(distinct b.doc_id) as links from shared a join shared b on a.h = b.h and a.doc_id <> b.doc_id group by 1),
      covered as (select doc_id, sum(least(300, coalesce(later - k, 300)))::bigint as c from (select doc_id, k, lead(k) over (partition by doc_id order by k) as later from shared) group by 1)
      select doc_id, case when n >= 300 then min(doc_id) over (partition by text) else doc_id end as class_id, coalesce(links, 0) as links, coalesce(c, 0) as shared_chars, n as n_chars
      from t left join links using (doc_id) left join covered using (doc_id)""",
    "p10_found": """with p as (select distinct doc_id, md5(substring(text, k, 300)) as h from (select doc_id, text, unnest(range(1, length(text) - 298)) as k from documents where length(text) >= 300)),
      shared as (select * from p where h in (select h from p group by h having count(*) > 1))
      select distinct a.doc_id as doc_id_a, b.doc_id as doc_id_b from shared a join shared b on a.h = b.h and a.doc_id < b.doc_id""",
}
