"""Splits that keep related records together: hash-to-min components, weighted rendezvous.

Entities (domains) that share a source are related, directly or through further
entities. A source of many entities is first turned into a star around its
smallest one, so no source emits pairs. Hash-to-min then keeps a cluster per
node, as rows (node, member): in each round every node sends its cluster to the
cluster's minimum, and that minimum to every member, until nothing changes. The
rows of a node with a large cluster are dealt to salts: its minimum is found by
salt first and travels back to the salts that exist, so no task holds a cluster.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.scratch import discard, materialize

SALTS = 64
#: Groups of at least this part of all records are placed by size, there can't be more than its inverse.
LARGE_PART = 0.001


def star_edges(rows: DataFrame, entity: str, source: str) -> DataFrame:
    """Edges ``a`` > ``b`` from each entity of a source to the source's smallest entity."""
    pairs = rows.select(F.col(entity).alias("member"), F.col(source).alias("node")).where("member is not null and node is not null").distinct()
    pairs, _ = materialize(pairs, "pairs")  # read twice, the rows once
    return _minima(pairs).where("member <> least").select(F.col("member").alias("a"), F.col("least").alias("b")).distinct()


def _minima(clusters: DataFrame) -> DataFrame:
    """Rows (node, member, least), the minimum found by salt."""
    salted = clusters.withColumn("_salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)))
    per_salt = salted.groupBy("node", "_salt").agg(F.min("member").alias("least"))
    per_node = per_salt.groupBy("node").agg(F.min("least").alias("least"), F.collect_set("_salt").alias("_salts"))
    spread = per_node.select("node", "least", F.explode("_salts").alias("_salt"))
    return salted.join(spread, ["node", "_salt"]).select("node", "member", "least")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node of it) of every node of the edges ``a``, ``b``.

    Rounds grow as the logarithm of the longest path. Edges with a null end and
    loops add nothing; no edges, no rows. Raises when ``max_rounds`` don't suffice.
    """
    spark = edges.sparkSession
    edges, edges_path = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = both.select(F.col("a").alias("node"), F.explode(F.array("a", "b")).alias("member")).distinct()
    now, path = materialize(start, "clusters")
    discard(spark, edges_path)
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        with_least = _minima(now)
        sent = with_least.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("x"))
        following, new_path = materialize(sent.select("x.node", "x.member").distinct(), "clusters")
        new_mark = _fingerprint(following)
        discard(spark, path)
        now, path = following, new_path
        if new_mark == mark:
            return now.groupBy("node").agg(F.min("member").alias("component"))
        mark = new_mark
    raise RuntimeError(f"components aren't stable after {max_rounds} rounds")


def _fingerprint(df: DataFrame) -> tuple:
    h = F.xxhash64("node", "member")
    return tuple(df.agg(F.count("*"), F.bit_xor(h), F.sum((F.shiftright(h, 20)).cast("decimal(38,0)"))).first())


def rendezvous_score(key: Column, name: str, weight: float, seed: int) -> Column:
    """The weighted rendezvous score of one split, -w / ln(u) with u from the MD5 of the seed, the split and the key, which any SQL engine has too."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return F.lit(float(weight)) / -F.ln(u)


def rendezvous(key: Column, weights: Mapping[str, float], seed: int) -> Column:
    """The split of the highest score; equal scores go by name. Splits of weight 0 get nothing."""
    scores = [F.struct(rendezvous_score(key, k, weights[k], seed).alias("score"), F.lit(k).alias("split")) for k in sorted(weights) if weights[k] > 0]
    return F.array_max(F.array(*scores))["split"]


def assign(groups: DataFrame, proportions: Mapping[str, float], seed: int = 17, previous: DataFrame | None = None) -> DataFrame:
    """``group``, ``split`` for groups with their sizes ``n``.

    Groups that ``previous`` (``group``, ``split``) names stay where they were. Of
    the others the few of at least ``LARGE_PART`` of all records (at most its inverse
    in number) go first, largest first, each to the first split in its rendezvous
    order that still has room for it, else to the one with most room. All others
    go by weighted rendezvous hashing with the room that is left as weights. The
    same groups give the same splits; where groups come or grow from one run to
    the next, ``previous`` keeps the old ones from moving. No groups, no rows.
    """
    spark = groups.sparkSession
    names = sorted(proportions)
    kind = groups.schema["group"].dataType.simpleString()
    if previous is None:
        previous = spark.createDataFrame([], f"`group` {kind}, split string")
    known = groups.select("group", "n").join(previous.select("group", F.col("split").alias("_before")), "group", "left")
    sums = known.groupBy(F.when(F.col("_before").isin(names), F.col("_before")).alias("_before")).agg(F.sum("n").alias("n")).collect()  # a row per split, and one for new groups
    total, taken = sum(r["n"] for r in sums), {r["_before"]: r["n"] for r in sums}
    share = sum(proportions.values())
    room = {k: v / share * total - taken.get(k, 0) for k, v in proportions.items()}
    new = known.where(~F.coalesce(F.col("_before").isin(names), F.lit(False)))
    large = new.where(F.col("n") >= F.lit(max(2, LARGE_PART * total))).select("group", "n", *[rendezvous_score(F.col("group"), k, proportions[k], seed).alias(f"s{i}") for i, k in enumerate(names)]).collect()
    placed = []
    for row in sorted(large, key=lambda r: (-r["n"], r["group"])):
        order = sorted((k for k in names if proportions[k] > 0), key=lambda k: (-row[f"s{names.index(k)}"], k))
        to = next((k for k in order if room[k] >= row["n"]), max(order, key=lambda k: room[k]))
        room[to] -= row["n"]
        placed.append((row["group"], to))
    weights = {k: max(0.0, v) for k, v in room.items()}
    if not any(weights.values()):
        weights = dict(proportions)
    fixed = F.broadcast(spark.createDataFrame(placed, f"`group` {kind}, _placed string"))  # at most 1 / LARGE_PART rows
    stays = F.when(F.col("_before").isin(names), F.col("_before"))
    return known.join(fixed, "group", "left").select("group", F.coalesce(stays, "_placed", rendezvous(F.col("group"), weights, seed)).alias("split"), "n")


def split_records(df: DataFrame, entity: Column, source: Column, row_id: str, proportions: Mapping[str, float], seed: int = 17, previous: DataFrame | None = None) -> DataFrame:
    """``row_id``, ``group``, ``split`` of every record.

    All records of an entity, and of entities tied by a shared source, get one
    split. ``source`` must be null where it ties nothing. A record without entity
    is a group of its own, named null, and goes by its row id. ``previous``
    (``entity``, ``split``, once per entity) keeps the groups of an earlier run in their splits; of
    groups that have grown together, the split that held most of the records.

    The records are read twice: once for the pairs of entity and source with
    their numbers, once for the result.
    """
    rows = df.select(F.col(row_id), entity.alias("_e"), source.alias("_s"))
    counted, _ = materialize(rows.where("_e is not null").groupBy("_e", "_s").agg(F.count("*").alias("_n")), "entity-sources")
    known = components(star_edges(counted, "_e", "_s"), 60).select(F.col("node").alias("_e"), "component")
    named = counted.groupBy("_e").agg(F.sum("_n").alias("_n")).join(known, "_e", "left").select("_e", F.coalesce("component", "_e").alias("group"), "_n")
    named, _ = materialize(named, "entities")
    groups = named.groupBy("group").agg(F.sum("_n").alias("n"))
    if previous is not None:
        held = named.join(previous.select(F.col("entity").alias("_e"), "split"), "_e").groupBy("group", "split").agg(F.sum("_n").alias("_n"))
        previous = held.groupBy("group").agg(F.max_by("split", F.struct("_n", "split")).alias("split"))
    chosen = assign(groups, proportions, seed, previous).select("group", "split")
    by_entity = named.join(chosen, "group").select("_e", "group", "split")
    alone = rendezvous(F.col(row_id).cast("string"), proportions, seed)
    return rows.select(row_id, "_e").join(by_entity, "_e", "left").select(row_id, "group", F.when(F.col("_e").isNull(), alone).otherwise(F.col("split")).alias("split"))
