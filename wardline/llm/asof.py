"""Attributes as known at event time: duckdb's ASOF LEFT JOIN in hash buckets.

Events and the versions of attributes are dealt to buckets by entity; each
bucket is one embedded ASOF LEFT JOIN per kind of attribute, on versions ordered
by when they became available, each being the state until the next. Before that,
versions of one entity and time are reduced to one by a fixed rule.

An entity with more events than a bucket should hold is dealt to several buckets
by event, and its versions to each of these. An entity with more versions than
that is cut into slices of time: events and versions go to the slice of their
time, and each slice also gets the last version before it.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.scratch import materialize, shuffle_width
from wardline.shipping import ship

ROWS_PER_BUCKET = 60_000
VERSIONS_PER_SLICE = 100_000
#: Up to so many entities with many events or versions their list is broadcast; a longer one is joined by shuffle.
MOST_LISTED = 20_000
_VERSION = "kind string, entity string, available long, v1 string, v2 long"


def versions(lookups: DataFrame, kind: str, entity: Column, available: Column, text: Column | None = None, number: Column | None = None) -> DataFrame:
    """Availability-ordered versions of one kind: ``v1`` (text) and ``v2`` (number).

    Rows with a null entity or time are left out. Of several rows of one entity
    and time the greatest (v1, v2) is kept, nulls last.
    """
    rows = lookups.select(
        entity.alias("entity"),
        available.alias("available"),
        (F.lit(None) if text is None else text).cast("string").alias("v1"),
        (F.lit(None) if number is None else number).cast("long").alias("v2"),
    ).where("entity is not null and available is not null")
    one = rows.groupBy("entity", "available").agg(F.max(F.struct("v1", "v2")).alias("v"))
    return one.select(F.lit(kind).alias("kind"), "entity", "available", "v.v1", "v.v2")


def _bucket_join(kinds: list[str]):
    columns = ", ".join(f"v{i}.v1 as v1_{i}, v{i}.v2 as v2_{i}, v{i}.entity is not null as has_{i}" for i in range(len(kinds)))
    joins = " ".join(f"asof left join (select * from versions where kind = '{k}') v{i} on e.entity = v{i}.entity and e.at >= v{i}.available" for i, k in enumerate(kinds))
    query = f"select e.row, {columns} from events e {joins}"
    kind_of = {"row": pa.int64(), **{k: t for i in range(len(kinds)) for k, t in ((f"v1_{i}", pa.string()), (f"v2_{i}", pa.int64()), (f"has_{i}", pa.bool_()))}}
    schema = pa.schema(list(kind_of.items()))

    def join(events: pa.Table, versions_: pa.Table) -> pa.Table:
        import duckdb

        if not events.num_rows:
            return schema.empty_table()
        con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        try:
            con.register("events", events)
            con.register("versions", versions_)
            got = con.sql(query).to_arrow_table()
        finally:
            con.close()
        return pa.Table.from_arrays([got.column(n).cast(t) for n, t in kind_of.items()], schema=schema)

    return join, ", ".join(f"{n} {'long' if t == pa.int64() else 'string' if t == pa.string() else 'boolean'}" for n, t in kind_of.items())


def _slice(at: Column) -> Column:
    """The slice of a time: how many of the entity's cuts are at or before it."""
    return F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= at)))


def _cuts(known: DataFrame, per_slice: int) -> DataFrame:
    """``entity``, ``_cuts``: times that cut an entity's versions into slices of ``per_slice`` and one minute's versions at most."""
    minute = F.floor(F.col("available") / F.lit(60_000_000)).cast("long") * F.lit(60_000_000)
    per_minute = known.groupBy("entity", minute.alias("_t")).agg(F.count("*").alias("_n"))
    in_time = Window.partitionBy("entity").orderBy("_t")
    before = F.sum("_n").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    numbered = per_minute.withColumn("_k", F.floor(F.coalesce(before, F.lit(0)) / F.lit(per_slice)))
    firsts = numbered.groupBy("entity", "_k").agg(F.min("_t").alias("_t")).where("_k > 0")
    return firsts.groupBy("entity").agg(F.array_sort(F.collect_list("_t")).alias("_cuts"))


def _with_carry(known: DataFrame) -> DataFrame:
    """Versions with their ``_slice``; each slice but an entity's first also gets the last version before it, per kind."""
    own = known.withColumn("_slice", _slice(F.col("available")))
    last = own.where("_cuts is not null").groupBy("kind", "entity", "_slice").agg(F.max_by(F.struct("available", "v1", "v2"), "available").alias("v"), F.max(F.size("_cuts")).alias("_n"), F.max("_salts").alias("_salts"))
    every = last.groupBy("kind", "entity").agg(F.max("_n").alias("_n"), F.max("_salts").alias("_salts")).select("kind", "entity", "_salts", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_slice"))
    so_far = Window.partitionBy("kind", "entity").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    carried = every.join(last.drop("_n", "_salts"), ["kind", "entity", "_slice"], "left").withColumn("v", F.last("v", ignorenulls=True).over(so_far)).where("v is not null")
    columns = ["kind", "entity", "available", "v1", "v2", "_salts", "_slice"]
    return own.select(columns).unionByName(carried.select("kind", "entity", "v.available", "v.v1", "v.v2", "_salts", "_slice"))


def as_of(
    events: DataFrame, row_id: str, entity: Column, at: Column, kinds: Mapping[str, DataFrame], rows_per_bucket: int = ROWS_PER_BUCKET, versions_per_slice: int = VERSIONS_PER_SLICE, most_listed: int = MOST_LISTED
) -> DataFrame:
    """Per event the values of the latest version of each kind available at its time.

    Columns: ``row_id`` and per kind ``<kind>_v1``, ``<kind>_v2``, ``<kind>_known``
    (whether there was any version). A version available at the very time counts.
    Events with a null id, entity or time are left out; ``row_id`` must be a whole
    number, and an event that repeats one comes out again; other columns are not read. Entities without
    versions come out with nothing known; without events there are no rows. The
    three sizes only choose the way, not the result.
    """
    spark = events.sparkSession
    ship(spark)
    rows = events.select(F.col(f"`{row_id}`").cast("long").alias("row"), entity.alias("entity"), at.alias("at")).where("row is not null and entity is not null and at is not null")
    known = None
    for name, df in kinds.items():
        part = df.select(F.lit(name).alias("kind"), "entity", "available", "v1", "v2")
        known = part if known is None else known.unionByName(part)
    buckets = max(shuffle_width(spark, 0, 1), -(-events.count() // rows_per_bucket))
    limit = max(1, rows_per_bucket // 4)
    counts = rows.groupBy("entity").agg(F.count("*").alias("_n"), F.lit(0).cast("long").alias("_m")).unionByName(known.groupBy("entity").agg(F.lit(0).cast("long").alias("_n"), F.count("*").alias("_m")))
    large = counts.groupBy("entity").agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).where((F.col("_n") > limit) | (F.col("_m") > versions_per_slice))
    large, _ = materialize(large.select("entity", F.greatest(F.lit(1), F.ceil(F.col("_n") / limit)).cast("int").alias("_salts"), (F.col("_m") > versions_per_slice).alias("_crowded")), "large-entities")
    n_large, n_crowded = large.agg(F.count("*"), F.count_if("_crowded")).first()

    def listed(df: DataFrame) -> DataFrame:
        # counted above; a longer list is joined by shuffle, where adaptive execution splits hot entities
        return F.broadcast(df) if n_large <= most_listed else df

    if n_crowded:
        of_crowded = known.join(listed(large.where("_crowded").select("entity")), "entity", "left_semi")
        large, _ = materialize(large.join(_cuts(of_crowded, versions_per_slice), "entity", "left").select("entity", "_salts", "_cuts"), "sliced-entities")
    else:
        large = large.select("entity", "_salts", F.lit(None).cast("array<bigint>").alias("_cuts"))

    def with_large(df: DataFrame) -> DataFrame:
        if not n_large:
            return df.withColumns({"_salts": F.lit(1), "_cuts": F.lit(None).cast("array<bigint>")})
        return df.join(listed(large), "entity", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    def place(salt: Column) -> Column:
        return F.pmod(F.xxhash64("entity", "_slice", salt), F.lit(buckets)).cast("int")

    sliced = with_large(rows).withColumn("_slice", _slice(F.col("at")))
    salted = sliced.select(place(F.pmod(F.xxhash64("row"), F.col("_salts")).cast("int")).alias("bucket"), "row", "entity", "at")
    cut = with_large(known)
    sliced_versions = _with_carry(cut) if n_crowded else cut.withColumn("_slice", F.lit(0))
    # several salts of one entity may fall into one bucket: its versions go there once
    everywhere = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_salts") - 1), place))
    dealt = sliced_versions.select(F.explode(everywhere).alias("bucket"), "kind", "entity", "available", "v1", "v2")
    join, schema = _bucket_join(list(kinds))
    joined = salted.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(join, schema)
    return joined.select(F.col("row").alias(row_id), *[F.col(f"{c}_{i}").alias(f"{k}_{n}") for i, k in enumerate(kinds) for c, n in (("v1", "v1"), ("v2", "v2"), ("has", "known"))])
