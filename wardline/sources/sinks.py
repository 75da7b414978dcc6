"""Sinks: partitioned tables, versioned snapshots, summaries, exports, retention."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it and renamed over it in one step, so a reader finds the old or the new one."""
    jvm, target, fs = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(files.makeQualified(beside), files.makeQualified(target), over)


def kafka_rows(df: DataFrame, key: str = "domain") -> DataFrame:
    """K5: events as keyed JSON messages; events of one host go to one partition, in order."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def to_kafka(df: DataFrame, servers: str, topic: str, key: str = "domain") -> None:
    """K5: write events to a topic, acknowledged by all replicas; needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}
    kafka_rows(df, key).write.format("kafka").options(**options).save()


def advance_bookmark(df: DataFrame, column: str, path: str) -> str | None:
    """Write the greatest value of a column as the next bookmark; without rows the old one stays."""
    newest = df.agg(F.max(F.col(column).cast("string"))).first()[0]
    if newest is not None:
        write_file(df.sparkSession, path, json.dumps({"column": column, "value": newest}))
    return newest


def bookmark(spark: SparkSession, path: str) -> str | None:
    """The last bookmark, or none."""
    _, p, fs = _fs(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])["value"] if fs.exists(p) else None


class Outbox:
    """K6: events that couldn't be sent wait in folders of JSON lines; sealed ones are sent oldest first and deleted once acknowledged.

    A crash between sending and deleting sends a folder again, which the
    de-duplication downstream absorbs; a line that was torn is left out and counted.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, events: DataFrame) -> None:
        """Write events aside; they wait for ``seal``."""
        events.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{self.folder}/open-{time.time_ns():020}")

    def _list(self, kind: str) -> list:
        _, root, fs = _fs(self.spark, self.folder)
        return sorted((x for x in (fs.listStatus(root) if fs.exists(root) else []) if x.getPath().getName().startswith(kind)), key=lambda x: x.getPath().getName())

    def seal(self) -> int:
        """Close what has been written whole; returns how many folders. What a crash left without its mark of success stays open."""
        jvm, _, fs = _fs(self.spark, self.folder)
        path = jvm.org.apache.hadoop.fs.Path
        whole = [x.getPath() for x in self._list("open-") if fs.exists(path(x.getPath(), "_SUCCESS"))]
        return sum(bool(fs.rename(p, path(p.getParent(), p.getName().replace("open-", "sealed-", 1)))) for p in whole)

    def pending(self) -> int:
        """Events that wait, sealed or not."""
        paths = [x.getPath().toString() for x in self._list("")]
        return self.spark.read.text(paths).where("trim(value) <> ''").count() if paths else 0

    def replay(self, send: Callable[[DataFrame], bool]) -> dict[str, int]:
        """Seal, then give each folder's valid lines (``value``) to ``send``, oldest first; a folder goes when that returns true and stays if it doesn't or raises."""
        self.seal()
        told = {"replayed": 0, "torn": 0, "kept": 0}
        _, _, fs = _fs(self.spark, self.folder)
        for x in self._list("sealed-"):
            lines = self.spark.read.text(x.getPath().toString()).where("trim(value) <> ''")
            good = F.try_parse_json("value").isNotNull()
            n, n_good = lines.agg(F.count("*"), F.count_if(good)).first()
            try:
                done = bool(send(lines.where(good))) if n_good else True
            except Exception as e:  # noqa: BLE001 - the receiver may fail in any way
                logging.getLogger(__name__).warning("replay of %s interrupted, it is kept: %r", x.getPath().getName(), e)
                done = False
            if done:
                fs.delete(x.getPath(), True)
                told["replayed"] += n_good
                told["torn"] += n - n_good
            else:
                told["kept"] += 1
        return told

    def prune(self, older_than_days: float, now_ms: int) -> int:
        """Delete sealed folders that are older, with the events in them; returns how many. Open ones stay."""
        _, _, fs = _fs(self.spark, self.folder)
        old = [x.getPath() for x in self._list("sealed-") if x.getModificationTime() < now_ms - older_than_days * 86_400_000]
        for p in old:
            fs.delete(p, True)
        return len(old)


def append_by_day(df: DataFrame, path: str, day: str = "ds") -> None:
    """K1: append to a table partitioned by day."""
    df.write.mode("append").partitionBy(day).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """K8: overwrite only the partitions that the rows name, so a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(df: DataFrame, folder: str, version: str, pointer: str = "latest.json", move_pointer: bool = True) -> str:
    """K7, K9: write a snapshot of its own, then move the pointer; a backfill leaves the pointer alone."""
    path = f"{folder.rstrip('/')}/snapshot-{version}"
    df.write.mode("errorifexists").parquet(path)
    if move_pointer:
        write_file(df.sparkSession, f"{folder.rstrip('/')}/{pointer}", json.dumps({"path": path, "version": version}))
    return path


def audit_then_publish(df: DataFrame, folder: str, version: str, checks: Sequence[tuple[str, Column]], pointer: str = "latest.json") -> str:
    """Write, check every row of what was written, and only then move the pointer; raises on a violation."""
    path = publish(df, folder, version, pointer, move_pointer=False)
    spark = df.sparkSession
    got = spark.read.parquet(path).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks]).first().asDict()
    wrong = {n: got[n] for n, _ in checks if got[n]}
    if wrong or not got["rows"]:
        raise ValueError(f"snapshot {version} not published: {wrong or 'empty'}")
    write_file(spark, f"{folder.rstrip('/')}/{pointer}", json.dumps({"path": path, "version": version}))
    return path


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as JSON."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines."""
    df.write.mode("append").json(path)


def prune_days(spark: SparkSession, path: str, before: str, column: str = "ds", dry_run: bool = True, today: str | None = None) -> list[str]:
    """Partitions of days before a date, by their names and never their file times; deleted unless dry.

    ``today`` and what comes after it is never pruned: at least one day stays.
    """
    if today is not None:
        before = min(before, today)
    _, root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = [(x.getPath(), re.search(rf"/{column}=(\d{{4}}-\d{{2}}-\d{{2}})$", x.getPath().toString())) for x in fs.listStatus(root)]
    old = [(p, m[1]) for p, m in names if m and m[1] < before]
    if not dry_run:
        for p, _ in old:
            fs.delete(p, True)
    return sorted(d for _, d in old)


def reset_stream(spark: SparkSession, output: str, checkpoint: str) -> None:
    """K4: forget a stream's output log and its checkpoint together; one without the other loses or repeats rows."""
    for path in (f"{output.rstrip('/')}/_spark_metadata", checkpoint):
        _, p, fs = _fs(spark, path)
        if fs.exists(p) and not fs.delete(p, True):
            raise OSError(f"{path} could not be removed")


def stable_uuid(*parts: Column) -> Column:
    """An identifier in UUID form from SHA-1 of the parts, the same on every run."""
    h = F.sha1(F.concat_ws("|", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def export_campaigns(clusters: DataFrame, members: DataFrame, when: str) -> DataFrame:
    """One JSON document per campaign (``id``, ``document``): a bundle of a campaign, its indicators and their relations.

    ``clusters``: ``id``, ``brand``; ``members``: ``id``, ``host``. A campaign of very
    many hosts comes in several documents of ``part``, by 1,000 hosts on average.
    """
    spread = members.groupBy("id").agg(F.count("*").alias("_n")).select("id", F.ceil(F.col("_n") / 1000).cast("int").alias("_parts"))
    rows = members.where("host is not null").distinct().join(spread, "id").withColumn("part", F.pmod(F.xxhash64("host"), F.col("_parts")).cast("int"))
    campaign_id = F.concat(F.lit("campaign--"), stable_uuid(F.lit("campaign"), F.col("id").cast("string")))
    indicator_id = F.concat(F.lit("indicator--"), stable_uuid(F.lit("indicator"), F.col("host")))
    indicator = F.struct(F.lit("indicator").alias("type"), indicator_id.alias("id"), F.concat(F.lit("[domain-name:value = '"), F.replace("host", F.lit("'"), F.lit("\\'")), F.lit("']")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit(when).alias("valid_from"))
    relation = F.struct(F.lit("relationship").alias("type"), F.concat(F.lit("relationship--"), stable_uuid(F.lit("relationship"), F.col("id").cast("string"), F.col("host"))).alias("id"), F.lit("indicates").alias("relationship_type"), indicator_id.alias("source_ref"), campaign_id.alias("target_ref"))
    packed = rows.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct(F.col("host"), F.to_json(indicator).alias("i"), F.to_json(relation).alias("r")))).alias("x"))
    joined = packed.join(clusters.select("id", "brand"), "id")
    campaign = F.to_json(F.struct(F.lit("campaign").alias("type"), campaign_id.alias("id"), F.coalesce("brand", F.lit("unknown")).alias("name")))
    objects = F.concat(F.array(campaign), F.transform("x", lambda m: m["i"]), F.transform("x", lambda m: m["r"]))
    document = F.concat(F.lit('{"type":"bundle","id":"bundle--'), stable_uuid(F.lit("bundle"), F.col("id").cast("string"), F.col("part").cast("string")), F.lit('","spec_version":"2.1","objects":['), F.array_join(objects, ","), F.lit("]}"))
    return joined.select("id", "part", document.alias("document"))


def export_plain(clusters: DataFrame, members: DataFrame, dispositions: DataFrame, when: str) -> DataFrame:
    """One plain JSON document per campaign (``id``, ``part``, ``document``): the campaign, its newest disposition and its indicators.

    ``members`` has ``id`` of the campaign and an ``indicator`` struct; ``dispositions``
    has ``cluster_id``, ``id`` and whatever is to be shown. A campaign of very many members
    comes in several documents of 1,000 on average; one without members in one.
    """
    shown = [c for c in dispositions.columns if c not in ("cluster_id", "id")]
    newest = dispositions.where("cluster_id is not null").groupBy("cluster_id").agg(F.max_by(F.struct(*shown), "id").alias("_disposition"))
    spread = members.groupBy("id").agg(F.count("*").alias("_n")).select("id", F.ceil(F.col("_n") / 1000).cast("int").alias("_parts"))
    packed = members.join(spread, "id").withColumn("part", F.pmod(F.xxhash64("indicator"), F.col("_parts")).cast("int")).groupBy("id", "part").agg(F.array_sort(F.collect_list("indicator")).alias("_indicators"))
    joined = clusters.join(newest, clusters["id"] == newest["cluster_id"], "left").drop("cluster_id").join(packed, "id", "left")
    campaign = F.struct(*[F.col(c) for c in clusters.columns])
    document = F.to_json(F.struct(F.lit("json").alias("export_format"), F.lit(when).alias("exported_at"), campaign.alias("campaign"), F.col("_disposition").alias("disposition"), F.coalesce("_indicators", F.array()).alias("indicators")), {"ignoreNullFields": "false"})
    return joined.select("id", F.coalesce("part", F.lit(0)).alias("part"), document.alias("document"))
