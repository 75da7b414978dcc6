"""Sources: event logs, feeds, indicators, lookups, snapshots."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.hosts import clean_host, is_host, last_label, trimmed
from wardline.functions.text import url_host
from wardline.schemas import CERTIFICATE, EVENT, SILVER, conform, first_present
from wardline.shipping import ship


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Many Parquet files of drifting schema; unreadable ones are skipped."""
    return spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("mergeSchema", True).parquet(path)


def newest_files(spark: SparkSession, folder: str, n: int = 1, ending: str = ".parquet") -> list[str]:
    """The ``n`` files or folders of that ending that were modified last, newest first; equal times by name."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(-x.getModificationTime(), x.getPath().toString()) for x in (fs.listStatus(root) if fs.exists(root) else []) if x.getPath().getName().endswith(ending)]
    return [path for _, path in sorted(found)[:n]]


def recent_partitions(df: DataFrame, today: str, days: int, column: str = "ingest_date") -> DataFrame:
    """The rows of the last ``days`` partitions by date, up to ``today``; the condition prunes the scan. Rows without a date drop out."""
    return df.where((F.col(column) > F.date_sub(F.lit(today).cast("date"), days).cast("string")) & (F.col(column) <= today))


def read_since(df: DataFrame, column: str, bookmark: object | None) -> DataFrame:
    """Rows beyond a bookmark; the comparison reaches the scan. Without a bookmark all rows."""
    return df if bookmark is None else df.where(F.col(column) > F.lit(bookmark))


def certificates(df: DataFrame, payload: str = "value", keep_one_in: int = 1) -> DataFrame:
    """One row per name of a certificate message: ``position``, ``domain``, ``tld``.

    Names are cleaned, those with other characters dropped, broken messages give
    none. ``keep_one_in`` N keeps positions divisible by N.
    """
    parsed = df.select(F.from_json(F.col(payload).cast("string"), CERTIFICATE).alias("m"))
    names = parsed.select(F.posexplode("m.data.leaf_cert.all_domains").alias("position", "raw")).where(F.pmod("position", F.lit(keep_one_in)) == 0)
    host = clean_host(F.col("raw"))
    return names.where(is_host(trimmed(F.col("raw"))) & (host != "")).select("position", host.alias("domain"), last_label(host).alias("tld"))


def parse_events(df: DataFrame, payload: str = "value") -> DataFrame:
    """Event messages with ``valid`` and, where not, ``reason``; the payload stays.

    A message is valid when it is a JSON object with id and domain. What the parser
    turns into a row of nulls (broken JSON, arrays) is told apart by that.
    """
    text = F.col(payload).cast("string")
    value = F.try_parse_json(text)
    parsed = df.withColumn("event", F.from_json(text, EVENT))
    reason = (
        F.when(text.isNull() | (F.btrim(text) == ""), "empty")
        .when(value.isNull(), "broken_json")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "not_an_object")
        .when(F.col("event.id").isNull(), "no_id")
        .when(F.col("event.domain").isNull(), "no_domain")
    )
    return parsed.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest", per_trigger: int = 5000, group: str | None = None) -> DataFrame:
    """The stream's topic; needs the Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false", "maxOffsetsPerTrigger": str(per_trigger)}
    if group:
        options["kafka.group.id"] = group
    return spark.readStream.format("kafka").options(**options).load()


def database(spark: SparkSession, url: str, table: str, split_by: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, properties: dict[str, str] | None = None) -> DataFrame:
    """A database table, read in ``parts`` ranges of a whole-number column; needs the database's driver."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if split_by and bounds:
        reader = reader.options(partitionColumn=split_by, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def spool(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of events; malformed lines are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def one_in(host: Column, n: int) -> Column:
    """A fixed one in ``n`` of hosts by CRC-32."""
    return F.crc32(host.cast("binary")) % n == 0


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines and comments drop out."""
    line = F.btrim("value")
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#")).withColumn("domain", url_host(F.col("url")))


def malware_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV feed without header, ``#`` comments, nine columns.

    Where the usual column holds few URLs, the first column of which more than half
    are URLs is taken for it, else the first.
    """
    names = ["id", "dateadded", "url", "status", "last_online", "threat", "tags", "link", "reporter"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, comment="#", quote='"', escape='"')
    shares = rows.agg(*[F.avg(F.coalesce(F.col(n).rlike("^https?://"), F.lit(False)).cast("double")).alias(n) for n in names]).first()
    at = next((n for n in ["url", *names] if (shares[n] or 0) > 0.5), names[0])
    if at != "url":
        rows = rows.withColumn("url", F.col(at))
    return rows.where(F.col("url").isNotNull()).withColumn("domain", url_host(F.col("url")))


def feed_time(spark: SparkSession, path: str) -> str | None:
    """The update time that a feed's comment lines name (``yyyy-MM-dd HH:mm:ss``), or none."""
    stamp = F.regexp_extract("value", r"^#.*?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    row = spark.read.text(path).where(F.col("value").startswith("#")).select(F.max(F.nullif(stamp, F.lit(""))).alias("t")).first()
    return row["t"] if row else None


def demand_fresh(spark: SparkSession, path: str, now: str, most_hours: float = 12.0) -> str | None:
    """The feed's update time; raises ``ValueError`` where it names one that is older. A feed that names none passes."""
    said = feed_time(spark, path)
    if said is not None:
        age = (datetime.fromisoformat(now) - datetime.fromisoformat(said)).total_seconds() / 3600
        if age > most_hours:
            raise ValueError(f"feed is {age:.1f} hours old")
    return said


def event_index(pages: DataFrame, html: str, around: str, hours: int = 3, most: int = 100) -> DataFrame:
    """Links of a directory page with their times, those within ``hours`` of a moment, newest first."""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r'(href="[^"]+\.json">[^<]*</a>\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2})'), F.lit(1))).alias("x"))
    found = rows.select(F.regexp_extract("x", r'href="([^"]+)"', 1).alias("url"), F.regexp_extract("x", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1).try_cast("timestamp").alias("modified"))
    near = F.abs(F.unix_seconds("modified") - F.unix_seconds(F.lit(around).cast("timestamp"))) <= hours * 3600
    return found.where(near).orderBy(F.col("modified").desc(), "url").limit(most)


def indicators(df: DataFrame, payload: str = "value") -> DataFrame:
    """One row per attribute of an event document, keys in either case, tags joined.

    Kept are domains, host names and URLs.
    """
    v = F.try_parse_json(F.col(payload))

    def first(root: Column, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(root, p, "string") for p in paths])

    attributes = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$.Event.Attribute", "$.event.attribute", "$.Event.attribute", "$.event.Attribute")])
    tags = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$.Event.Tag", "$.event.tag", "$.Event.tag")])
    names = F.array_join(F.transform(tags, lambda t: F.coalesce(F.try_variant_get(t, "$.name", "string"), F.try_variant_get(t, "$.Name", "string"))), ",")
    clusters = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$.Event.Galaxy", "$.event.galaxy", "$.Event.galaxies", "$.event.galaxies")])
    galaxies = F.array_join(F.filter(F.transform(clusters, lambda g: F.try_variant_get(g, "$.name", "string")), lambda n: n.isNotNull()), ",")
    rows = df.select(
        first(v, "$.Event.id", "$.event.id", "$.Event.uuid").alias("event_id"), first(v, "$.Event.Orgc.name", "$.event.orgc.name").alias("orgc"), names.alias("tags"), galaxies.alias("galaxies"), F.explode(attributes).alias("a")
    )
    out = rows.select("event_id", "orgc", "tags", "galaxies", first(F.col("a"), "$.value", "$.Value").alias("indicator"), first(F.col("a"), "$.type", "$.Type").alias("type"), first(F.col("a"), "$.category", "$.Category").alias("category"))
    return out.where(F.col("type").isin("domain", "hostname", "url") & F.col("indicator").isNotNull())


def indicator_column(df: DataFrame) -> Column:
    """The first present of the names that indicator tables use."""
    return first_present(df, ["indicator", "value", "domain", "ioc", "hostname"])


def ranked_list(spark: SparkSession, path: str) -> DataFrame:
    """A ranking of benign names."""
    return spark.read.schema("rank int, domain string").csv(path)


def labels(frames: list[DataFrame]) -> DataFrame:
    """Label tables of differing columns as one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def silver(df: DataFrame, label: str, source: str) -> DataFrame:
    """A feed in the common five columns; times that can't be read are null."""
    named = df.withColumns({"label": F.lit(label), "source": F.lit(source), "first_seen": first_present(df, ["first_seen", "dateadded"]).try_cast("timestamp")})
    return conform(named, SILVER)[0]


def seen_date(df: DataFrame, column: str = "first_seen", partition: str = "ingest_date") -> Column:
    """The row's own date, else that of its partition."""
    return F.coalesce(F.to_date(F.col(column).try_cast("timestamp")), F.col(partition).try_cast("date"))


def expectations(df: DataFrame, column: str, least_rows: int = 50, pattern: str | None = None, longest: int = 253, unique: bool = True) -> dict[str, int]:
    """counts of violations, all in one aggregate; raises ``ValueError`` naming those that occur."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    c = F.col(column)
    aggregates = {
        "rows": F.count("*"),
        "null": F.count_if(c.isNull()),
        "length": F.count_if((F.length(c) < 1) | (F.length(c) > longest)),
        "pattern": F.count_if(~c.rlike(pattern)) if pattern else F.lit(0),
        "repeated": F.count(c) - F.count_distinct(c) if unique else F.lit(0),
    }
    got = df.agg(*[v.alias(k) for k, v in aggregates.items()]).first().asDict()
    wrong = {k: v for k, v in got.items() if k != "rows" and v} | ({"rows": got["rows"]} if got["rows"] < least_rows else {})
    if wrong:
        raise ValueError(f"expectations not met on {column}: {wrong}")
    return got


def fetch(get: Callable[[], tuple[int, str]], least: int = 1, tries: int = 3, pause: float = 2.0, secrets: tuple[str, ...] = ()) -> str:
    """A feed's body. 401, 403, 404 and 410 end at once, all else is tried again; a short body counts as failure; secrets are masked."""
    said = "nothing"
    for attempt in range(tries):
        try:
            code, body = get()
        except OSError as e:
            code, body, said = 0, "", str(e)
        if code == 200 and len(body) >= least:
            return body
        said = f"status {code}, {len(body)} characters" if code else said
        if code in (401, 403, 404, 410):
            break
        if attempt + 1 < tries:
            time.sleep(pause * 2**attempt)
    for s in secrets:
        said = said.replace(s, "***")
    raise RuntimeError(f"feed not fetched: {said}")


def latest_snapshot(spark: SparkSession, folder: str, pointer: str = "latest.json", override: str | None = None) -> str:
    """The override, else what the pointer file names, else the last name in the folder."""
    if override:
        return override
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = jvm.org.apache.hadoop.fs.Path(root, pointer)
    if fs.exists(where):
        text = spark.read.text(where.toString()).first()[0]
        return json.loads(text)["path"]
    names = sorted(x.getPath().toString() for x in fs.listStatus(root) if re.search(r"\.parquet$|/snapshot-[^/]+$", x.getPath().toString()))
    if not names:
        raise FileNotFoundError(f"no snapshot in {folder}")
    return names[-1]


def freshness(df: DataFrame) -> DataFrame:
    """Partitions (folders), files, rows and newest modification of a table read from files, and its age in seconds."""
    meta = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).groupBy("f").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    one = meta.agg(F.count_distinct(F.regexp_replace("f", "/[^/]*$", "")).alias("partitions"), F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("t").alias("newest"))
    return one.withColumn("age_seconds", F.unix_seconds(F.current_timestamp()) - F.unix_seconds("newest"))


class Breaker:
    """Opens after so many failures in a row, lets one probe through after a pause, closes on its success and opens again on its failure."""

    def __init__(self, failures: int = 5, pause: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.failures, self.pause, self.clock = failures, pause, clock
        self.bad, self.opened = 0, None

    @property
    def state(self) -> str:
        """``closed``, ``open``, or ``half_open`` when a probe is due."""
        if self.opened is None:
            return "closed"
        return "half_open" if self.clock() - self.opened >= self.pause else "open"

    def told(self, good: bool) -> None:
        """What came of a call."""
        probe = self.state == "half_open"
        self.bad = 0 if good else self.bad + 1
        if good:
            self.opened = None
        elif probe or self.bad >= self.failures:
            self.opened = self.clock()


def look_up(df: DataFrame, key: str, fetcher: Callable[[str], str | None], per_second: float = 20.0, failures: int = 5, pause: float = 300.0, timeout: float = 30.0, tasks: int | None = None) -> DataFrame:
    """An external lookup of each distinct key by an injected function, off unless called.

    ``per_second`` is the rate of all ``tasks`` together (by default the session's
    shuffle width), each of which takes its part. A call that takes longer than
    ``timeout`` counts as failed. After ``failures`` in a row a task pauses its calls, see ``Breaker``; keys that
    weren't looked up have ``outcome`` ``skipped``.
    """
    width = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker, due = Breaker(failures, pause), 0.0
        pool = ThreadPoolExecutor(8)  # a call that never ends holds one thread
        for frame in frames:
            rows = []
            for k in frame[key]:
                if breaker.state == "open":
                    rows.append((k, None, "skipped"))
                    continue
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + width / per_second
                try:
                    rows.append((k, pool.submit(fetcher, k).result(timeout), "ok"))
                    breaker.told(True)
                except Exception as e:  # noqa: BLE001 - any failure of a foreign service counts
                    rows.append((k, None, f"error: {str(e) or type(e).__name__}"))
                    breaker.told(False)
            yield pd.DataFrame(rows, columns=[key, "answer", "outcome"])

    ship(df.sparkSession)
    return df.select(key).where(F.col(key).isNotNull()).distinct().repartition(width, key).mapInPandas(run, f"`{key}` string, answer string, outcome string")
