"""Streams: validated ingest, de-duplication, routing, late corrections, liveness."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wardline.functions.times import from_micros, text_micros
from wardline.operators import late
from wardline.operators.triage import Rules, triage
from wardline.scratch import discard
from wardline.sources import sinks
from wardline.sources.feeds import parse_events

#: Session settings of the long-running stream: state size and retention, and the watermark of several inputs.
STREAM_CONFS = {
    "spark.sql.streaming.stateStore.minDeltasForSnapshot": "10",
    "spark.sql.streaming.minBatchesToRetain": "20",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> None:
    """ST4: apply the stream's settings."""
    for k, v in STREAM_CONFS.items():
        spark.conf.set(k, v)


def outbox(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """K6, ST6: replay of events dropped as files of JSON lines, oldest first; repeats are for ``deduplicated`` to absorb."""
    reader = spark.readStream.option("latestFirst", False)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).withColumn("ingest_ts", F.current_timestamp())


def deduplicated(events: DataFrame, within: str = "10 minutes") -> DataFrame:
    """ST1-ST2, ST6: valid events once per id within the watermark; state is bounded by it.

    Events without a usable time are left out (see ``untimed``); those behind the
    watermark are dropped, which ``LateDrops`` tells. The batch twin, without a horizon, is ``operators.delivery``.
    """
    valid = events.where("valid").select("event.*", "ingest_ts")
    timed = valid.withColumn("event_time", from_micros(text_micros(F.col("event_ts"))).cast("timestamp")).where("event_time is not null")
    return timed.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["id"])


def untimed(events: DataFrame) -> DataFrame:
    """Valid events whose time is missing or unusable, in the form of dead letters."""
    rows = events.where("valid").where(from_micros(text_micros(F.col("event.event_ts"))).isNull())
    return rows.select(F.col("value").cast("string").alias("value"), F.lit("no_time").alias("reason"), F.col("ingest_ts").alias("ig_ts"))


class LateDrops(StreamingQueryListener):
    """ST5: tells of each batch of the query ``name`` how many rows were behind the watermark and dropped (numRowsDroppedByWatermark)."""

    def __init__(self, name: str, tell: Callable[[int], None]) -> None:
        self.name, self.tell = name, tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        dropped = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        if event.progress.name == self.name and dropped:
            self.tell(dropped)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def ingest(
    raw: DataFrame, out: str, dead: str, checkpoint: str, trigger: dict | None = None, rules: Rules | None = None, spool: str | None = None, tell_dropped: Callable[[int], None] | None = None
) -> list[StreamingQuery]:
    """K1-K2, T7, ST3: valid events to a table by day (and below the threshold to a spool), broken ones with a reason to ``dead``.

    Valid ones without a usable time go to dead letters of their own, ``dead`` with
    ``_untimed``. How many rows of a batch the watermark drops is given to
    ``tell_dropped``, by default a warning in the log.
    ``raw`` has ``value`` and ``ingest_ts``. Triage runs on each micro-batch, in
    parallel and after de-duplication, where it is an ordinary query.
    """
    when = trigger or {"processingTime": "5 seconds"}
    parsed = parse_events(raw)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("ds", F.to_date("event_time"))
        scored = rows.join(triage(rows, "domain", rules).select(F.col("host"), "score", "reasons", "decision"), F.rtrim(F.lower(F.btrim("domain")), F.lit(".")) == F.col("host"), "left").drop("host") if rules else rows
        scored = scored.withColumn("batch", F.lit(number))
        # a repeated batch replaces its own partition, so a restart repeats nothing
        def put(part: DataFrame, path: str) -> None:
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ds", "batch").parquet(path)

        if rules and spool:
            scored.persist()
            put(scored.where("decision = 'forward'"), out)
            put(scored.where("decision = 'spool'"), spool)
            scored.unpersist()
        else:
            put(scored, out)

    name = f"ingest-{uuid.uuid4()}"
    raw.sparkSession.streams.addListener(LateDrops(name, tell_dropped or (lambda n: logging.getLogger(__name__).warning("%d rows behind the watermark dropped on the way to %s", n, out))))
    good = deduplicated(parsed).writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", f"{checkpoint}/good").trigger(**when).start()
    bad = parsed.where("not valid").select(F.col("value").cast("string").alias("value"), "reason", F.col("ingest_ts").alias("ig_ts"))
    broken = bad.writeStream.format("parquet").option("path", dead).option("checkpointLocation", f"{checkpoint}/dead").outputMode("append").trigger(**when).start()
    no_time = untimed(parsed).writeStream.format("parquet").option("path", f"{dead.rstrip('/')}_untimed").option("checkpointLocation", f"{checkpoint}/untimed").outputMode("append").trigger(**when).start()
    return [good, broken, no_time]


def console(df: DataFrame, rows: int = 20) -> StreamingQuery:
    """K3: print batches while debugging."""
    return df.writeStream.format("console").option("numRows", rows).option("truncate", False).start()


class CorrectedCounts:
    """Event-time counts per key, corrected by late messages: keyed state, upserts, diverted rejections.

    Each micro-batch is aggregated and added to the state of the open periods; the
    periods it touched are emitted as upserts. The watermark is the latest arrival
    seen: a period whose cut-off it has passed leaves the state for the table of
    final counts. A record within its cut-off that is delivered even later still
    counts: it is added to the final count on reading, and its upsert holds the sum.
    Records that change a result already emitted are listed as corrections, those
    beyond the cut-off change nothing and are diverted; both with the columns ``carry``.
    All that a batch writes is named by its number and replaced if the batch is
    repeated, so a restart counts nothing twice; the result equals
    ``operators.late.current`` over the same records, in any order and any batches.
    The state of the last two batches is kept, older state is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], carry: list[str] | None = None) -> None:
        self.spark, self.folder, self.keys, self.carry = spark, folder.rstrip("/"), keys, carry or []

    def start(self, records: DataFrame, event: Column, arrival: Column, **trigger: object) -> StreamingQuery:
        """Start the stream over ``records``; ``availableNow`` unless a trigger is given."""
        columns = dict.fromkeys([*self.keys, *self.carry, "period_start", "arrived", "outcome"])
        routed = late.route(records, event, arrival).select(*columns)
        writer = routed.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def replay(self, records: DataFrame, event: Column, arrival: Column, batches: int = 4) -> CorrectedCounts:
        """Run a table of files (see ``scratch.materialize``) through the stream in so many batches, and wait for the end."""
        files = records.inputFiles()
        if files:
            # the stream lists the folder of the files, all of which are of one table
            path = files[0].rsplit("/", 1)[0]
            stream = self.spark.readStream.schema(records.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(path)
            self.start(stream, event, arrival).awaitTermination()
        return self

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/batch={number}"

    def _step(self, batch: DataFrame, number: int) -> None:
        groups = [*self.keys, "period_start"]
        batch.persist()
        try:
            batch.where("outcome = 'rejected'").drop("outcome").write.mode("overwrite").parquet(self._path("rejected", number))
            batch.where("outcome = 'corrects'").drop("outcome").write.mode("overwrite").parquet(self._path("corrections", number))
            delta = batch.where("outcome <> 'rejected'").groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "corrects").alias("n_corrections"), F.max("arrived").alias("seen"))
            delta = delta.withColumn("touched", F.lit(True))
            both = delta
            if number > 0:
                before = self.spark.read.parquet(self._path("state", number - 1)).withColumn("touched", F.lit(False))
                both = before.unionByName(delta)
            merged = both.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("n_corrections").alias("n_corrections"), F.max("seen").alias("seen"), F.max("touched").alias("touched"))
            merged.write.mode("overwrite").parquet(self._path("merged", number))
            merged = self.spark.read.parquet(self._path("merged", number))
            watermark = merged.agg(F.max("seen")).first()[0]
            is_open = F.lit(True) if watermark is None else F.col("period_start") + late.PERIOD + late.CUTOFF >= watermark
            touched = merged.where("touched")
            emitted = touched.drop("seen", "touched")
            if number > 0:
                # of a period that left the state before, the state holds this batch's records only
                first, last = touched.where(~is_open).agg(F.min("period_start"), F.max("period_start")).first()
                if first is not None:
                    retired = touched.where(~is_open).select("period_start").distinct()
                    final = self._table("final").where((F.col("batch") < number) & F.col("period_start").between(first, last)).drop("batch").join(retired, "period_start", "left_semi")
                    both = touched.drop("seen").unionByName(final.withColumn("touched", F.lit(False)))
                    emitted = both.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("n_corrections").alias("n_corrections"), F.max("touched").alias("touched")).where("touched").drop("touched")
            emitted.write.mode("overwrite").parquet(self._path("upserts", number))
            merged.where(~is_open).drop("touched", "seen").write.mode("overwrite").parquet(self._path("final", number))
            merged.where(is_open).drop("touched").write.mode("overwrite").parquet(self._path("state", number))
            # a repeated batch needs the state before it and nothing older
            discard(self.spark, self._path("merged", number))
            discard(self.spark, self._path("state", number - 2))
        finally:
            batch.unpersist()

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}/batch=*")

    def upserts(self) -> DataFrame:
        """Every emitted count with the ``batch`` that emitted it."""
        return self._table("upserts")

    def upserted(self) -> DataFrame:
        """What a sink that upserts by key and period holds in the end: the last emitted count of each."""
        last = F.max_by(F.struct("n", "n_corrections"), "batch")
        return self.upserts().groupBy(*self.keys, "period_start").agg(last.alias("_last")).select(*self.keys, "period_start", "_last.*")

    def current(self) -> DataFrame:
        """The counts per key and period after all batches so far."""
        state = self._table("state")
        newest = state.agg(F.max("batch")).first()[0]
        if newest is None:  # no period is open
            newest = -1
        rows = state.where(F.col("batch") == newest).unionByName(self._table("final"), allowMissingColumns=True)
        return rows.groupBy(*self.keys, "period_start").agg(F.sum("n").alias("n"), F.sum("n_corrections").alias("n_corrections"))

    def corrections(self) -> DataFrame:
        """Records that came after their period's first result and changed it."""
        return self._table("corrections")

    def rejected(self) -> DataFrame:
        """Records beyond the cut-off."""
        return self._table("rejected")


def backoff(healthy_seconds: float, last: float, first: float = 2.0, most: float = 60.0, healthy: float = 30.0) -> float:
    """ST8: seconds to wait before connecting again: none after a healthy run, else doubling up to a limit."""
    return 0.0 if healthy_seconds >= healthy else min(most, max(first, last * 2))


class Watchdog:
    """ST7: tells when a stream goes stale, again every so often while it stays so, and when it recovers."""

    def __init__(self, stale_after: float, repeat_every: float, tell: Callable[[str, float], None]) -> None:
        self.stale_after, self.repeat_every, self.tell = stale_after, repeat_every, tell
        self.stale_since: float | None = None
        self.told: float = 0.0

    def look(self, newest: float, now: float) -> str:
        """Compare the newest record's time with now; returns ``fresh``, ``stale``, ``still_stale`` or ``recovered``."""
        age = now - newest
        if age <= self.stale_after:
            was, self.stale_since = self.stale_since, None
            if was is None:
                return "fresh"
            self.tell("recovered", age)
            return "recovered"
        if self.stale_since is None:
            self.stale_since = self.told = now
            self.tell("stale", age)
            return "stale"
        if now - self.told >= self.repeat_every:
            self.told = now
            self.tell("still_stale", age)
        return "still_stale"


class Liveness(StreamingQueryListener):
    """ST7: looks, at each progress of the query ``name``, whether rows still come; what it last saw outlives a restart in a small file."""

    def __init__(self, spark: SparkSession, name: str, path: str, dog: Watchdog, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.name, self.path, self.dog, self.clock = spark, name, path, dog, clock
        _, p, fs = sinks._fs(spark, path)
        seen = json.loads(spark.read.text(path, wholetext=True).first()[0]) if fs.exists(p) else {}
        self.newest = seen.get("newest", clock())
        dog.stale_since, dog.told = seen.get("stale_since"), seen.get("told", 0.0)

    def look(self, rows: int) -> str:
        """One progress that brought so many rows."""
        now = self.clock()
        if rows:
            self.newest = now
        state = self.dog.look(self.newest, now)
        sinks.write_file(self.spark, self.path, json.dumps({"newest": self.newest, "stale_since": self.dog.stale_since, "told": self.dog.told}))
        return state

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self.look(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.look(0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
