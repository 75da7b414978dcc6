"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else one of our own for a local master.

    A machine-local folder is only made where the session names none and runs
    in one process; on a cluster without the setting this raises.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("wardline.scratch.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wardline-")
    spark.conf.set("wardline.scratch.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which ``purge`` knows by its name."""
    return f"{scratch_dir(spark).rstrip('/')}/wardline-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialized table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for a shuffle of ``rows``: the session's setting, or more so that no task gets over ``per_task`` on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def purge(spark: SparkSession, older_than_hours: float, now_ms: int) -> list[str]:
    """Delete this package's intermediate tables in the shared folder that are older; returns their names.

    They stay after a query, since nobody knows when its result is last read; run this between jobs.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in (fs.listStatus(root) if fs.exists(root) else []) if x.getPath().getName().startswith("wardline-") and now_ms - x.getModificationTime() > older_than_hours * 3_600_000]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)
