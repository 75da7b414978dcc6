"""Top N items within every group: two-stage salted ranking.

Each group is hashed into subgroups by item; every subgroup keeps its N best,
and the survivors, at most N times the salts per group, are ranked once more.
The order is score descending, then identifier ascending, in both stages, so the
result is the same on every run and however the rows are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, salts: int = SALTS, unique: bool = False) -> DataFrame:
    """``group``, ``item``, ``score`` and ``rank`` (from 1) of the ``n`` best items of each group.

    Rows with a null group, a null or NaN score, or a null item don't take part.
    An item that comes several times in a group takes part once, with its best
    score; a caller that knows the pairs of group and item to be ``unique`` saves a
    shuffle. Other columns are not read. A group without rows that take part, and
    an empty table, give none.
    """
    rows = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i"), F.col(f"`{score}`").alias("_s")).where("_g is not null and _i is not null and _s is not null")
    if df.schema[score].dataType.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan("_s"))
    once = rows if unique else rows.groupBy("_g", "_i").agg(F.max("_s").alias("_s"))
    order = [F.col("_s").desc(), F.col("_i").asc()]
    salted = once.withColumn("_salt", F.pmod(F.xxhash64("_i"), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_salt").orderBy(*order))).where(F.col("_r") <= n)
    last = first.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("_r") <= n)
    return last.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias(score), F.col("_r").alias("rank"))
