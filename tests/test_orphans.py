from pyspark.sql import functions as F

from wardline.operators import orphans


def test_kinds(spark):
    parents = spark.createDataFrame([(1, 10), (2, 50), (3, None), (4, 10), (4, 5), (None, 1)], "id long, born long")
    gone = spark.createDataFrame([(7, 30), (7, 40), (4, 99), (8, None), (None, 3)], "id long, died long")
    known = orphans.parent_intervals(F.col("id"), F.col("born"), parents, F.col("id"), F.col("died"), gone)
    refs = spark.createDataFrame(
        [(1, 1, 20, "x"), (2, 2, 20, "x"), (3, 3, 0, "x"), (4, 4, 7, "x"), (5, 7, 20, "x"), (6, 8, 20, "x"), (7, 9, 20, "x"), (8, None, 20, "x"), (9, 2, None, "x"), (9, 9, 20, "x"), (10, 4, 1, "x")],
        "row_id long, key long, at long, kind string",
    ).withColumns({"_key": F.lit(0), "valid_from": F.lit(0), "ref": F.lit("r")})
    got = sorted((r["row_id"], r["kind"]) for r in orphans.orphans(refs, known).collect())
    assert got == [(2, "late"), (5, "deleted"), (6, "deleted"), (7, "missing"), (9, "missing"), (10, "late")]


def test_empty_tables(spark):
    parents = spark.createDataFrame([], "id long, born long")
    known = orphans.parent_intervals(F.col("id"), F.col("born"), parents)
    refs = spark.createDataFrame([(1, 5, 0)], "row_id long, key long, at long")
    assert [r["kind"] for r in orphans.orphans(refs, known).collect()] == ["missing"]
    assert orphans.orphans(refs.where("false"), known).count() == 0


def test_hot_key_is_merged_not_multiplied(spark):
    parents = spark.range(1, 4).select("id", F.lit(100).cast("long").alias("born"))
    known = orphans.parent_intervals(F.col("id"), F.col("born"), parents)
    refs = spark.range(30_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000 + 2).cast("long").alias("key"), F.lit(50).cast("long").alias("at"))
    got = orphans.orphans(refs, known)
    assert got.count() == 30_000 and got.where("kind = 'late'").count() == refs.where("key <= 3").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
