import os

import pytest

from tests.oracle import connect, plan_of, same
from wardline.plans import analytics, campaigns, dealt, flow, names, pipeline, serving

FOLDER = "/root/testdata/sf0.001"
MODULES = (dealt, names, analytics, campaigns, pipeline, serving, flow)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_crc_buckets(spark):
    import zlib

    for r in names.crc_buckets(spark, FOLDER).collect():
        assert r["bucket"] == zlib.crc32(r["host"].encode()) % 10000 and r["sampled"] == (r["bucket"] < 1000)


def test_weights_estimate_all_hosts(spark):
    got = pipeline.weighted_background(spark, FOLDER, 0.5)
    total = got.selectExpr("sum(weight)").first()[0]
    hosts = spark.read.parquet(f"{FOLDER}/stream_ct.parquet").selectExpr("lower(trim(domain)) as h").distinct().count()
    assert 0.7 * hosts < total < 1.3 * hosts and {r["weight"] for r in got.collect()} <= {1.0, 2.0}


def test_questions(spark):
    top = pipeline.ask(spark, FOLDER, "Show me the riskiest domains!").collect()
    assert 0 < len(top) <= 5 and top == sorted(top, key=lambda r: -r["risk_score"])
    assert pipeline.ask(spark, FOLDER, "why is myfiroritifo.qz risky?").count() <= 1
    assert pipeline.ask(spark, FOLDER, "campaigns against hekadopay").count() <= 10
    assert pipeline.ask(spark, FOLDER, "drop table x; --") is None
    assert pipeline.ask(spark, FOLDER, "x" * 600 + " top domains") is None


def scans(df):
    import re

    return {tuple(sorted(x.split(":")[0] for x in m.split(","))) for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(df))}


def test_scans_read_what_they_need(spark):
    assert scans(QUERIES["p3_found"](spark, FOLDER)) == {("registered_domain",), ("target_brand",)}
    assert scans(QUERIES["p4_found"](spark, FOLDER)) == {("domain", "id", "ingest_ts", "kafka_offset")}
    assert ("assignee", "id", "updated_at") in scans(QUERIES["p5_found"](spark, FOLDER))
    assert scans(QUERIES["times"](spark, FOLDER)) == {("event_ts", "kafka_offset", "producer_ts")}


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["latest_threats"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(risk_score), GreaterThan(risk_score,0.85)]" in plan.replace("EqualTo", "")


def test_per_key_work_is_shuffled_once(spark):
    assert plan_of(QUERIES["p3_domains"](spark, FOLDER)).count("Exchange") == 1
    assert plan_of(QUERIES["p4_found"](spark, FOLDER)).count("Exchange") == 1


def test_newest_domains_cuts_no_rows_off(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("id", "concat('d', id % 21000, '.test') as registered_domain", "timestamp_ntz'2026-08-01 00:00:00' + make_dt_interval(0, 0, 0, id) as created_at")
    rows.write.parquet(str(tmp_path / "ct_observations.parquet"))
    got = pipeline.newest_domains(spark, str(tmp_path)).collect()
    assert {(r["domain"], r["id"]) for r in got} == {(f"d{i}.test", i) for i in range(21_000)} and len(got) == 21_000
    since = pipeline.newest_domains(spark, str(tmp_path), "2026-08-01 05:49:59").collect()  # the row of id 20,999
    assert {(r["domain"], r["id"]) for r in since} == {(f"d{i}.test", i + 21_000) for i in range(4000)}
