import os

import pytest

from tests.oracle import connect, plan_of, same
from wardline.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    same(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() >= 0


def test_leaks_and_spans_of_the_tables_against_brute_force(spark):
    from tests.llm.test_leakage import brute as leaks
    from tests.llm.test_spans import brute as spans

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/eval_items.parquet").collect()]
    assert {tuple(r) for r in queries.p8_found(spark, FOLDER).collect()} == leaks(docs, items)
    assert {tuple(r) for r in queries.p10_found(spark, FOLDER).collect()} == spans(docs)[0]


def test_splits_keep_their_proportions(spark):
    got = {r["split"]: r["n"] for r in queries.p1_sizes(spark, FOLDER).collect()}
    total = spark.read.parquet(f"{FOLDER}/ct_observations.parquet").count()
    assert sum(got.values()) == total
    assert all(abs(got[k] / total - v) < 0.05 for k, v in queries.PROPORTIONS.items())


def test_texts_are_one_pass(spark):
    df = queries.p8_found(spark, FOLDER)
    assert plan_of(df).count("Exchange") == 1 and plan_of(df).count("MapInArrow") == 1
    assert "WindowGroupLimit" in plan_of(queries.p6_found(spark, FOLDER))


def test_shares_are_reported(spark):
    rows = queries.p9_shares(spark, FOLDER).collect()
    assert abs(sum(r["reached_share"] for r in rows) - 1) < 1e-9
    assert all(r["most_copies"] <= r["max_repeats"] and (r["drawn_tokens"] > 0) == (r["repeats"] > 0) for r in rows if r["tokens"])
    free = [r for r in rows if r["repeats"] and not r["clamped"]]
    assert len({round(r["repeats"] * r["tokens"] / r["target_share"], 3) for r in free}) <= 1


def test_every_observation_has_its_known_attributes(spark, con):
    rows = [tuple(r) for r in queries.p7_known(spark, FOLDER).select("observation_id", "registrar", "whois_created", "asn_digits", "whois_known", "geo_known").collect()]
    every = [i for (i,) in con.sql("select id from ct_observations").fetchall()]
    assert sorted(r[0] for r in rows) == sorted(every)
    joined = {r[0]: r for r in con.sql(f"select observation_id, registrar, whois_created, asn_digits, whois_known, geo_known from ({queries.ORACLES['p7_known']})").fetchall()}
    assert {r[0]: r for r in rows} == joined and len(joined) == len(every)
    undated = {i for (i,) in con.sql("select id from ct_observations where event_ts is null or registered_domain is null").fetchall()}
    assert undated and {r[1:] for r in rows if r[0] in undated} == {(None, None, None, False, False)}
