"""Registered queries: naming, oracles, and a few end-to-end comparisons."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canonical
from trackspark.checks import views

DIR = "/root/testdata/sf0.001"
#: Iterative fits, models, tokenizers, fingerprints and searches: compared with brute force in the tests.
WITHOUT_SQL = {
    "gate_fit_and_audit", "soft_label_fit", "pipeline", "op2_sharding", "op3_nearest", "op4_toxicity", "op5_packing", "op7_simhash",
    "op9_token_store", "op10_suffix_dedup", "op11_secret_scan", "op13_whitening",
}


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 150 and set(q) - set(o) <= WITHOUT_SQL


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables not present")
def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="tables not present")
@pytest.mark.parametrize("name", ["window_join_state_covariance", "logged_targets", "ranking_metrics", "failure_cube", "pareto_front_3d"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, DIR).toPandas()
    assert canonical(got) == canonical(con.sql(entry.oracle_sql()[name]).df())


def test_candidates_take_one_shuffle_and_store_no_steps(spark):
    inputs = views.Inputs(spark, DIR)
    plan = inputs._derive("cand")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    inputs.cand  # noqa: B018
    app = spark.sparkContext.applicationId
    assert not {(app, DIR, n) for n in ("cand_base", "cand_values")} & set(views._STORED)
