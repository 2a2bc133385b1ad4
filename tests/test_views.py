"""Views as Spark derives and stores them: the common text's rows, merged by hashing, with fewer columns written."""

import datetime
import itertools

from trackspark.checks import views

DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _odd_lines(spark, path):
    """Missing and negative keys, quantities at the limit, flags around R and equal lines, on three suppliers."""
    day = datetime.datetime(1996, 9, 13)
    parts = itertools.product((3, 4, None), (7, 46, -5, None), (15.0, 15.5, None), ("R", "A", "S", None), (day, None))
    rows = [(i, p, s, 1 + i % 3, q, 10.0 * (i % 4), 0.01 * (i % 5), None if i % 7 == 0 else 0.02, f, "O", d) for i, (s, p, q, f, d) in enumerate(parts)]
    rows += [(900 + i, 50, 5, 1, 40.0, 1.0, 0.0, 0.0, "R", "O", day) for i in range(4)]  # a state of lines that are no candidates
    rows += [(910 + i, p, 6, 1, 9.0, 2.0, 0.0, 0.0, f, "O", day) for i, (p, f) in enumerate([(None, "R"), (None, "S"), (-5, "A"), (-5, "R")])]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")


def test_candidates_equal_the_common_text_on_odd_lines(spark, tmp_path):
    _odd_lines(spark, tmp_path)
    text = views.with_clause(["cand"], lambda t: f"parquet.`{tmp_path}/{t}.parquet`", "array")
    want = spark.sql(f"{text} SELECT * FROM cand")
    got = views.Inputs(spark, str(tmp_path)).cand
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    # repr: rows hold nulls, and equal candidates of a state without numbers may be ranked either way
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where("cand_hit_id IS NULL").count() and got.where("cand_hit_id = -1").count()


def test_candidate_lines_merge_by_hashing_and_computed_columns_are_not_written(spark):
    inputs = views.Inputs(spark, DIR)
    plan = _plan(inputs._derive("cand"))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    inputs.cand  # noqa: B018
    path = views._STORED[spark.sparkContext.applicationId, DIR, "cand"][0]
    written = set(spark.read.parquet(path).columns)
    assert "cand_hit_id" in written and not {"seed_id", "state_theta", "clus_s_u", "pitch_u"} & written
    assert {"seed_id", "state_theta", "clus_s_u", "pitch_u"} < set(inputs.cand.columns)


def test_rollout_views_take_one_shuffle_and_plain_columns_are_not_stored(spark):
    from trackspark import checks

    checks.load()
    inputs = views.Inputs(spark, DIR)
    inputs.cand  # noqa: B018
    assert _plan(inputs._derive("classes")).count("Exchange hashpartitioning(") == 1
    inputs.rollout_hits, inputs.totals  # noqa: B018
    app = spark.sparkContext.applicationId
    assert not {(app, DIR, n) for n in ("rollout_hits", "simhits")} & set(views._STORED)
