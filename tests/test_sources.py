"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from trackspark.session import scratch_path
from trackspark.sources import manifest, scans, schema, sinks


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_measurements_with_comment_and_ring_byte(spark, tmp_path, rows):
    gid = (16 << 56) | (2 << 36) | (5 << 8) | 7
    p = _write(tmp_path / "event000000003-measurements.csv", f"# comment\nmeasurement_id, geometry_id, local0, local1, var_local0, var_local1\n4, {gid}, 0.5, 0.25, 0.1, nan\n")
    r = scans.read_measurements(spark, p).first()
    assert (r.event_id, r.measurement_id, r.geometry_id, r.local0, r.var_local1) == (3, 4, gid - 7, 0.5, None)


def test_measurement_ids_default_to_file_position(spark, tmp_path, rows):
    p = _write(tmp_path / "event000000001-measurements.csv", "geometry_id,local0,local1\n512,1.5,2.5\n768,3.5,4.5\n")
    assert rows(scans.read_measurements(spark, p), "measurement_id", "geometry_id", "local0") == [(0, 512, 1.5), (1, 768, 3.5)]


def test_simhit_positions_across_splits(spark, tmp_path):
    lines = ["particle_id_pv,particle_id_subpart,geometry_id,tpx,tpy,tt"] + [f"{i % 9},{i},{256 * i},{i}.5,0,{i}" for i in range(5000)]
    _write(tmp_path / "event000000002-simhits.csv", "\n".join(lines) + "\n")
    _write(tmp_path / "event000000004-simhits.csv", "# note\n" + "\n".join(lines[:100]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = scans.read_simhits(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for ev, n in ((2, 5000), (4, 99)):
        mine = sorted((r.hit_id, r.geometry_id, r.particle_id, r.tpx) for r in got if r.event_id == ev)
        assert mine == [(i, 256 * i, ((i % 9) << 48) | i, i + 0.5) for i in range(n)]


def test_sensor_table(spark, tmp_path, rows):
    axis = {"bins": 10, "min": -1.0, "max": 1.0}
    doc = {"entries": [
        {"volume": 16, "value": {"geometric": {"thickness": 0.1, "segmentation": {"binningdata": [axis, axis]}}}},
        {"volume": 28, "value": {"geometric": {"thickness": 0.2, "segmentation": {"binningdata": [axis]}}}},
        {"volume": 99, "value": {"smearing": []}},
    ]}
    p = _write(tmp_path / "digi.json", json.dumps(doc, indent=1))
    assert rows(scans.read_sensors(spark, p), "volume_id", "pitch_u", "pitch_v", "thickness") == [(16, 0.2, 0.2, 0.1), (28, 0.2, None, 0.2)]


def test_jagged_states_are_reversed_and_empty_tracks_vanish(spark, rows):
    df = spark.createDataFrame([(0, 1, [30, 20, 10]), (0, 2, [])], "event_id long, track_nr long, volume_id array<int>")
    got = rows(scans.flat_states(df, ["volume_id", "res"]), "track_nr", "state_idx", "volume_id", "res")
    assert got == [(1, 0, 10, None), (1, 1, 20, None), (1, 2, 30, None)]


def test_masked_arrays_land_on_their_states(spark, rows):
    df = spark.createDataFrame([(0, 1, [True, False, True], [9.0, 7.0])], "event_id long, track_nr long, m array<boolean>, r array<double>")
    assert rows(scans.aligned_measurements(df, "m", ["r"]), "state_idx", "r") == [(0, 7.0), (2, 9.0)]


def test_predicted_covariance_drops_foreign_rows(spark):
    raw = spark.createDataFrame([(0, 1, 0, 1.0, 0.0, 1.0), (0, 1, 5, 1.0, 0.0, 1.0), (0, 9, 0, 1.0, 0.0, 1.0)], "event_id long, track_nr long, step_k long, P00 double, P01 double, P11 double")
    st = spark.createDataFrame([(0, 1, i) for i in range(3)], "event_id long, track_nr long, state_idx long")
    kept, rep = scans.reverse_covariance(raw, st)
    assert [r.state_idx for r in kept.collect()] == [2]
    assert rep.first().n_dropped == 2


def test_candidate_sink_fills_and_orders(spark):
    df = spark.createDataFrame([(1, 5, 0, 7, [3])], "event_id long, track_nr long, state_idx long, cand_hit_id long, contrib_pids array<long>")
    path = scratch_path(spark, "t")
    sinks.write_candidates(df, path, "abc")
    r = spark.read.schema(schema.candidate_schema()).parquet(path).first()
    assert (r.seed_id, r.branch_id, r.step_k, r.cand_hit_id, r.n_hits, r.majority_undefined, r.vstar_soft) == (5, 5, 0, 7, -1, True, None)
    assert len(schema.CANDIDATE_COLUMNS) == 82 and len(schema.candidate_schema(older=True)) == 76


def test_missing_columns_are_refused(spark):
    with pytest.raises(schema.MissingColumns):
        schema.require_columns(spark.range(1), ["id", "nope"])
    with pytest.raises(ValueError):
        schema.same_schema({"a": spark.range(1), "b": spark.range(1).withColumn("id", F.col("id").cast("int"))})


def test_feature_table_round_trip(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.25, 0)], "event_id long, f double, label int")
    path = scratch_path(spark, "f")
    sinks.write_features(df, path, ["f"], "label", is_partial=True)
    rows_, meta = sinks.read_features(spark, path)
    m = meta.first()
    assert (rows_.count(), m.n_rows, m.n_pos, m.n_sources, m.is_partial) == (2, 2, 1, 2, True)


def test_config_hash_ignores_unlisted_settings():
    a = sinks.config_hash({"window_n": 10, "other": 1})
    assert a == sinks.config_hash({"window_n": 10, "other": 2}) != sinks.config_hash({"window_n": 9})
    assert len(a) == 16


def test_decision_rules(spark):
    with pytest.raises(ValueError):
        schema.check_forbidden_cut({"ckf_loc0_max": 4.0})
    schema.check_forbidden_cut({"ckf_loc0_max": 4.0, "forbid_loc0_cut": False})
    with pytest.raises(schema.MissingColumns):
        schema.assert_decision_schema(spark.range(1))


def test_event_requests(spark):
    splits = spark.createDataFrame([(2, "train"), (1, "val"), (40, manifest.SEALED)], "event_id long, split string")

    def ids(request):
        return sorted(r.event_id for r in manifest.open_events(splits, request).collect())

    assert ids("") == [1, 2] and ids("2, 1,2") == [1, 2]
    for bad in ("1,x", "1,,2", "9", "40"):
        with pytest.raises(ValueError):
            ids(bad)
    with pytest.raises(ValueError, match="'x': not a number; '40': sealed; '9': unknown"):
        ids("9, x, 40, 1")


def test_sealed_and_ambiguous_events_are_refused(spark):
    rows_ = spark.createDataFrame([(1, "train"), (40, "test")], "event_id long, split string")
    manifest.require_open(rows_.where("event_id = 1"))
    with pytest.raises(ValueError):
        manifest.require_open(rows_)
    req = spark.createDataFrame([(1,), (2,)], "event_id long")
    none = spark.createDataFrame([], "event_id long, path string")
    two = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event_id long, path string")
    with pytest.raises(ValueError):
        manifest.require_sources(manifest.resolve_sources(req, none, two))
    one = spark.createDataFrame([(1, "a"), (2, "a")], "event_id long, path string")
    with pytest.raises(ValueError):
        manifest.require_sources(manifest.resolve_sources(req, none, one))
    manifest.require_sources(manifest.resolve_sources(req, one, None))


def test_stage_of_metric_lines(spark, rows):
    text = "Efficiency with tracks (a/b) = 0.5\nFake ratio with tracks (a/b) = 0.1\nEfficiency with tracks (c) = 0.6\nEfficiency with tracks (d) = 0.7\n"
    df = spark.createDataFrame([("r", text)], "run string, text string")
    got = [r.name for r in scans.metric_lines(df, "run", "text").orderBy("pos").collect()]
    assert got == ["ckf_efficiency_tracks", "ckf_fake_ratio_tracks", "ckf_efficiency_tracks", "ckf_finding_efficiency_tracks"]


def test_files_with_their_own_headers(spark, tmp_path, rows):
    g = [i << 36 for i in range(11)]
    (tmp_path / "event000000001-a.csv").write_text(f"# note\nmeasurement_id, geometry_id,local0\n5,{g[7]},0.5\n6,{g[8]},1.5\n")
    (tmp_path / "event000000001-b.csv").write_text(f'local0,measurement_id,geometry_id\n2.5,9,{g[10]}\n# late note\n\n"3.5",1,{g[2]}\n')
    (tmp_path / "event000000002-c.csv").write_text(f"geometry_id,var_local0\n{g[3]},0.1\n{g[4]},NaN\n")
    got = rows(scans.read_measurements(spark, str(tmp_path)), "event_id", "measurement_id", "geometry_id", "local0", "var_local0")
    want = [(1, 1, g[2], 3.5, None), (1, 5, g[7], 0.5, None), (1, 6, g[8], 1.5, None), (1, 9, g[10], 2.5, None), (2, 0, g[3], None, 0.1), (2, 1, g[4], None, None)]
    assert got == want
    swapped = tmp_path / "swapped"
    swapped.mkdir()
    (swapped / "event000000001-a.csv").write_text("measurement_id,hit_id\n1,2\n")
    (swapped / "event000000001-b.csv").write_text("hit_id,measurement_id\n2,3\n")
    assert rows(scans.read_hit_map(spark, str(swapped)), "measurement_id", "hit_id") == [(1, 2), (3, 2)]


def test_stream_keeps_events_that_span_batches(spark, tmp_path):
    from trackspark.streaming import incremental

    source = str(tmp_path / "in")
    for part in ([(1, 2)] * 3, [(1, 5)] * 4, [(2, 1), (1, 7)]):
        spark.createDataFrame(part, "event_id long, v long").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema

    def reduce(batch):
        return batch.groupBy("event_id").sum("v").withColumnRenamed("sum(v)", "v")

    path, progress = str(tmp_path / "sums"), str(tmp_path / "progress")
    for _ in range(2):
        incremental.keep_sums(spark, source, schema, reduce, path, progress, 1).awaitTermination()
    got = {r.event_id: r.v for r in incremental.totals(spark, path, ["event_id"]).collect()}
    assert got == {1: 3 * 2 + 4 * 5 + 7, 2: 1}


def test_no_shared_folder_on_a_cluster():
    from trackspark.session import shared_dir

    class Fake:
        def __init__(self, master):
            self.conf = self.sparkContext = self
            self.master = master

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake("local-cluster[3,2,2000]"))


def test_a_line_is_parsed_once_for_all_its_fields(spark, tmp_path):
    (tmp_path / "run=3").mkdir()
    (tmp_path / "run=3" / "times.csv").write_text("event,n_seeds,gate_inference_ns,value_inference_calls\n1,4, 2.5,n/a\n2,,nan,7\n")
    d = scans.read_event_times(spark, str(tmp_path), r"run=(\d+)/[^/]*$")
    got = {(r.run_id, r.event, r.n_seeds, r.gate_inference_ns, r.value_inference_calls) for r in d.collect()}
    assert got == {("3", 1, 4, 2.5, None), ("3", 2, None, None, 7)}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 2  # the header and the line


def test_large_sorts_of_lines_become_several_files(spark, monkeypatch):
    from trackspark.checks import sources
    from trackspark.checks.views import Inputs

    monkeypatch.setattr(sources, "LINES", 50)
    x = Inputs(spark, "/root/testdata/sf0.001")
    d = x.meas.select("event_id", "measurement_id", "geometry_id", "local0", "local1", "var_local0", "var_local1")
    split = spark.read.text(sources._csv_by_event(d, x, "cells")).groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0]
    assert split < 150 and d.groupBy("event_id").count().agg({"count": "max"}).first()[0] > 600
    got = scans.read_measurements(spark, sources._csv_by_event(d, x, "measurements", comment=True, without="measurement_id", whole=(2,)))
    own = d.where("measurement_id % 3 < 2").select("event_id", "measurement_id")
    places = d.where("measurement_id % 3 = 2").selectExpr("event_id", "row_number() OVER (PARTITION BY event_id ORDER BY measurement_id) - 1L AS measurement_id")
    want = sorted(map(tuple, own.unionByName(places).collect()))
    assert sorted(map(tuple, got.select("event_id", "measurement_id").collect())) == want
