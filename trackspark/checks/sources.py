"""Scans and sinks: tables written from the given data and read back through the readers."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as feat
from ..functions.strata import label_columns
from ..session import scratch_path
from ..sources import manifest, scans, schema, sinks
from .registry import check
from .sqltext import MEMBER, STATE
from .views import view

KEYS = STATE.replace(",", "")


FILES = 3
#: Lines of a file, about, where the place of a line in its file means nothing. A file is written and sorted by one task.
LINES = 1 << 20


def _csv_by_event(df, x, kind: str, comment: bool = False, without: str | None = None, whole: tuple[int, ...] = ()) -> str:
    """Write ``FILES`` sorts of files per event, dealt by the first column, as text lines with a header.

    The name of a file carries the event, its lines are sorted by the first column, and
    each sort has its columns in another order. ``without`` is left out of the last. A sort of more than ``LINES``
    lines becomes several files, but for those in ``whole``, whose lines are known by their place.
    """
    path = scratch_path(x.spark, kind)
    cols = [c for c in df.columns if c != "event_id"]
    key = F.col(cols[0]).cast("long")
    orders = [cols[i % len(cols) :] + cols[: i % len(cols)] for i in range(FILES)]
    orders[-1] = [c for c in orders[-1] if c != without]
    file = F.pmod(F.coalesce(key, F.lit(0)), F.lit(FILES))

    def of_file(make):
        out = make(orders[0])
        for i in range(1, FILES):
            out = F.when(F.col("n") == i, make(orders[i])).otherwise(out)
        return out

    line = of_file(lambda names: F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]))
    event = F.col("event_id").cast("long")
    name = F.format_string(f"event%09d-{kind}-%d-%d", event, F.col("n"), F.col("part"))
    body = df.withColumn("n", file).select(event.alias("e"), "n", F.lit(1).alias("o"), key.alias("k"), line.alias("value"))
    parts = body.groupBy("e", "n").agg(F.ceil(F.count(F.lit(1)) / LINES).alias("parts"))
    split = F.when(~F.col("n").isin(list(whole)), F.pmod(F.xxhash64("k", "value"), F.col("parts"))).otherwise(0)
    parts = parts.withColumnsRenamed({"e": "event_id", "n": "sort"})
    body = body.join(F.broadcast(parts), F.col("e").eqNullSafe(F.col("event_id")) & (F.col("n") == F.col("sort"))).withColumn("part", split)
    body = body.select(name.alias("f"), "n", "o", "k", "value")
    files = body.select("f", "n").distinct()
    none = F.lit(None).cast("long")
    lines = body.drop("n").union(files.select("f", F.lit(0), none, of_file(lambda names: F.lit(", ".join(names)))))
    if comment:
        lines = lines.union(files.select("f", F.lit(-1), none, F.lit("# written by a test")))
    lines.repartition("f").sortWithinPartitions("f", "o", "k").select("f", "value").write.partitionBy("f").text(path)
    return f"{path}/*"


@check(
    "candidate_scan",
    "event_id branch_id n:l chi2:d n_nan:l",
    "SELECT event_id, branch_id, count(*) AS n, sum(chi2_inc) AS chi2, 0 AS n_nan FROM cand GROUP BY 1, 2",
    "cand",
)
def _(x):
    path = scratch_path(x.spark, "candidates")
    nan = F.coalesce("chi2_inc", F.lit(float("nan"))).alias("chi2_inc")
    x.cand.select("event_id", "branch_id", nan, "cand_hit_id", "S00").write.partitionBy("event_id").parquet(path)
    d = scans.scan_table(x.spark, path, ["event_id", "branch_id", "chi2_inc"])
    return d.groupBy(F.col("event_id").cast("long").alias("event_id"), "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chi2_inc").alias("chi2"), F.count(F.when(F.isnan("chi2_inc"), 1)).alias("n_nan")
    )


@check(
    "branch_point_read",
    "event_id seed_id step_k cand_hit_id",
    """SELECT event_id, seed_id, step_k, cand_hit_id FROM cand WHERE (event_id, seed_id) IN (
         SELECT (event_id, seed_id) FROM (SELECT event_id, seed_id, row_number() OVER (ORDER BY count(*) DESC, event_id, seed_id) AS rn FROM cand GROUP BY 1, 2) a
         WHERE rn = 1)""",
    "cand",
)
def _(x):
    path = scratch_path(x.spark, "sorted")
    rows = x.cand.select("event_id", "seed_id", "branch_id", "step_k", "cand_hit_id", "chi2_inc")
    sinks.write_candidates(rows, path, "h")
    n = rows.groupBy("event_id", "seed_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.col("n").desc(), "event_id", "seed_id").first()
    return scans.read_branch(x.spark.read.parquet(path), {"event_id": top.event_id, "seed_id": top.seed_id})


@check(
    "measurement_scan",
    "event_id measurement_id geometry_id:l local0:d var_local1:d",
    """SELECT event_id, geometry_id << 36 AS geometry_id, local0, var_local1,
              CASE WHEN measurement_id % 3 = 2 THEN row_number() OVER (PARTITION BY event_id, measurement_id % 3 ORDER BY measurement_id) - 1
                   ELSE measurement_id END AS measurement_id FROM meas""",
    "meas",
)
def _(x):
    d = x.meas.select(
        "event_id",
        "measurement_id",
        (F.shiftleft("geometry_id", 36) + F.col("measurement_id") % 200).alias("geometry_id"),
        "local0",
        "local1",
        "var_local0",
        "var_local1",
    )
    return scans.read_measurements(x.spark, _csv_by_event(d, x, "measurements", comment=True, without="measurement_id", whole=(FILES - 1,)))


@check(
    "cell_scan",
    "event_id measurement_id n:l value:d",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS event_id, l_partkey AS measurement_id, count(*) AS n, sum(l_quantity) AS value
       FROM lineitem GROUP BY 1, 2""",
)
def _(x):
    li = x.table("lineitem")
    d = li.select(
        F.year("l_shipdate").alias("event_id"),
        F.col("l_partkey").alias("measurement_id"),
        F.lit(512).alias("geometry_id"),
        (F.col("l_orderkey") % 9).alias("channel0"),
        F.col("l_linenumber").alias("channel1"),
        F.col("l_quantity").alias("value"),
    )
    c = scans.read_cells(x.spark, _csv_by_event(d, x, "cells"))
    return c.groupBy("event_id", "measurement_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@check(
    "simhit_scan_file_positions",
    "event_id hit_id particle_id:l tpx tt",
    """SELECT event_id, row_number() OVER (PARTITION BY event_id, hit_id % 3 ORDER BY hit_id) - 1 AS hit_id, (particle_id << 48) | 1 AS particle_id, tpx, tt FROM simhits""",
    "simhits",
)
def _(x):
    d = x.simhits.select(
        "event_id",
        F.col("hit_id").alias("serial"),
        F.col("particle_id").alias("particle_id_pv"),
        F.lit(1).alias("particle_id_subpart"),
        "geometry_id",
        "tpx",
        "tpy",
        "tt",
    )
    return scans.read_simhits(x.spark, _csv_by_event(d, x, "simhits", comment=True, whole=tuple(range(FILES))))


@check(
    "hit_map_scan",
    "event_id measurement_id n:l",
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_custkey AS measurement_id, count(*) AS n FROM orders GROUP BY 1, 2",
)
def _(x):
    d = x.table("orders").select(
        F.year("o_orderdate").alias("event_id"), F.col("o_custkey").alias("measurement_id"), F.col("o_orderkey").alias("hit_id")
    )
    m = scans.read_hit_map(x.spark, _csv_by_event(d, x, "measurement-simhit-map"))
    return m.groupBy("event_id", "measurement_id").agg(F.count("hit_id").alias("n"))


view("ranked", "states")(
    """
    SELECT *, row_number() OVER (PARTITION BY event_id, track_nr ORDER BY state_idx) - 1 AS pos,
           count(*) OVER (PARTITION BY event_id, track_nr) AS n_states FROM states
    """
)


@check(
    "predicted_covariance_scan",
    "event_id track_nr state_idx:l P00:d",
    """SELECT event_id, track_nr, n_states - 1 - pos AS state_idx, pred_l0 AS P00 FROM ranked WHERE track_nr % 50 <> 0""",
    "ranked",
)
def _(x):
    d = x.ranked.select(
        "event_id",
        "track_nr",
        F.col("pos").alias("step_k"),
        F.col("pred_l0").alias("P00"),
        F.lit(0.0).alias("P01"),
        F.lit(1.0).alias("P11"),
    )
    known = x.ranked.where("track_nr % 50 <> 0")
    return scans.read_predicted_covariance(x.spark, _csv_by_event(d, x, "predicted-cov"), known)[0]


def _jagged(x, values, order="pos"):
    """Per-track arrays, outermost state first."""
    item = F.struct(F.col(order), *values)
    g = x.ranked.groupBy("event_id", "track_nr").agg(F.sort_array(F.collect_list(item), asc=False).alias("_a"))
    names = [c for c in ("pred_l0", "geometry_id", "sel_l0") if c in [v for v in values]]
    return g.select("event_id", "track_nr", *[F.col(f"_a.{n}").alias(n) for n in names])


@check(
    "flat_states_from_arrays",
    "event_id track_nr state_idx:l pred_l0:d geometry_id:l extra:b",
    "SELECT event_id, track_nr, pos AS state_idx, pred_l0, geometry_id, NULL AS extra FROM ranked",
    "ranked",
)
def _(x):
    path = scratch_path(x.spark, "tracks")
    _jagged(x, ["pred_l0", "geometry_id"]).write.json(path)
    tracks = x.spark.read.schema("event_id long, track_nr long, pred_l0 array<double>, geometry_id array<long>").json(path)
    return scans.flat_states(tracks, ["pred_l0", "geometry_id", "extra"])


@check(
    "aligned_measurement_arrays",
    "event_id track_nr state_idx:l sel_l0:d",
    "SELECT event_id, track_nr, pos AS state_idx, sel_l0 FROM ranked WHERE sel_l0 IS NOT NULL",
    "ranked",
)
def _(x):
    t = _jagged(x, ["pred_l0", "sel_l0"])
    t = t.select(
        "event_id",
        "track_nr",
        F.transform("sel_l0", lambda v: v.isNotNull()).alias("mask"),
        F.filter("sel_l0", lambda v: v.isNotNull()).alias("sel_l0"),
    )
    return scans.aligned_measurements(t, "mask", ["sel_l0"])


@check(
    "sensor_table_from_json",
    "volume_id:l pitch_u:d pitch_v:d thickness:d",
    """SELECT s_nationkey AS volume_id, 2e0 / count(*) AS pitch_u, CASE WHEN s_nationkey % 2 = 0 THEN 1e0 / count(*) END AS pitch_v,
              15e-2 AS thickness FROM supplier GROUP BY s_nationkey""",
)
def _(x):
    rows = x.table("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    axis = lambda w: F.struct(F.col("n").cast("int").alias("bins"), F.lit(0.0).alias("min"), F.lit(w).alias("max"))
    bins = F.when(F.col("s_nationkey") % 2 == 0, F.array(axis(2.0), axis(1.0))).otherwise(F.array(axis(2.0)))
    geo = F.struct(F.lit(0.15).alias("thickness"), F.struct(bins.alias("binningdata")).alias("segmentation"))
    entry = F.struct(F.col("s_nationkey").alias("volume"), F.struct(geo.alias("geometric")).alias("value"))
    # One entry per volume: the configuration is small by nature.
    text = rows.agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    path = scratch_path(x.spark, "sensors")
    text.coalesce(1).write.text(path)
    return scans.read_sensors(x.spark, path)


@check(
    "seed_scan_with_alias",
    "event_id seed_id pT mX",
    "SELECT event_id, seed_id, pT, mX FROM seeds",
    "seeds",
)
def _(x):
    d = x.seeds.drop("o_orderpriority").withColumnRenamed("pT", "pt")
    first = ["event_id", "seed_id"]
    return scans.read_seeds(x.spark, _csv_by_event(d.select(*first, *[c for c in d.columns if c not in first]), x, "seeds"))


@check(
    "rollout_and_worklist_scan",
    "event_id rollout_id n_hits:l n_work:l",
    """SELECT event_id, rollout_id, n_hits, n_work FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_custkey AS rollout_id, count(*) AS n_hits,
              count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_work FROM orders GROUP BY 1, 2) a WHERE n_work > 0""",
)
def _(x):
    o = x.table("orders").withColumn("event_id", F.year("o_orderdate"))
    hits = o.select("event_id", F.col("o_custkey").alias("rollout_id"), F.col("o_orderkey").alias("step"), F.lit(7).alias("geometry_id"), F.lit(-1).alias("meas_id"))
    work = o.where("o_orderstatus = 'F'").select("event_id", F.col("o_custkey").alias("rollout_id"), F.col("o_orderkey").alias("seed_id"), F.lit(1).alias("step_k"))
    h = scans.read_rollout_hits(x.spark, _csv_by_event(hits, x, "rollout-hits"))
    w = scans.read_worklist(x.spark, _csv_by_event(work, x, "worklist"))
    a = h.groupBy("event_id", "rollout_id").agg(F.count("meas_id").alias("n_hits"))
    b = w.groupBy("event_id", "rollout_id").agg(F.count("seed_id").alias("n_work"))
    return a.join(b, ["event_id", "rollout_id"], "inner")


@check(
    "nested_event_table",
    "event_id particle_id:l pt:d",
    "SELECT event_id, particle_id, pt FROM particles",
    "particles",
)
def _(x):
    z = F.collect_list(F.struct(F.col("particle_id").alias("id"), "pt"))
    nested = x.particles.groupBy("event_id", (F.col("particle_id") % 64).alias("block")).agg(z.alias("p"))
    nested = nested.select("event_id", F.col("p.id").alias("ids"), F.col("p.pt").alias("pts"))
    return scans.flat_table(nested, {"ids": "particle_id", "pts": "pt"})


@check(
    "track_hit_keys",
    "event_id track_nr hit_keys n_hit_keys:l",
    """SELECT event_id, track_nr, string_agg(k, ';' ORDER BY k) AS hit_keys, count(*) AS n_hit_keys FROM (
         SELECT event_id, track_nr, printf('%d:%d:%d:%.4f:%.4f', CAST(volume_id AS BIGINT), CAST(layer_id AS BIGINT), CAST(module_id AS BIGINT), truth_l0, truth_l1) AS k
         FROM flat WHERE pid <> 0) a GROUP BY 1, 2""",
    "flat",
)
def _(x):
    s = x.flat.withColumnsRenamed({"truth_l0": "l_x_hit", "truth_l1": "l_y_hit"})
    return scans.hit_keys(s, F.col("pid") != 0)


_UNPACKED = [("vertex_primary", 48, 0xFFF), ("vertex_secondary", 32, 0xFFFF), ("particle", 16, 0xFFFF), ("generation", 8, 0xFF), ("sub_particle", 0, 0xFF)]


def _parts(pid: str, prefix: str = "") -> list:
    """The barcode parts of a packed id."""
    return [F.expr(f"CAST(shiftright({pid}, {shift}) & {mask} AS BIGINT)").alias(prefix + name) for name, shift, mask in _UNPACKED]


def _event_wise(rows, event: str, names: list[str]):
    """Arrays per event and block, as the writers of nested tables leave them."""
    blocks = rows.withColumn("_block", F.pmod(F.hash(*names), F.lit(8))).groupBy(event, "_block").agg(F.collect_list(F.struct(*names)).alias("_s"))
    return blocks.select(event, *[F.col(f"_s.{n}").alias(n) for n in names])


def _nested_particles(x):
    names = [n for n, _, _ in _UNPACKED]
    return _event_wise(x.particles.select("event_id", *_parts("particle_id"), "pt"), "event_id", [*names, "pt"])


def _nested_tracks(x):
    majority = [f"{scans.MAJORITY_PREFIX}{n}" for n, _, _ in _UNPACKED]
    rows = x.tracks.select(
        F.col("event_id").alias("event_nr"),
        F.col("track_class").alias("trackClassification"),
        F.when(F.col("track_nr") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("track_pt") * 10).alias("t_pT"),
        F.col("n_majority_hits").alias("nMajorityHits"),
        *_parts("majority_pid", scans.MAJORITY_PREFIX),
    )
    return _event_wise(rows, "event_nr", ["trackClassification", "t_pT", "nMajorityHits", *majority])


@check("particle_scan", "event_id particle_id:l pt:d", "SELECT event_id, particle_id, pt FROM particles", "particles")
def _(x):
    path = scratch_path(x.spark, "particles")
    _nested_particles(x).write.parquet(path)
    return scans.particle_table(x.spark.read.parquet(path))


@check(
    "track_summary_scan",
    "event_id track_class:l track_pt:d n_majority:l majority_pid:l",
    """SELECT event_id, track_class, CASE WHEN track_nr % 5 <> 0 THEN track_pt * 10 END AS track_pt, n_majority_hits AS n_majority, majority_pid FROM tracks""",
    "tracks",
)
def _(x):
    path = scratch_path(x.spark, "tracksummary")
    _nested_tracks(x).write.parquet(path)
    return scans.track_summary(x.spark.read.parquet(path))


_FROM_TRACKS = "(SELECT DISTINCT event_id, majority_pid AS particle_id, true AS m FROM tracks WHERE track_class IN (1, 2)) t USING (event_id, particle_id)"


@check(
    "matching_without_details",
    "event_id particle_id:l matched:b origin",
    f"SELECT event_id, particle_id, coalesce(m, false) AS matched, 'tracks' AS origin FROM particles LEFT JOIN {_FROM_TRACKS}",
    "particles tracks",
)
def _(x):
    details = scans.read_optional(x.spark, scratch_path(x.spark, "absent"))
    return scans.matching_flags(scans.particle_table(_nested_particles(x)), details, scans.track_summary(_nested_tracks(x)))


@check(
    "matching_with_details",
    "event_id particle_id:l matched:b origin",
    "SELECT event_id, particle_id, particle_id % 7 <> 0 AND particle_id % 3 = 1 AS matched, 'details' AS origin FROM particles",
    "particles tracks",
)
def _(x):
    path = scratch_path(x.spark, "matchingdetails")
    listed = x.particles.where("particle_id % 7 <> 0")
    rows = listed.select(F.col("event_id").alias("event_nr"), *_parts("particle_id", scans.MATCH_PREFIX), (F.col("particle_id") % 3 == 1).cast("int").alias("matched"))
    rows.write.parquet(path)
    details = scans.read_optional(x.spark, path)
    return scans.matching_flags(scans.particle_table(_nested_particles(x)), details, scans.track_summary(_nested_tracks(x)))


# --- logs, timings, sweeps ----------------------------------------------------------------------------

view("logs")(
    """
    SELECT c_custkey AS run, concat('Efficiency with tracks (x) = 0.', CAST(c_custkey % 9 AS VARCHAR(9)), ' Fake ratio with particles (y) = 0.',
           CAST(c_custkey % 7 AS VARCHAR(9)), ' Efficiency with tracks (x) = 0.5 Duplicate ratio with tracks (z) = 0.25 Efficiency with tracks (x) = 0.75 ',
           'Fake ratio with tracks (q) = 0.125', CASE WHEN c_custkey % 3 = 0 THEN ' Processed 4 events in 2.5 s total seeds: 17' ELSE '' END) AS text
    FROM {t:customer}
    """
)


@check(
    "log_metric_lines",
    "run name value:d",
    """SELECT c_custkey AS run, name, value FROM customer, (VALUES ('ckf_efficiency_tracks', 1), ('ckf_fake_ratio_particles', 2), ('ckf_efficiency_tracks', 3),
         ('ckf_finding_duplicate_ratio_tracks', 4), ('ckf_finding_efficiency_tracks', 5), ('ambi_fake_ratio_tracks', 6)) v(name, i),
         LATERAL (SELECT CASE i WHEN 1 THEN (c_custkey % 9) / 1e1 WHEN 2 THEN (c_custkey % 7) / 1e1 WHEN 3 THEN 5e-1 WHEN 4 THEN 25e-2 WHEN 5 THEN 75e-2 ELSE 125e-3 END AS value) w""",
    "logs",
)
def _(x):
    return scans.metric_lines(x.logs, "run", "text")


@check(
    "log_totals",
    "run n_events:d total_time_s:d total_seeds:d found_tracks:d time_per_event_ms:d",
    """SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN 4e0 END AS n_events, CASE WHEN c_custkey % 3 = 0 THEN 25e-1 END AS total_time_s,
              CASE WHEN c_custkey % 3 = 0 THEN 17e0 END AS total_seeds, NULL AS found_tracks, CASE WHEN c_custkey % 3 = 0 THEN 625e0 END AS time_per_event_ms FROM customer""",
)
def _(x):
    return scans.log_totals(x.logs, "run", "text")


@check(
    "document_numbers_by_pattern",
    "source lang n:l with_digit:l total:l",
    r"""SELECT source, lang, count(*) AS n, count(CASE WHEN regexp_matches(text, '[0-9]+') THEN 1 END) AS with_digit,
              sum(len(regexp_extract_all(text, '[0-9]+'))) AS total FROM documents GROUP BY 1, 2""",
)
def _(x):
    found = F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1))
    return x.table("documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(found) > 0, 1)).alias("with_digit"), F.sum(F.size(found)).alias("total")
    )


@check(
    "stage_times",
    "name time_s:d",
    "SELECT p_type AS name, sum(p_retailprice) AS time_s FROM part GROUP BY 1",
)
def _(x):
    path = scratch_path(x.spark, "timing")
    d = x.table("part").select(
        F.concat(F.lit("Algorithm:"), F.col("p_type")).alias("identifier"), F.col("p_retailprice").alias("time_total_s"), F.lit("").alias("time_perevent_s")
    )
    d.write.option("header", True).option("sep", "\t").csv(path)
    return scans.read_stage_times(x.spark, f"{path}/*.csv")


@check(
    "stage_time_sum",
    "stage_time_s:d",
    "SELECT sum(p_retailprice) AS stage_time_s FROM part WHERE p_type IN ('ECONOMY', 'PROMO')",
)
def _(x):
    raw = x.table("part").select(F.col("p_type").alias("identifier"), F.col("p_retailprice").alias("time_s"))
    return scans.stage_sum(scans.stage_times(raw), ["ECONOMY", "PROMO"])


@check(
    "sweep_points",
    "run tau_g:d tau_v:d efficiency:d",
    """SELECT s_suppkey AS run, (s_suppkey % 10) / 1e1 AS tau_g, (s_nationkey % 4) / 1e1 AS tau_v, CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END AS efficiency FROM supplier""",
)
def _(x):
    s = x.table("supplier").select(
        F.col("s_suppkey").alias("run"),
        F.format_string("sweep_g0p%d_v0p%d", F.col("s_suppkey") % 10, F.col("s_nationkey") % 4).alias("name"),
        F.when(F.col("s_suppkey") % 5 != 0, F.round("s_acctbal", 2).cast("string")).otherwise(F.lit("failed")).alias("efficiency"),
    )
    pattern = r"sweep_g([0-9p.]+)_v([0-9p.]+)"
    d = scans.sweep_points(s, ["efficiency"])
    return d.withColumns({"tau_g": scans.point_of_name("name", pattern, 1), "tau_v": scans.point_of_name("name", pattern, 2)})


# --- manifests and splits ----------------------------------------------------------------------------------

view("requested")("SELECT DISTINCT o_custkey AS event_id FROM {t:orders}")
view("explicit")("SELECT c_custkey AS event_id, concat('dir', CAST(c_nationkey AS VARCHAR(9))) AS path FROM {t:customer} WHERE c_custkey % 2 = 0")
view("indexed")("SELECT c_custkey AS event_id, concat('idx', CAST(c_custkey % 500 AS VARCHAR(9))) AS path FROM {t:customer} WHERE c_custkey % 3 <> 0")
_RES = """SELECT r.event_id, coalesce(e.path, i.path) AS path, CASE WHEN e.path IS NOT NULL THEN 'explicit' WHEN i.path IS NOT NULL THEN 'index' END AS origin
          FROM requested r LEFT JOIN explicit e USING (event_id) LEFT JOIN indexed i USING (event_id)"""


@check("event_sources", "event_id path origin", _RES, "requested explicit indexed")
def _(x):
    return manifest.resolve_sources(x.requested, x.explicit, x.indexed)


@check(
    "event_source_problems",
    "event_id problem",
    f"""SELECT event_id, 'missing' AS problem FROM ({_RES}) r WHERE path IS NULL
        UNION SELECT event_id, 'reused' FROM ({_RES}) r WHERE path IN (SELECT path FROM ({_RES}) q GROUP BY path
          HAVING count(DISTINCT event_id) > 1 AND count(CASE WHEN origin = 'index' THEN 1 END) > 0)""",
    "requested explicit indexed",
)
def _(x):
    return manifest.source_problems(manifest.resolve_sources(x.requested, x.explicit, x.indexed))


@check(
    "split_assignment",
    "split n:l",
    """SELECT CASE WHEN event_id % 8 = 4 THEN 'val' WHEN event_id % 8 = 7 THEN 'cal' WHEN event_id % 8 = 0 THEN NULL ELSE 'train' END AS split, count(*) AS n
       FROM cand GROUP BY 1""",
    "cand",
)
def _(x):
    e = x.cand.select("event_id").distinct().where("event_id % 8 <> 0")
    split = F.when(F.col("event_id") % 8 == 4, "val").when(F.col("event_id") % 8 == 7, "cal").otherwise("train")
    return manifest.assign_splits(x.cand, e.withColumn("split", split)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@check(
    "table_health",
    "event_id expected_rows:l n_rows:l is_present:b rows_match:b",
    """SELECT event_id, e AS expected_rows, n AS n_rows, true AS is_present, e = n AS rows_match
       FROM (SELECT event_id, count(*) AS n, count(*) + CASE WHEN event_id = 1996 THEN 1 ELSE 0 END AS e FROM cand GROUP BY 1) a""",
    "cand",
)
def _(x):
    path = scratch_path(x.spark, "health")
    x.cand.select("event_id", "cand_hit_id").write.partitionBy("event_id").parquet(path)
    want = x.cand.groupBy("event_id").agg((F.count(F.lit(1)) + F.when(F.col("event_id") == 1996, 1).otherwise(0)).alias("expected_rows"))
    files = manifest.with_file(x.spark.read.parquet(path)).withColumn("event_id", F.col("event_id").cast("long"))
    return manifest.table_health(files, want)


# --- sinks ---------------------------------------------------------------------------------------------------


@check(
    "candidate_sink_round_trip",
    f"{KEYS} cand_hit_id chi2_inc:d n_contrib:l parent_branch_id:l prune_reason:l env_config_hash",
    f"""SELECT {STATE}, cand_hit_id, chi2_inc, coalesce(len(contrib_pids), -1) AS n_contrib, -1 AS parent_branch_id, -1 AS prune_reason,
               'abc' AS env_config_hash FROM cand""",
    "cand",
)
def _(x):
    path = scratch_path(x.spark, "expanded")
    rows = x.cand.drop("seed_id").withColumnsRenamed({"branch_id": "track_nr", "step_k": "state_idx"})
    sinks.write_candidates(rows, path, "abc")
    d = x.spark.read.schema(schema.candidate_schema()).parquet(path)
    return d.withColumn("n_contrib", F.coalesce(F.size("contrib_pids"), F.lit(-1)))


@check(
    "gate_feature_sink_meta",
    "n_rows:l n_pos:l n_sources:l n_features:l is_partial:b",
    f"""SELECT count(*) AS n_rows, count(CASE WHEN {MEMBER} THEN 1 END) AS n_pos, count(DISTINCT event_id) AS n_sources, 26 AS n_features, false AS is_partial
        FROM cand WHERE NOT majority_undefined AND cand_hit_id <> -1""",
    "cand",
)
def _(x):
    lab = label_columns()
    rows = x.cand.where(lab["gate_row_mask"]).withColumn("label", lab["label_same_particle"])
    path = scratch_path(x.spark, "gate")
    sinks.write_features(feat.gate_features(rows, ("event_id", "label")), path, feat.GATE_FEATURES, "label")
    _, meta = sinks.read_features(x.spark, path)
    return meta.withColumn("n_features", F.size("feature_names"))


@check(
    "windowed_feature_tables",
    "window_nsigma:d n:l target:d",
    "SELECT w AS window_nsigma, count(*) AS n, avg(vstar_soft) * w AS target FROM cand, (VALUES (3e0), (7e0)) v(w) GROUP BY w",
    "cand",
)
def _(x):
    part = lambda w: x.cand.select("event_id", "seed_id", (F.col("vstar_soft") * w).alias("target"))
    path = scratch_path(x.spark, "value")
    both = sinks.concat_windows({3.0: part(3.0), 7.0: part(7.0)})
    sinks.write_features(both, path, ["target"], "target", partition=["window_nsigma"])
    d = x.spark.read.parquet(f"{path}/rows")
    return d.groupBy("window_nsigma").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("target"))


@check(
    "restrict_to_branches",
    "event_id branch_id n:l",
    f"""SELECT event_id, branch_id, count(*) AS n FROM cand WHERE (event_id, branch_id) IN (
          SELECT (event_id, branch_id) FROM (SELECT *, row_number() OVER (PARTITION BY event_id, branch_id ORDER BY step_k, cand_hit_id) AS rn
            FROM cand WHERE is_ckf_selected AND NOT majority_undefined) h WHERE rn <= 3
          GROUP BY event_id, branch_id HAVING count(CASE WHEN {MEMBER} THEN 1 END) >= 3) GROUP BY 1, 2""",
    "cand",
)
def _(x):
    from ..operators.failure import BRANCH, seed_purity

    pure = seed_purity(x.cand.where("NOT majority_undefined")).where("seed_purity = 'pure'").select(*BRANCH)
    return x.cand.join(pure, list(BRANCH), "left_semi").groupBy("event_id", "branch_id").agg(F.count(F.lit(1)).alias("n"))


@check(
    "back_fill",
    "l_orderkey l_linenumber l_partkey size:l",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN 1000 ELSE p_size END AS size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10",
)
def _(x):
    li = x.table("lineitem").withColumn("size", F.when(F.col("l_quantity") > 25, 1000))
    parts = x.table("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"))
    return sinks.back_fill(li, parts, ["l_partkey"], ["size"])[0]


@check(
    "back_fill_report",
    "n_rows:l size_before:l size_after:l",
    """SELECT count(*) AS n_rows, count(CASE WHEN l_quantity > 25 THEN 1 END) AS size_before, count(CASE WHEN l_quantity > 25 OR p_size IS NOT NULL THEN 1 END) AS size_after
       FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10""",
)
def _(x):
    li = x.table("lineitem").withColumn("size", F.when(F.col("l_quantity") > 25, 1000))
    parts = x.table("part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size"))
    return sinks.back_fill(li, parts, ["l_partkey"], ["size"])[1]


@check(
    "config_hash_per_part",
    "p_partkey hash",
    """SELECT p_partkey, substr(sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}'), 1, 16) AS hash FROM part""",
)
def _(x):
    return x.table("part").select("p_partkey", sinks.config_hash_column(["p_size", "p_brand"]).alias("hash"))


@check(
    "decision_log_violations",
    "event_id seed_id step_k cand_hit_id rule",
    """SELECT event_id, seed_id, step_k, cand_hit_id, 'foreign_hash' AS rule FROM cand WHERE seed_id % 10 = 0
       UNION ALL SELECT event_id, seed_id, step_k, cand_hit_id, 'missing_prune_reason' FROM cand WHERE seed_id % 7 = 0 AND seed_id % 2 = 0
       UNION ALL SELECT event_id, seed_id, step_k, cand_hit_id, 'length_residual' FROM cand WHERE is_1d""",
    "cand",
)
def _(x):
    d = x.cand.select(
        "event_id",
        "seed_id",
        "step_k",
        "cand_hit_id",
        F.when(F.col("is_1d"), F.array("residual_l0")).otherwise(F.array("residual_l0", "residual_l1")).alias("residual"),
        F.when(F.col("seed_id") % 7 == 0, schema.ACTIONS["branch_pruned"]).otherwise(0).alias("action_taken"),
        F.when(F.col("seed_id") % 2 == 0, 0).otherwise(1).alias("prune_reason"),
        F.when(F.col("seed_id") % 10 == 0, "other").otherwise("abc").alias("env_config_hash"),
    )
    return schema.decision_violations(d, "abc")


@check(
    "decision_log_sink",
    "event_id seed_id branch_id step_k:l cand_hit_id layer_id:l action_taken:l residual_l0:d pred_l1:d chi2_inc:d n_contrib:l contrib_first:l hash n_fields:l n_wrong:l",
    """SELECT event_id, seed_id, branch_id, step_k, cand_hit_id, layer_id, CASE WHEN cand_hit_id = -1 THEN 2 WHEN is_ckf_selected THEN 0 ELSE 1 END AS action_taken,
              CAST(residual_l0 AS REAL) AS residual_l0, CAST(pred_l1 AS REAL) AS pred_l1, CAST(chi2_inc AS REAL) AS chi2_inc,
              coalesce(len(contrib_pids), -1) AS n_contrib, contrib_pids[1] AS contrib_first, 'abc' AS hash, 28 AS n_fields, 0 AS n_wrong FROM cand""",
    "cand",
)
def _(x):
    path = scratch_path(x.spark, "decisions")
    action = F.when(F.col("cand_hit_id") == -1, "hole").when(F.col("is_ckf_selected"), "accepted").otherwise("rejected")
    code = F.coalesce(*[F.when(action == name, F.lit(n)) for name, n in schema.ACTIONS.items()])
    have = {c: F.col(c) for c in x.cand.columns} | {
        "action_taken": code,
        "env_config_hash": F.lit("abc"),
        "residual": F.array("residual_l0", "residual_l1"),
        "pred_local": F.array("pred_l0", "pred_l1"),
    }
    cols = []
    for f in schema.decision_log_schema():
        n = schema.VECTOR_LENGTHS.get(f.name)
        blank = F.array_repeat(F.lit(0.0), n) if n else F.lit(None)
        cols.append(have.get(f.name, blank).cast(f.dataType).alias(f.name))
    x.cand.select(*cols).write.parquet(path)
    d = x.spark.read.parquet(path)
    schema.assert_decision_schema(d)
    keys = ["event_id", "seed_id", "branch_id", "step_k", "cand_hit_id"]
    wrong = schema.decision_violations(d, "abc").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_wrong"))
    return d.join(wrong, keys, "left").select(
        *keys,
        "layer_id",
        "action_taken",
        F.col("residual")[0].alias("residual_l0"),
        F.col("pred_local")[1].alias("pred_l1"),
        "chi2_inc",
        F.coalesce(F.size("contrib_pids"), F.lit(-1)).alias("n_contrib"),
        F.get("contrib_pids", F.lit(0)).alias("contrib_first"),
        F.col("env_config_hash").alias("hash"),
        F.lit(len(d.columns)).alias("n_fields"),
        F.coalesce("n_wrong", F.lit(0)).alias("n_wrong"),
    )


