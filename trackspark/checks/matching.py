"""Track-particle matching, rates, seeds, sweeps, comparisons and Pareto fronts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as k
from ..operators import pareto as p
from ..session import scratch_path
from ..sources import scans
from .registry import check
from .views import view

view("env", "flat")("SELECT * FROM flat WHERE layer_id <> 1 OR truth_l0 > 1")

_TOTAL = "SELECT event_id, pid, count(DISTINCT (volume_id, layer_id, module_id)) AS total_hits FROM (SELECT * FROM flat UNION ALL SELECT * FROM env) u WHERE pid <> 0 GROUP BY 1, 2"


def _match(source: str) -> str:
    return f"""
    SELECT event_id, track_nr, pid AS majority_pid, n AS majority_count, t AS n_meas, total_hits, n * 1e0 / t AS purity, n * 1e0 / total_hits AS completeness,
           CASE WHEN n * 1e0 / t < 5e-1 THEN 'low_purity' WHEN n * 1e0 / total_hits < 5e-1 THEN 'low_completeness' ELSE 'matched' END AS category
    FROM (SELECT event_id, track_nr, pid, count(*) AS n, sum(count(*)) OVER (PARTITION BY event_id, track_nr) AS t,
                 row_number() OVER (PARTITION BY event_id, track_nr ORDER BY count(*) DESC, pid) AS rn FROM {source} WHERE pid <> 0 GROUP BY 1, 2, 3) a
    JOIN ({_TOTAL}) x USING (event_id, pid) WHERE rn = 1"""


def _matched(x, source):
    return k.match_tracks(source, k.module_totals(x.flat, x.env))


@check(
    "track_matching",
    "event_id track_nr majority_pid:l majority_count:l n_meas:l total_hits:l purity:d completeness:d category",
    _match("flat"),
    "flat env",
)
def _(x):
    return _matched(x, x.flat)


@check(
    "track_matching_summary",
    "n_tracks:l n_matched:l n_low_purity:l n_low_completeness:l mean_purity:d mean_completeness:d n_particles:l",
    f"""SELECT (SELECT count(DISTINCT (event_id, track_nr)) FROM flat) AS n_tracks, count(CASE WHEN category = 'matched' THEN 1 END) AS n_matched,
               count(CASE WHEN category = 'low_purity' THEN 1 END) AS n_low_purity, count(CASE WHEN category = 'low_completeness' THEN 1 END) AS n_low_completeness,
               avg(purity) AS mean_purity, avg(completeness) AS mean_completeness,
               count(DISTINCT CASE WHEN category = 'matched' THEN event_id * 1000 + majority_pid END) AS n_particles FROM ({_match('flat')}) m""",
    "flat env",
)
def _(x):
    return k.match_summary(_matched(x, x.flat), x.flat)


@check(
    "matched_particles_compared",
    "n_left:l n_right:l n_shared:l n_left_only:l n_right_only:l recovery:d",
    f"""SELECT count(a) AS n_left, count(b) AS n_right, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n_shared,
               count(CASE WHEN b IS NULL THEN 1 END) AS n_left_only, count(CASE WHEN a IS NULL THEN 1 END) AS n_right_only,
               coalesce(count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) * 1e0 / nullif(count(a), 0), 0) AS recovery
        FROM (SELECT DISTINCT event_id, majority_pid, 1 AS a FROM ({_match('flat')}) l WHERE category = 'matched') l
        FULL JOIN (SELECT DISTINCT event_id, majority_pid, 1 AS b FROM ({_match('env')}) r WHERE category = 'matched') r USING (event_id, majority_pid)""",
    "flat env",
)
def _(x):
    return k.compare_matched(_matched(x, x.flat), _matched(x, x.env))


_CONV = """
  full_ AS (SELECT * FROM (SELECT event_id, track_nr, pid AS fp, count(*) AS fn, sum(count(*)) OVER (PARTITION BY event_id, track_nr) AS n_meas,
              row_number() OVER (PARTITION BY event_id, track_nr ORDER BY count(*) DESC, pid) AS rn FROM flat WHERE pid <> 0 GROUP BY 1, 2, 3) a WHERE rn = 1),
  seed_ AS (SELECT * FROM (SELECT event_id, track_nr, pid AS sp, count(*) AS sn, row_number() OVER (PARTITION BY event_id, track_nr ORDER BY count(*) DESC, pid) AS rn
            FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_nr ORDER BY state_idx) AS i FROM flat WHERE pid <> 0) h WHERE i <= 3 GROUP BY 1, 2, 3) a WHERE rn = 1),
  conv AS (
    SELECT f.event_id, f.track_nr, sp, fp, sp <> fp AS converted, fn * 1e0 / n_meas AS purity, own * 1e0 / total AS completeness,
           CASE sn WHEN 3 THEN '3/3 (pure seed)' WHEN 2 THEN '2/3 (one outlier)' ELSE '1/3 (no majority)' END AS seed_category,
           fn * 1e0 / n_meas >= 5e-1 AND own * 1e0 / total >= 5e-1 AS dm
    FROM full_ f JOIN seed_ s USING (event_id, track_nr)
    JOIN (SELECT event_id, track_nr, pid, count(DISTINCT (volume_id, layer_id, module_id)) AS own FROM flat GROUP BY 1, 2, 3) o
      ON o.event_id = f.event_id AND o.track_nr = f.track_nr AND o.pid = fp
    JOIN (SELECT event_id, pid, count(DISTINCT (volume_id, layer_id, module_id)) AS total FROM flat WHERE pid <> 0 GROUP BY 1, 2) t
      ON t.event_id = f.event_id AND t.pid = fp
    WHERE n_meas >= 3)"""


@check(
    "seed_conversion",
    "event_id track_nr seed_maj_pid:l full_maj_pid:l converted:b purity:d completeness:d seed_category dm_matched:b",
    f"""SELECT * FROM (WITH {_CONV} SELECT event_id, track_nr, sp AS seed_maj_pid, fp AS full_maj_pid, converted, purity, completeness, seed_category,
        dm AS dm_matched FROM conv) z""",
    "flat",
)
def _(x):
    return k.seed_conversion(x.flat)


@check(
    "conversion_by_seed_category",
    "seed_category n_tracks:l n_converted:l n_pure:l n_converted_pure:l n_matched:l n_converted_matched:l n_matched_survived:l n_converted_survived:l",
    f"""SELECT * FROM (WITH {_CONV} SELECT seed_category, count(*) AS n_tracks, count(CASE WHEN converted THEN 1 END) AS n_converted,
          count(CASE WHEN purity >= 5e-1 THEN 1 END) AS n_pure, count(CASE WHEN converted AND purity >= 5e-1 THEN 1 END) AS n_converted_pure,
          count(CASE WHEN dm THEN 1 END) AS n_matched, count(CASE WHEN dm AND converted THEN 1 END) AS n_converted_matched,
          count(CASE WHEN dm AND o_orderkey IS NOT NULL THEN 1 END) AS n_matched_survived,
          count(CASE WHEN dm AND converted AND o_orderkey IS NOT NULL THEN 1 END) AS n_converted_survived
        FROM conv LEFT JOIN orders ON o_orderkey = track_nr AND o_orderstatus = 'F' GROUP BY seed_category) z""",
    "flat",
)
def _(x):
    kept = x.table("orders").where("o_orderstatus = 'F'")
    survivors = kept.select((F.col("o_orderkey") % 5).alias("event_id"), F.col("o_orderkey").alias("track_nr"))
    return k.conversion_table(k.seed_conversion(x.flat), survivors)


@check(
    "truth_window_failure_by_volume",
    "volume_id window_n:d total:l outside:l rate:d",
    """SELECT volume_id, w AS window_n, count(*) AS total, count(CASE WHEN o THEN 1 END) AS outside, count(CASE WHEN o THEN 1 END) * 1e0 / count(*) AS rate
       FROM (SELECT f.volume_id, w, abs(truth_l0 - pred_l0) > w * sqrt(S00) OR abs(truth_l1 - pred_l1) > w * sqrt(S11) AS o
             FROM flat f JOIN (SELECT event_id, track_nr, pid, row_number() OVER (PARTITION BY event_id, track_nr ORDER BY count(*) DESC, pid) AS rn
                               FROM flat WHERE pid <> 0 GROUP BY 1, 2, 3) m USING (event_id, track_nr, pid), (VALUES (1e0), (3e0), (1e1)) v(w)
             WHERE rn = 1) a GROUP BY 1, 2""",
    "flat",
)
def _(x):
    return k.truth_window_failure(x.flat, [1.0, 3.0, 10.0], by=["volume_id"])


_PT = "particles p LEFT JOIN (SELECT DISTINCT event_id, majority_pid AS particle_id, 1 AS m FROM tracks WHERE track_class IN (1, 2)) t USING (event_id, particle_id)"


@check("matched_flag_from_tracks", "event_id particle_id pt:d matched:b", f"SELECT event_id, particle_id, pt, m IS NOT NULL AS matched FROM {_PT}", "particles tracks")
def _(x):
    return k.matched_from_tracks(x.particles, x.tracks)


@check(
    "rates_by_pt_cut",
    "pt_cut:d n_particles:l efficiency:d fakerate:d",
    f"""SELECT cut AS pt_cut, (SELECT count(*) FROM particles WHERE pt >= cut) AS n_particles,
               (SELECT count(m) * 1e2 / nullif(count(*), 0) FROM {_PT} WHERE pt >= cut) AS efficiency,
               (SELECT 1e2 * (1 - count(CASE WHEN track_class IN (1, 2) AND coalesce(pt, track_pt) >= cut THEN 1 END) * 1e0 / count(*))
                FROM tracks k LEFT JOIN (SELECT event_id, particle_id AS majority_pid, pt FROM particles) p USING (event_id, majority_pid)) AS fakerate
        FROM (VALUES (5e-1), (1e0), (2e0), (3e0)) c(cut)""",
    "particles tracks",
)
def _(x):
    return k.rates_by_cut(k.matched_from_tracks(x.particles, x.tracks), x.tracks, [0.5, 1.0, 2.0, 3.0])


_QUAL = """SELECT k.event_id, track_nr, n_majority_hits * 1e0 / (n_measurements + n_outliers) AS purity, n_majority_hits * 1e0 / n_hits AS completeness
           FROM tracks k JOIN particles p ON p.event_id = k.event_id AND p.particle_id = k.majority_pid WHERE track_class IN (1, 2) AND pt >= 1"""


@check("track_quality", "event_id track_nr purity:d completeness:d", _QUAL, "tracks particles")
def _(x):
    return k.track_quality(x.particles, x.tracks)


@check(
    "track_quality_summary",
    "n_events:l n_tracks:l mean_purity_tracks:d mean_completeness_tracks:d mean_purity_events:d sem_purity_events:d mean_completeness_events:d sem_completeness_events:d",
    f"""SELECT count(*) AS n_events, sum(n) AS n_tracks, sum(sp) / sum(n) AS mean_purity_tracks, sum(sc) / sum(n) AS mean_completeness_tracks,
               avg(sp / n) AS mean_purity_events, stddev_samp(sp / n) / sqrt(count(*)) AS sem_purity_events,
               avg(sc / n) AS mean_completeness_events, stddev_samp(sc / n) / sqrt(count(*)) AS sem_completeness_events
        FROM (SELECT event_id, count(*) AS n, sum(purity) AS sp, sum(completeness) AS sc FROM ({_QUAL}) q GROUP BY 1) e""",
    "tracks particles",
)
def _(x):
    return k.quality_summary(k.track_quality(x.particles, x.tracks))


@check(
    "mean_and_spread",
    "n_meas:l purity_mean:d completeness_mean:d purity_std:d completeness_std:d",
    f"""SELECT round(purity * 10) AS n_meas, avg(purity) AS purity_mean, avg(completeness) AS completeness_mean,
               coalesce(stddev_samp(purity), 0) AS purity_std, coalesce(stddev_samp(completeness), 0) AS completeness_std FROM ({_QUAL}) q GROUP BY 1""",
    "tracks particles",
)
def _(x):
    q = k.track_quality(x.particles, x.tracks).withColumn("n_meas", F.round(F.col("purity") * 10))
    return k.mean_and_spread(q, ["purity", "completeness"], by=["n_meas"])


# --- seeds -------------------------------------------------------------------------------------------

_KEY = 'event_id, round(bX, 3) AS bX, round("bY", 3) AS "bY", bZ, mX, mY, mZ, tX, tY, tZ'
_FILT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, mX, mY, mZ ORDER BY quality DESC, seed_id) AS rn FROM seeds WHERE pT >= 1) f WHERE rn <= 40"""


@check("filtered_seeds", "event_id seed_id", _FILT, "seeds")
def _(x):
    return k.filter_seeds(x.seeds, 1.0, 40)


_REC = f"""
  SELECT event_id, count(t) AS n_tight, count(e) AS n_envelope, count(f) AS n_filtered, count(CASE WHEN t = 1 AND e = 1 THEN 1 END) AS n_tight_in_envelope,
         count(CASE WHEN t = 1 AND f = 1 THEN 1 END) AS n_recovered
  FROM (SELECT DISTINCT {_KEY}, 1 AS t FROM seeds WHERE o_orderpriority < '3') a
  FULL JOIN (SELECT DISTINCT {_KEY}, 1 AS e FROM seeds) b USING (event_id, bX, "bY", bZ, mX, mY, mZ, tX, tY, tZ)
  LEFT JOIN (SELECT DISTINCT {_KEY}, 1 AS f FROM ({_FILT}) f) c USING (event_id, bX, "bY", bZ, mX, mY, mZ, tX, tY, tZ) GROUP BY event_id"""


def _recovery(x):
    return k.seed_recovery(x.seeds.where("o_orderpriority < '3'"), x.seeds, 1.0, 40)


@check(
    "seed_recovery",
    "event_id n_tight:l n_envelope:l n_filtered:l n_tight_in_envelope:l n_recovered:l frac_in_envelope:d frac_recovered:d passed:b",
    f"""SELECT *, n_tight_in_envelope * 1e0 / n_tight AS frac_in_envelope, n_recovered * 1e0 / n_tight AS frac_recovered,
               n_recovered * 1e0 / n_tight >= 98e-2 AS passed FROM ({_REC}) r""",
    "seeds",
)
def _(x):
    return _recovery(x)


@check(
    "seed_recovery_verdict",
    "n_events:l n_passed:l mean_recovered:d passed:b",
    f"""SELECT count(*) AS n_events, count(CASE WHEN r >= 98e-2 THEN 1 END) AS n_passed, avg(r) AS mean_recovered, avg(r) >= 98e-2 AS passed
        FROM (SELECT n_recovered * 1e0 / n_tight AS r FROM ({_REC}) q) v""",
    "seeds",
)
def _(x):
    return k.recovery_verdict(_recovery(x))


# --- sweeps and comparisons ------------------------------------------------------------------------------


@check(
    "metric_comparison",
    "metric left_value:d right_value:d delta:d",
    """SELECT metric, l AS left_value, r AS right_value, r - l AS delta
       FROM (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1e5 AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
       FULL JOIN (SELECT o_orderpriority AS metric, avg(o_totalprice) / 1e5 AS r FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) b USING (metric)""",
)
def _(x):
    o = x.table("orders")
    value = (F.avg("o_totalprice") / 1e5).alias("value")
    left = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("metric")).agg(value)
    right = o.where("o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("metric")).agg(value)
    return k.compare_metrics(left, right)


view("timing")(
    """
    SELECT l_suppkey AS run_id, l_partkey % 7 AS gate_inference_calls, CAST(NULL AS BIGINT) AS value_inference_calls, l_quantity AS gate_inference_ns,
           l_discount AS gate_feature_ns, l_tax AS value_inference_ns, l_quantity / 2e0 AS meas_selection_ns
    FROM {t:lineitem}
    """
)


@check(
    "sweep_rows",
    "run_id efficiency:d fake_rate:d gate_calls:l value_calls:l gate_time_frac:d value_time_frac:d runtime_per_event_s:d",
    """SELECT run_id, round(efficiency * 100, 4) AS efficiency, round(fake_rate * 100, 4) AS fake_rate, coalesce(g, 0) AS gate_calls, 0 AS value_calls,
              gi / (gi + gf + vi + ms) AS gate_time_frac, vi / (gi + gf + vi + ms) AS value_time_frac, wall_seconds / n AS runtime_per_event_s
       FROM points LEFT JOIN (SELECT run_id, sum(gate_inference_calls) AS g, sum(gate_inference_ns) AS gi, sum(gate_feature_ns) AS gf, sum(value_inference_ns) AS vi,
                                     sum(meas_selection_ns) AS ms, count(*) AS n FROM timing GROUP BY 1) t USING (run_id)""",
    "points timing",
)
def _(x):
    runs = x.points.withColumns({"duplicate_rate": F.lit(None).cast("double"), "events": F.lit(None).cast("long")})
    return k.sweep_rows(runs, x.timing)


@check(
    "sweep_rows_from_event_times",
    "run_id efficiency:d fake_rate:d gate_calls:l value_calls:l gate_time_frac:d value_time_frac:d runtime_per_event_s:d",
    """SELECT run_id, round(efficiency * 100, 4) AS efficiency, round(fake_rate * 100, 4) AS fake_rate, coalesce(g, 0) AS gate_calls, 0 AS value_calls,
              gi / (gi + gf + vi + ms) AS gate_time_frac, vi / (gi + gf + vi + ms) AS value_time_frac, wall_seconds / n AS runtime_per_event_s
       FROM points LEFT JOIN (SELECT run_id, sum(gate_inference_calls) AS g, sum(gate_inference_ns) AS gi, sum(gate_feature_ns) AS gf, sum(value_inference_ns) AS vi,
                                     sum(meas_selection_ns) AS ms, count(*) AS n FROM timing GROUP BY 1) t USING (run_id)""",
    "points timing",
)
def _(x):
    # A file per run, as runs leave them; value_inference_calls is written as text that is no number.
    path = scratch_path(x.spark, "event-times")
    event = F.monotonically_increasing_id().alias("event")
    t = x.timing.select("run_id", event, "gate_inference_calls", F.lit("n/a").alias("value_inference_calls"), "gate_inference_ns", "gate_feature_ns", "value_inference_ns", "meas_selection_ns")
    # Each task commits its own files: the driver would move them one by one.
    files = t.withColumnRenamed("run_id", "run").repartition("run").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files.partitionBy("run").option("header", True).csv(path)
    # The folder, not a pattern, so that the executors list it.
    times = scans.read_event_times(x.spark, path, r"run=(\d+)/[^/]*$").withColumn("run_id", F.col("run_id").cast("long"))
    runs = x.points.withColumns({"duplicate_rate": F.lit(None).cast("double"), "events": F.lit(None).cast("long")})
    return k.sweep_rows(runs, times)


@check(
    "selection_join_diagnosis",
    "n_cand_states:l n_accepted_states:l n_overlap:l same_sign_within_0_01:d same_sign_within_0_1:d opposite_sign_within_0_01:d opposite_sign_within_0_1:d",
    """SELECT (SELECT count(DISTINCT (event_id, seed_id, volume_id)) FROM cand) AS n_cand_states,
              (SELECT count(DISTINCT (event_id, seed_id, volume_id)) FROM cand WHERE is_ckf_selected) AS n_accepted_states,
              (SELECT count(DISTINCT (event_id, seed_id, volume_id)) FROM cand WHERE is_ckf_selected) AS n_overlap,
              avg(CASE WHEN m <= 1e-2 THEN 1e0 ELSE 0e0 END) AS same_sign_within_0_01, avg(CASE WHEN m <= 1e-1 THEN 1e0 ELSE 0e0 END) AS same_sign_within_0_1,
              avg(CASE WHEN p <= 1e-2 THEN 1e0 ELSE 0e0 END) AS opposite_sign_within_0_01, avg(CASE WHEN p <= 1e-1 THEN 1e0 ELSE 0e0 END) AS opposite_sign_within_0_1
       FROM (SELECT event_id, seed_id, volume_id, min(abs(c.residual_l0 - a.r)) AS m, min(abs(c.residual_l0 + a.r)) AS p
             FROM cand c JOIN (SELECT event_id, seed_id, volume_id, residual_l0 * 101e-2 + 3e-3 AS r FROM cand WHERE is_ckf_selected) a USING (event_id, seed_id, volume_id)
             WHERE c.residual_l0 IS NOT NULL GROUP BY 1, 2, 3) d""",
    "cand",
)
def _(x):
    acc = x.cand.where("is_ckf_selected").select(
        "event_id", "seed_id", "volume_id", (F.col("residual_l0") * 1.01 + 3e-3).alias("res_l0")
    )
    d = k.join_diagnosis(x.cand, acc, ("event_id", "seed_id", "volume_id"), (1e-2, 1e-1))
    return d.toDF(*[c.replace(".", "_") for c in d.columns])


@check(
    "key_overlap",
    "n_left:l n_right:l n_shared:l n_left_only:l n_right_only:l left_fraction:d right_fraction:d",
    """SELECT count(a) AS n_left, count(b) AS n_right, count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS n_shared, count(CASE WHEN b IS NULL THEN 1 END) AS n_left_only,
              count(CASE WHEN a IS NULL THEN 1 END) AS n_right_only, count(CASE WHEN a = 1 AND b = 1 THEN 1 END) * 1e0 / count(a) AS left_fraction,
              count(CASE WHEN a = 1 AND b = 1 THEN 1 END) * 1e0 / count(b) AS right_fraction
       FROM (SELECT DISTINCT event_id, track_nr, 1 AS a FROM flat WHERE pid <> 0) l
       FULL JOIN (SELECT DISTINCT event_id, track_nr, 1 AS b FROM flat WHERE volume_id = 0) r USING (event_id, track_nr)""",
    "flat",
)
def _(x):
    return k.key_overlap(x.flat.where("pid <> 0"), x.flat.where("volume_id = 0"), ["event_id", "track_nr"])


@check(
    "cleanest_track",
    "event_id track_nr",
    f"""SELECT event_id, track_nr FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY purity DESC, completeness DESC, n_meas DESC, track_nr) AS rn
        FROM ({_match('flat')}) m) r WHERE rn = 1""",
    "flat env",
)
def _(x):
    return k.cleanest_track(_matched(x, x.flat))


# --- Pareto --------------------------------------------------------------------------------------------------

_DOM2 = "o.efficiency >= p.efficiency AND o.fake_rate <= p.fake_rate AND (o.efficiency > p.efficiency OR o.fake_rate < p.fake_rate)"
_DOM3 = (
    "o.efficiency >= p.efficiency AND o.fake_rate <= p.fake_rate AND o.wall_seconds <= p.wall_seconds AND "
    "(o.efficiency > p.efficiency OR o.fake_rate < p.fake_rate OR o.wall_seconds < p.wall_seconds)"
)
_OBJ2 = [("efficiency", "max"), ("fake_rate", "min")]
_OBJ3 = [*_OBJ2, ("wall_seconds", "min")]
_F2 = f"SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE {_DOM2})"


@check("pareto_front_2d", "run_id", _F2, "points")
def _(x):
    return p.pareto_front(x.points, _OBJ2)


@check("pareto_front_3d", "run_id", f"SELECT run_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE {_DOM3})", "points")
def _(x):
    return p.pareto_front(x.points, _OBJ3)


@check(
    "pareto_front_parts",
    "p_partkey",
    """SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice <= p.p_retailprice
         AND (o.p_size > p.p_size OR o.p_retailprice < p.p_retailprice))""",
)
def _(x):
    return p.pareto_front(x.table("part"), [("p_size", "max"), ("p_retailprice", "min")])


@check(
    "operating_point_choice",
    "rule run_id",
    f"""SELECT 'lowest_fake' AS rule, arg_min(run_id, fake_rate) AS run_id FROM ({_F2}) f WHERE efficiency >= 95e-2
        UNION ALL SELECT 'highest_efficiency', arg_max(run_id, efficiency) FROM ({_F2}) f WHERE fake_rate < 4e-2""",
    "points",
)
def _(x):
    front = p.pareto_front(x.points, _OBJ2)
    a = p.pick_point(front, ("fake_rate", "min"), F.col("efficiency") >= 0.95, tie="run_id")
    b = p.pick_point(front, ("efficiency", "max"), F.col("fake_rate") < 0.04, tie="run_id")
    return a.select(F.lit("lowest_fake").alias("rule"), "run_id").unionByName(
        b.select(F.lit("highest_efficiency").alias("rule"), "run_id")
    )


@check("terciles", "run_id tercile:l", "SELECT run_id, ntile(3) OVER (ORDER BY wall_seconds, run_id) AS tercile FROM points", "points")
def _(x):
    return p.tercile(x.points, "wall_seconds", "run_id")
