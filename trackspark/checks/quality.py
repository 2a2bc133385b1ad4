"""Audits, guards and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from .registry import check
from .sqltext import MEMBER, SENSOR
from .views import view

view("origin", "cand")(
    """
    SELECT event_id, seed_id AS track_nr, step_k, CASE WHEN seed_id % 31 = 0 THEN 99 ELSE min(volume_id) END AS volume_id, min(layer_id) AS layer_id,
           CASE WHEN seed_id % 29 = 0 THEN NULL ELSE step_k * 1e1 + CASE WHEN seed_id % 40 = 3 THEN 5e0 ELSE 0e0 END END AS path_length,
           max(CASE WHEN is_ckf_selected THEN 1 ELSE 0 END) = 1 AS has_measurement
    FROM cand WHERE seed_id % 37 <> 5 GROUP BY event_id, seed_id, step_k
    """
)
_ORI = """
  SELECT event_id, count(*) AS n_tracks, avg(CASE WHEN abs(f) < 1e-3 THEN 1e0 ELSE 0e0 END) AS frac_seed_at_zero, avg(CASE WHEN l > f + 1e-6 THEN 1e0 ELSE 0e0 END) AS frac_outer_above,
         coalesce(avg(CASE WHEN n > 1 THEN CASE WHEN s > f + 1e-6 THEN 1e0 ELSE 0e0 END END), 1) AS frac_first_step_up
  FROM (SELECT event_id, track_nr, count(*) AS n, min(path_length) FILTER (WHERE rn = 1) AS f, min(path_length) FILTER (WHERE rn = 2) AS s, arg_max(path_length, step_k) AS l
        FROM (SELECT *, row_number() OVER (PARTITION BY event_id, track_nr ORDER BY step_k) AS rn FROM origin WHERE path_length IS NOT NULL) a GROUP BY 1, 2) b GROUP BY 1"""


@check("propagation_order", "event_id n_tracks:l frac_seed_at_zero:d frac_outer_above:d frac_first_step_up:d", _ORI, "origin")
def _(x):
    return q.orientation(x.origin)


_AGREE = """SELECT count(r.volume_id) AS n_joined, count(CASE WHEN s.v <> r.volume_id OR s.l <> r.layer_id THEN 1 END) AS n_mismatch, count(CASE WHEN r.volume_id IS NULL THEN 1 END) AS n_unjoined
            FROM (SELECT event_id, seed_id, step_k, min(volume_id) AS v, min(layer_id) AS l FROM cand GROUP BY 1, 2, 3) s
            LEFT JOIN origin r ON r.event_id = s.event_id AND r.track_nr = s.seed_id AND r.step_k = s.step_k"""


@check("source_agreement", "n_joined:l n_mismatch:l n_unjoined:l", _AGREE, "cand origin")
def _(x):
    return q.source_agreement(x.cand, x.origin)


@check(
    "hole_fraction_by_event",
    "event_id hole_fraction:d",
    """SELECT event_id, avg(CASE WHEN m < 0 THEN 1e0 ELSE 0e0 END) AS hole_fraction
       FROM (SELECT event_id, seed_id, step_k, max(cand_hit_id) AS m FROM cand GROUP BY 1, 2, 3) s GROUP BY 1""",
    "cand",
)
def _(x):
    return q.hole_fraction(x.cand, by=["event_id"])


@check(
    "candidate_shares_by_event",
    "event_id pixel:d sstrip:d lstrip:d",
    f"""SELECT event_id, {', '.join(f'avg(CASE WHEN {SENSOR} = {i} THEN 1e0 ELSE 0e0 END) AS {n}' for i, n in enumerate(('pixel', 'sstrip', 'lstrip')))}
        FROM cand WHERE cand_hit_id >= 0 GROUP BY 1""",
    "cand",
)
def _(x):
    return q.candidate_shares(x.cand, by=["event_id"])


@check(
    "volume_presence",
    "missing unexpected passive",
    """SELECT string_agg(CASE WHEN n = 0 AND v <> 20 THEN CAST(v AS VARCHAR) END, ',' ORDER BY v) AS missing, '' AS unexpected,
              coalesce(string_agg(CASE WHEN v = 20 AND t = 0 THEN '20' END, ','), '') AS passive
       FROM (SELECT e.v, count(CASE WHEN cand_hit_id >= 0 AND volume_id <> 17 THEN 1 END) AS n, count(volume_id) AS t
             FROM (VALUES (16), (17), (18), (20), (23), (24), (25), (28), (29), (30)) e(v) LEFT JOIN cand ON volume_id = e.v GROUP BY 1) a""",
    "cand",
)
def _(x):
    d = q.volume_presence(x.cand.where("cand_hit_id < 0 OR volume_id <> 17"))
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>"))
    return d.select(
        text("missing_sensitive").alias("missing"), text("unexpected").alias("unexpected"), text("missing_passive").alias("passive")
    )


_HIST = """SELECT count(*) AS n_states, count(CASE WHEN n_hits + n_holes <> pos THEN 1 END) AS n_bad_total, count(CASE WHEN n_hits < prev THEN 1 END) AS n_falling
           FROM (SELECT *, row_number() OVER w - 1 AS pos, lag(n_hits) OVER w AS prev FROM (
                   SELECT event_id, seed_id, step_k, min(n_hits) AS n_hits, min(n_holes) AS n_holes FROM cand GROUP BY 1, 2, 3) s
                 WINDOW w AS (PARTITION BY event_id, seed_id ORDER BY step_k)) a"""


@check("history_consistency", "n_states:l n_bad_total:l n_falling:l", _HIST, "cand")
def _(x):
    return q.history_consistency(
        x.cand.groupBy("event_id", "seed_id", "step_k").agg(F.min("n_hits").alias("n_hits"), F.min("n_holes").alias("n_holes"))
    )


_MAJ = """
  head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, seed_id ORDER BY step_k, cand_hit_id) AS rn FROM cand WHERE is_ckf_selected) a
           WHERE rn <= 3 AND contrib_pids IS NOT NULL),
  prim AS (SELECT event_id, seed_id, step_k, list_aggregate(contrib_pids, 'min') AS p FROM head),
  vote AS (SELECT event_id, seed_id, p, count(*) AS n, sum(count(*)) OVER (PARTITION BY event_id, seed_id) AS t,
                  row_number() OVER (PARTITION BY event_id, seed_id ORDER BY count(*) DESC, p) AS rn FROM prim GROUP BY 1, 2, 3),
  maj AS (SELECT count(*) AS n_branches, avg(CASE WHEN s.m = coalesce(CASE WHEN t >= 3 AND n >= 2 THEN v.p END, -1) THEN 1e0 ELSE 0e0 END) AS agreement
          FROM (SELECT event_id, seed_id, min(branch_majority_pid) AS m FROM cand WHERE NOT majority_undefined GROUP BY 1, 2) s
          LEFT JOIN vote v ON v.rn = 1 AND v.event_id = s.event_id AND v.seed_id = s.seed_id)"""


@check("majority_agreement", "n_branches:l agreement:d", f"SELECT * FROM (WITH {_MAJ} SELECT * FROM maj) z", "cand")
def _(x):
    return q.majority_agreement(x.cand)


_SEL = """SELECT (SELECT count(*) FROM (SELECT event_id, seed_id, step_k FROM cand WHERE is_ckf_selected GROUP BY 1, 2, 3 HAVING count(*) > 1) m) AS n_multiple,
                 count(*) AS n_accepted, avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END) AS joinable
          FROM origin o JOIN (SELECT event_id, seed_id, step_k, count(CASE WHEN is_ckf_selected THEN 1 END) AS n FROM cand GROUP BY 1, 2, 3) c
            ON c.event_id = o.event_id AND c.seed_id = o.track_nr AND c.step_k = o.step_k WHERE has_measurement"""


@check("selected_flag", "n_multiple:l n_accepted:l joinable:d", _SEL, "cand origin")
def _(x):
    return q.selected_flag(x.cand, x.origin)


@check(
    "audit",
    "name passed:b value:d",
    f"""SELECT * FROM (WITH {_MAJ}, agree AS ({_AGREE}), hist AS ({_HIST}), sel AS ({_SEL}), ori AS ({_ORI})
        SELECT 'order' AS name, min(least(frac_seed_at_zero, frac_outer_above, frac_first_step_up)) >= 99e-2 AS passed,
               min(least(frac_seed_at_zero, frac_outer_above, frac_first_step_up)) AS value FROM ori
        UNION ALL SELECT 'source_agreement', n_mismatch = 0 AND n_unjoined = 0, n_mismatch * 1e0 / n_joined FROM agree
        UNION ALL SELECT 'volumes', true, 0e0
        UNION ALL SELECT 'hole_fraction', true, avg(CASE WHEN m < 0 THEN 1e0 ELSE 0e0 END) FROM (SELECT max(cand_hit_id) AS m FROM cand GROUP BY event_id, seed_id, step_k) h
        UNION ALL SELECT 'candidate_shares', true, avg(CASE WHEN {SENSOR} = 0 THEN 1e0 ELSE 0e0 END) FROM cand WHERE cand_hit_id >= 0
        UNION ALL SELECT 'history', n_bad_total = 0 AND n_falling = 0, n_bad_total * 1e0 / n_states FROM hist
        UNION ALL SELECT 'majority_label', agreement >= 98e-2, agreement FROM maj
        UNION ALL SELECT 'selected_flag', n_multiple = 0 AND joinable >= 95e-2, joinable FROM sel
        UNION ALL SELECT 'target_range', true, count(vstar_soft) * 1e0 / count(*) FROM cand) z""",
    "cand origin",
)
def _(x):
    return q.audit(x.cand, x.origin)


@check(
    "purity_sweep",
    "event_id n_rows:l n_cand:l n_trainable:l n_pos:l n_clean:l n_clean_pos:l n_true1d:l n_true1d_pos:l n_corrupt:l n_corrupt_pos:l "
    "n_s00_missing:l n_box_violations:l mean_n_window:d",
    f"""SELECT event_id, count(*) AS n_rows, count(CASE WHEN action_taken = 0 THEN 1 END) AS n_cand, count(CASE WHEN k THEN 1 END) AS n_trainable, count(CASE WHEN k AND y THEN 1 END) AS n_pos,
               count(CASE WHEN k AND S11 IS NOT NULL THEN 1 END) AS n_clean, count(CASE WHEN k AND y AND S11 IS NOT NULL THEN 1 END) AS n_clean_pos,
               count(CASE WHEN k AND volume_id IN (29, 30) THEN 1 END) AS n_true1d, count(CASE WHEN k AND y AND volume_id IN (29, 30) THEN 1 END) AS n_true1d_pos,
               count(CASE WHEN k AND S11 IS NULL AND volume_id NOT IN (29, 30) THEN 1 END) AS n_corrupt, count(CASE WHEN k AND y AND S11 IS NULL AND volume_id NOT IN (29, 30) THEN 1 END) AS n_corrupt_pos,
               count(CASE WHEN k AND S00 IS NULL THEN 1 END) AS n_s00_missing, count(CASE WHEN k AND abs(residual_l1) > 1.5e0 * sqrt(S11) THEN 1 END) AS n_box_violations,
               avg(CASE WHEN k THEN n_window END) AS mean_n_window
        FROM (SELECT *, NOT majority_undefined AND cand_hit_id <> -1 AS k, {MEMBER} AS y FROM cand) a GROUP BY 1""",
    "cand",
)
def _(x):
    return q.purity_sweep(x.cand, one_d_volumes=(29, 30), n=1.5)


@check(
    "corrupt_rows_by_volume",
    "event_id volume_id n_corrupt:l",
    """SELECT event_id, volume_id, count(*) AS n_corrupt FROM cand WHERE NOT majority_undefined AND cand_hit_id <> -1 AND S11 IS NULL AND volume_id NOT IN (29, 30) GROUP BY 1, 2""",
    "cand",
)
def _(x):
    return q.corrupt_by_volume(x.cand, one_d_volumes=(29, 30))


_PCOLS = ["l_quantity", "l_tax", "l_linenumber"]


@check(
    "table_profile",
    "column n_null:l n_finite:l n_nonzero:l min:d max:d mean:d".replace("column ", "col "),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS col, count(*) - count({c}) AS n_null, count({c}) AS n_finite, count(CASE WHEN {c} <> 0 THEN 1 END) AS n_nonzero,
                   min({c}) AS min, max({c}) AS max, avg({c}) AS mean FROM lineitem"""
        for c in _PCOLS
    ),
)
def _(x):
    return q.profile(x.table("lineitem"), _PCOLS).withColumnRenamed("column", "col")


@check(
    "most_frequent_values",
    "p_brand n:l",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8",
)
def _(x):
    return q.top_values(x.table("part"), "p_brand")


@check(
    "cluster_probe",
    "n_measurements:l clus_s_u_mean:d clus_s_v_max:d clus_q_tot_mean:d clus_s_u_frac_gt1:d size_degenerate:b charge_degenerate:b moments_degenerate:b passed:b",
    """SELECT count(*) AS n_measurements, avg(u) AS clus_s_u_mean, max(v) AS clus_s_v_max, avg(t) AS clus_q_tot_mean, avg(CASE WHEN u > 1 THEN 1e0 ELSE 0e0 END) AS clus_s_u_frac_gt1,
              false AS size_degenerate, false AS charge_degenerate, false AS moments_degenerate, true AS passed
       FROM (SELECT l_suppkey, l_partkey, max(l_orderkey % 97) - min(l_orderkey % 97) + 1 AS u, max(l_linenumber) - min(l_linenumber) + 1 AS v, sum(l_quantity) AS t
             FROM lineitem GROUP BY 1, 2) a""",
)
def _(x):
    from ..operators.expand import cluster_features

    cells = x.table("lineitem").select(
        F.col("l_suppkey").alias("event_id"),
        F.col("l_partkey").alias("measurement_id"),
        (F.col("l_orderkey") % 97).alias("channel0"),
        F.col("l_linenumber").alias("channel1"),
        F.col("l_quantity").alias("value"),
    )
    return q.cluster_probe(cluster_features(cells))


@check(
    "chi2_saturation",
    "n_known:l max_chi2:d n_saturated:l frac_saturated:d",
    """SELECT count(chi2_inc) AS n_known, max(chi2_inc) AS max_chi2, count(CASE WHEN chi2_inc > 276e-1 THEN 1 END) AS n_saturated,
              count(CASE WHEN chi2_inc > 276e-1 THEN 1 END) * 1e0 / count(chi2_inc) AS frac_saturated FROM cand WHERE is_ckf_selected""",
    "cand",
)
def _(x):
    return q.saturation(x.cand.where("is_ckf_selected"))


@check(
    "field_report",
    "field present:b n_known:l n_nan:l",
    """SELECT 'chi2_inc' AS field, true AS present, count(chi2_inc) AS n_known, 0 AS n_nan FROM cand
       UNION ALL SELECT 'seed_id', true, count(seed_id), 0 FROM cand UNION ALL SELECT 'state_t', false, 0, 0""",
    "cand",
)
def _(x):
    return q.field_report(x.cand, ["chi2_inc", "seed_id", "state_t"])


@check(
    "differs_from_baseline",
    "n_only_new:l n_only_baseline:l",
    """SELECT (SELECT count(*) FROM lineitem WHERE l_tax > 6e-2) AS n_only_new, (SELECT count(*) FROM lineitem WHERE l_tax > 6e-2) AS n_only_baseline""",
)
def _(x):
    li = x.table("lineitem")
    changed = F.when(F.col("l_tax") > 0.06, F.lit("changed")).otherwise(F.col("l_returnflag"))
    return q.differs_from_baseline(li.withColumn("l_returnflag", changed), li)


@check(
    "correlation_summary",
    "sensor:l n:l mean_abs_rho:d rho_p10:d rho_p50:d rho_p90:d chi2_delta_p10:d chi2_delta_p50:d chi2_delta_p90:d",
    f"""SELECT sensor, count(*) AS n, avg(abs(rho)) AS mean_abs_rho, {', '.join(f'quantile_cont({c}, {p / 100}) AS {c}_p{p}' for c in ('rho', 'chi2_delta') for p in (10, 50, 90))}
        FROM (SELECT {SENSOR} AS sensor, S01 / sqrt(S00 * S11) AS rho, chi2_inc - (residual_l0 * residual_l0 / S00 + residual_l1 * residual_l1 / S11) AS chi2_delta
              FROM cand WHERE cand_hit_id >= 0 AND NOT is_1d) a GROUP BY 1""",
    "cand",
)
def _(x):
    from ..functions.geometry import chi2_full_and_diagonal, correlation
    from ..functions.strata import sensor_class

    d = x.cand.where("cand_hit_id >= 0 AND NOT is_1d").select(
        sensor_class("volume_id").alias("sensor"),
        correlation("S00", "S01", "S11").alias("rho"),
        chi2_full_and_diagonal("residual_l0", "residual_l1", "S00", "S01", "S11")["chi2_delta"],
    )
    d = d.toDF("sensor", "rho", "chi2_delta")
    return q.correlation_summary(d, ["sensor"])


_TILTED = """
  SELECT state_theta AS dens, S01 / sqrt(S00 * S11) AS rho, chi2_inc - (residual_l0 * residual_l0 / S00 + residual_l1 * residual_l1 / S11) AS delta
  FROM cand WHERE cand_hit_id >= 0 AND NOT is_1d"""
_QUINTILES = f"""
  SELECT q.quintile, e[q.quintile + 1] AS geom_lo, e[q.quintile + 2] AS geom_hi, coalesce(n, 0) AS n, mean_delta, median_delta
  FROM (SELECT unnest(range(5)) AS quintile) q, (SELECT quantile_cont(dens, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM ({_TILTED}) d) edges
  LEFT JOIN (
    SELECT CAST(dens >= e[2] AS INT) + CAST(dens >= e[3] AS INT) + CAST(dens >= e[4] AS INT) + CAST(dens >= e[5] AS INT) AS quintile,
           count(*) AS n, avg(delta) AS mean_delta, median(delta) AS median_delta
    FROM ({_TILTED}) d, (SELECT quantile_cont(dens, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM ({_TILTED}) f) edges GROUP BY 1) s ON s.quintile = q.quintile"""


def _tilted(x):
    from ..functions.geometry import chi2_full_and_diagonal, correlation

    return x.cand.where("cand_hit_id >= 0 AND NOT is_1d").select(
        F.col("state_theta").alias("dens"),
        correlation("S00", "S01", "S11").alias("rho"),
        chi2_full_and_diagonal("residual_l0", "residual_l1", "S00", "S01", "S11")["chi2_delta"].alias("delta"),
    )


@check("correlation_by_density_quintile", "quintile:l geom_lo:d geom_hi:d n:l mean_delta:d median_delta:d", _QUINTILES, "cand")
def _(x):
    return q.density_quintiles(_tilted(x), "dens", "delta")


@check(
    "correlation_verdict",
    "spread:d rho_median_abs:d rank_correlation:d safe:b",
    f"""SELECT *, coalesce(spread < 0.1 AND rho_median_abs < 0.2 AND (rank_correlation IS NULL OR abs(rank_correlation) < 0.05), false) AS safe
        FROM (SELECT max(mean_delta) - min(mean_delta) AS spread FROM ({_QUINTILES}) a), (SELECT median(abs(rho)) AS rho_median_abs FROM ({_TILTED}) b),
             (SELECT CASE WHEN count(*) > 10 THEN corr(ra, rb) END AS rank_correlation FROM (
                SELECT rank() OVER (ORDER BY dens) + (count(*) OVER (PARTITION BY dens) - 1) / 2e0 AS ra,
                       rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2e0 AS rb FROM ({_TILTED}) t
                WHERE dens IS NOT NULL AND delta IS NOT NULL) r) k""",
    "cand",
)
def _(x):
    return q.correlation_verdict(_tilted(x), "dens", "delta")


@check(
    "first_row_by_key",
    "event_id seed_id step_k cand_hit_id chi2_inc:d",
    """SELECT event_id, seed_id, step_k, cand_hit_id, chi2_inc FROM (
         SELECT *, row_number() OVER (PARTITION BY event_id, seed_id ORDER BY chi2_inc DESC NULLS LAST, step_k, cand_hit_id) AS rn FROM cand) a WHERE rn = 1""",
    "cand",
)
def _(x):
    from ..operators.ordered import first_by_key

    worst = (-F.col("chi2_inc")).isNull(), -F.col("chi2_inc")
    slim = x.cand.select("event_id", "seed_id", "step_k", "cand_hit_id", "chi2_inc")
    return first_by_key(slim, ["event_id", "seed_id"], [*worst, "step_k", "cand_hit_id"])
