"""Purity, failure cube, emulation, material, occupancy and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.expr import bin_index
from ..functions.strata import sensor_class
from ..operators import failure as f
from ..operators import resolve
from ..operators.targets import logged_targets, valid_targets
from ..operators.truth import particle_pt
from .registry import check
from .sqltext import BRANCH, MEMBER, NEED, SENSOR, STATE, TRUE_HIT, bucket, eta, wilson
from .targets import _TARGETS
from .views import view

KEYS = STATE.replace(",", "")
WIDTH = 5
POINT = f.OperatingPoint(chi2_max=40.0, min_hits=2, max_holes=2, pt_min=0.3)


@check(
    "followed_branch",
    "event_id seed_id branch_id",
    """SELECT event_id, seed_id, branch_id FROM (
         SELECT event_id, seed_id, branch_id, row_number() OVER (PARTITION BY event_id, seed_id ORDER BY count(*) DESC, branch_id) AS rn
         FROM fork WHERE is_ckf_selected GROUP BY 1, 2, 3) a WHERE rn = 1""",
    "fork",
)
def _(x):
    return f.followed_branch(x.fork)


view("followed", "fork")(
    """
    SELECT event_id, seed_id, branch_id FROM (
        SELECT event_id, seed_id, branch_id, row_number() OVER (PARTITION BY event_id, seed_id ORDER BY count(*) DESC, branch_id) AS rn
        FROM fork WHERE is_ckf_selected GROUP BY event_id, seed_id, branch_id) a WHERE rn = 1
    """
)


def _head(source: str, keys: str, where: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY step_k, cand_hit_id) AS rn FROM {source} WHERE {where})"""


@check(
    "seed_purity_strict",
    f"{BRANCH.replace(',', '')} seed_purity",
    f"""SELECT {BRANCH}, CASE WHEN sum(CAST({MEMBER} AS INT)) >= 3 THEN 'pure' ELSE 'majority' END AS seed_purity
        FROM {_head('fork', BRANCH, 'is_ckf_selected')} h WHERE rn <= 3 GROUP BY {BRANCH}""",
    "fork",
)
def _(x):
    return f.seed_purity(x.fork)


@check(
    "branch_purity",
    "event_id seed_id is_pure:b",
    f"""SELECT event_id, seed_id, bool_and({MEMBER}) AS is_pure
        FROM {_head('(SELECT fork.* FROM fork JOIN followed USING (event_id, seed_id, branch_id)) p', 'event_id, seed_id', 'is_ckf_selected')} h
        WHERE rn <= 3 GROUP BY 1, 2""",
    "fork followed",
)
def _(x):
    return f.branch_purity(x.fork, f.followed_branch(x.fork))


@check(
    "candidate_row_purity",
    f"{BRANCH.replace(',', '')} is_pure:b",
    f"""SELECT {BRANCH}, coalesce(p, true) AS is_pure FROM (SELECT DISTINCT {BRANCH} FROM fork) b LEFT JOIN (
          SELECT {BRANCH}, bool_and({MEMBER}) AS p FROM {_head('fork', BRANCH, 'cand_hit_id <> -1')} h WHERE rn <= 3 GROUP BY {BRANCH}) q
        USING ({BRANCH})""",
    "fork",
)
def _(x):
    return f.candidate_row_purity(x.fork)


_STATES = f"""
  SELECT {STATE}, min(volume_id) AS volume_id, min(state_theta) AS state_theta, min(n_window) AS n_window,
         min(branch_majority_pid) AS branch_majority_pid, bool_or(majority_true_hit_on_surface) AS on_surface,
         min(CASE WHEN {TRUE_HIT} THEN {NEED} END) AS d_true, count(CASE WHEN {TRUE_HIT} THEN 1 END) AS n_true_rows
  FROM cand GROUP BY {STATE}"""
_FULL = f"""
  st AS ({_STATES}),
  pt AS (SELECT event_id, particle_id, p AS pt_gev FROM (
           SELECT event_id, particle_id, sqrt(tpx * tpx + tpy * tpy) AS p,
                  row_number() OVER (PARTITION BY event_id, particle_id ORDER BY tt NULLS LAST, hit_id) AS rn FROM simhits) a WHERE rn = 1),
  fs AS (SELECT st.*, pt.pt_gev, (st.seed_id + st.event_id) % 3 <> 0 AS is_pure, seed_id % 4 <> 0 AS survived
         FROM st LEFT JOIN pt ON pt.event_id = st.event_id AND pt.particle_id = st.branch_majority_pid),
  cube AS (
    SELECT {bucket('e', [-3.5 + i * 0.05 for i in range(1, 140)])} AS eta_bin, sensor, is_pure, {bucket('n_window', [2, 5, 10, 20])} AS occupancy,
           {bucket('coalesce(pt_gev, 0)', [0.7, 0.9, 1.0])} AS pt_bin, survived, count(*) AS mod_total, count(CASE WHEN NOT on_surface THEN 1 END) AS mod_fail,
           count(CASE WHEN on_surface THEN 1 END) AS win_total,
           {', '.join(f'count(CASE WHEN on_surface AND (d_true IS NULL OR d_true > {n}) THEN 1 END) AS win_fail_{n}' for n in (3, 5, 7, 10))}
    FROM (SELECT *, {SENSOR} AS sensor, {eta('state_theta', '1e-10')} AS e FROM fs) s WHERE sensor >= 0 GROUP BY 1, 2, 3, 4, 5, 6)"""


#: The cube of the followed branches with their own purity and resolution.
RESOLVED_CUBE = f"""SELECT * FROM (WITH RECURSIVE
  defined AS (SELECT * FROM cand WHERE NOT majority_undefined),
  chosen AS (
    SELECT event_id, seed_id, branch_id FROM (
      SELECT event_id, seed_id, branch_id, row_number() OVER (PARTITION BY event_id, seed_id ORDER BY count(*) DESC, branch_id) AS rn
      FROM defined WHERE is_ckf_selected GROUP BY event_id, seed_id, branch_id) a WHERE rn = 1),
  used AS (SELECT defined.* FROM defined JOIN chosen USING (event_id, seed_id, branch_id)),
  pure AS (SELECT event_id, seed_id, bool_and({MEMBER}) AS is_pure FROM {_head("used", "event_id, seed_id", "is_ckf_selected")} h WHERE rn <= 3 GROUP BY 1, 2),
  RESOLUTION,
  {_FULL.replace("FROM cand GROUP BY", "FROM used GROUP BY").replace("(st.seed_id + st.event_id) % 3 <> 0 AS is_pure, seed_id % 4 <> 0 AS survived", "coalesce(pure.is_pure, false) AS is_pure, coalesce(resolved.survived, false) AS survived").replace("FROM st LEFT JOIN pt", "FROM st LEFT JOIN pure USING (event_id, seed_id) LEFT JOIN resolved USING (event_id, seed_id) LEFT JOIN pt")}
  SELECT * FROM cube) z"""


def _full(tail: str) -> str:
    return f"SELECT * FROM (WITH {_FULL} {tail}) z"


def _flagged(x):
    return f.state_table(x.cand).withColumns(
        {"is_pure": (F.col("seed_id") + F.col("event_id")) % 3 != 0, "survived": F.col("seed_id") % 4 != 0}
    )


@check(
    "state_table",
    f"{KEYS} volume_id state_theta:d n_window branch_majority_pid on_surface:b d_true:d n_true_rows:l",
    _STATES,
    "cand",
)
def _(x):
    return f.state_table(x.cand)


_CUBE_COLS = "eta_bin:l sensor:l is_pure:b occupancy:l pt_bin:l survived:b mod_total:l mod_fail:l win_total:l win_fail_3:l win_fail_5:l win_fail_7:l win_fail_10:l"


@check("failure_cube", _CUBE_COLS, _full("SELECT * FROM cube"), "cand simhits")
def _(x):
    return f.failure_cube(_flagged(x), particle_pt(x.simhits))


@check(
    "failure_cube_counters",
    "n_states:l n_excluded:l n_escaped:l n_multi_true:l n_pt_unmatched:l n_branches:l n_survivors:l",
    _full(
        f"""SELECT count(*) AS n_states, count(CASE WHEN {SENSOR} < 0 THEN 1 END) AS n_excluded,
                   count(CASE WHEN {SENSOR} >= 0 AND on_surface AND d_true IS NULL THEN 1 END) AS n_escaped,
                   count(CASE WHEN n_true_rows > 1 THEN 1 END) AS n_multi_true, count(CASE WHEN pt_gev IS NULL THEN 1 END) AS n_pt_unmatched,
                   count(DISTINCT (event_id, seed_id)) AS n_branches,
                   count(DISTINCT CASE WHEN survived THEN event_id * 1000000 + seed_id END) AS n_survivors FROM fs"""
    ),
    "cand simhits",
)
def _(x):
    return f.cube_counters(_flagged(x), particle_pt(x.simhits))


@check(
    "failure_rates_by_eta",
    "eta_bin:l mod_total:l mod_fail:l mod_rate:d mod_lo:d mod_hi:d win_total:l win_fail_5:l win_rate:d win_lo:d win_hi:d",
    _full(
        f"""SELECT *, mod_fail * 1e0 / mod_total AS mod_rate, {wilson('mod_fail', 'mod_total')[0]} AS mod_lo, {wilson('mod_fail', 'mod_total')[1]} AS mod_hi,
                   CASE WHEN win_total > 0 THEN win_fail_5 * 1e0 / win_total END AS win_rate,
                   {wilson('win_fail_5', 'win_total')[0]} AS win_lo, {wilson('win_fail_5', 'win_total')[1]} AS win_hi
            FROM (SELECT eta_bin, sum(mod_total) AS mod_total, sum(mod_fail) AS mod_fail, sum(win_total) AS win_total, sum(win_fail_5) AS win_fail_5
                  FROM cube WHERE pt_bin >= 1 AND survived GROUP BY eta_bin) s"""
    ),
    "cand simhits",
)
def _(x):
    cube = f.failure_cube(_flagged(x), particle_pt(x.simhits))
    s = f.slice_cube(cube, ["eta_bin"], pt_min=0.7, survivors_only=True)
    return f.with_rate(f.with_rate(s, "mod_fail", "mod_total", "mod"), "win_fail_5", "win_total", "win")


_EMU = f"""
  per AS (SELECT event_id, seed_id, step_k, min(volume_id) AS volume_id, min(state_theta) AS th, min(state_qop) AS q,
                 count(CASE WHEN is_ckf_selected THEN 1 END) AS n, max(CASE WHEN is_ckf_selected THEN chi2_inc END) AS c
          FROM cand GROUP BY 1, 2, 3),
  run AS (SELECT *, sum(CASE WHEN {SENSOR} >= 0 AND n = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, seed_id ORDER BY step_k) AS holes,
                 first_value(q) OVER (PARTITION BY event_id, seed_id ORDER BY step_k) AS q0,
                 first_value(th) OVER (PARTITION BY event_id, seed_id ORDER BY step_k) AS t0 FROM per),
  emu AS (SELECT event_id, seed_id, min(CASE WHEN holes > 2 THEN step_k END) AS cutoff_step,
                 coalesce(sum(CASE WHEN holes <= 2 THEN n END), 0) AS n_prefix_hits,
                 coalesce(max(CASE WHEN holes <= 2 THEN c END) < 40, false) AND coalesce(sum(CASE WHEN holes <= 2 THEN n END), 0) >= 2
                   AND min(q0) <> 0 AND coalesce(abs(1e0 / nullif(min(q0), 0)) * sin(min(t0)) > 3e-1, false) AS passes_emulation
          FROM run GROUP BY 1, 2)"""


def _states_of(x):
    return x.cand.groupBy("event_id", "seed_id", "step_k").agg(
        F.min("volume_id").alias("volume_id"), F.min("state_theta").alias("state_theta"), F.min("state_qop").alias("state_qop")
    )


@check(
    "emulated_operating_point",
    "event_id seed_id passes_emulation:b cutoff_step:l n_prefix_hits:l",
    f"SELECT * FROM (WITH {_EMU} SELECT * FROM emu) z",
    "cand",
)
def _(x):
    return f.emulate(x.cand, _states_of(x), POINT, width=WIDTH)


@check(
    "emulated_prefix_rows",
    f"{KEYS} cand_hit_id",
    f"""SELECT * FROM (WITH {_EMU} SELECT {STATE}, cand_hit_id FROM cand JOIN emu USING (event_id, seed_id)
        WHERE passes_emulation AND (cutoff_step IS NULL OR step_k < cutoff_step)) z""",
    "cand",
)
def _(x):
    return f.emulated_prefix(x.cand, f.emulate(x.cand, _states_of(x), POINT))


_TRUE = f"SELECT *, {NEED} AS d FROM cand WHERE {TRUE_HIT} AND NOT majority_undefined"


@check(
    "window_failure_by_purity",
    "is_pure:b total:l fail_3:l fail_5:l fail_7:l fail_10:l rate_3:d rate_10:d",
    f"""SELECT is_pure, count(*) AS total, {', '.join(f'count(CASE WHEN d > {n} THEN 1 END) AS fail_{n}' for n in (3, 5, 7, 10))},
               count(CASE WHEN d > 3 THEN 1 END) * 1e0 / count(*) AS rate_3, count(CASE WHEN d > 10 THEN 1 END) * 1e0 / count(*) AS rate_10
        FROM ({_TRUE}) t JOIN (SELECT event_id, seed_id, bool_and({MEMBER}) AS is_pure FROM {_head('cand', 'event_id, seed_id', 'is_ckf_selected')} h
                               WHERE rn <= 3 GROUP BY 1, 2) p USING (event_id, seed_id) GROUP BY is_pure""",
    "cand",
)
def _(x):
    pure = f.branch_purity(x.cand, x.cand.select(*f.BRANCH).distinct())
    return f.failure_by(x.cand.join(pure, list(f.SEED), "inner"), ["is_pure"])


@check(
    "window_failure_by_signed_eta",
    "eta_bin:l total:l fail_5:l rate_5:d",
    f"""SELECT {bucket(eta('state_theta'), [-2, -1, 0, 1, 2])} AS eta_bin, count(*) AS total, count(CASE WHEN d > 5 THEN 1 END) AS fail_5,
               count(CASE WHEN d > 5 THEN 1 END) * 1e0 / count(*) AS rate_5 FROM ({_TRUE}) t GROUP BY 1""",
    "cand",
)
def _(x):
    e = bin_index(g.pseudorapidity("state_theta"), [-2, -1, 0, 1, 2])
    return f.failure_by(x.cand.withColumn("eta_bin", e), ["eta_bin"], [5.0])


@check(
    "module_failure_by_density",
    "eta_bin:l is_pixel:b density_bin:l mod_total:l mod_fail:l",
    f"""SELECT {bucket(eta('th', '1e-10'), [-3.5 + i * 0.05 for i in range(1, 140)])} AS eta_bin, is_pixel, {bucket('gd', [2, 5, 10, 20])} AS density_bin,
               count(*) AS mod_total, count(CASE WHEN NOT os THEN 1 END) AS mod_fail
        FROM (SELECT {STATE}, min(state_theta) AS th, bool_or(is_pixel) AS is_pixel, min(geometric_density) AS gd, bool_or(majority_true_hit_on_surface) AS os
              FROM cand WHERE NOT majority_undefined GROUP BY {STATE}) s GROUP BY 1, 2, 3""",
    "cand",
)
def _(x):
    return f.module_failure(x.cand)


_MAT = f"""SELECT {STATE}, sum(x0) OVER (PARTITION BY {BRANCH} ORDER BY step_k) AS cum_x0
           FROM (SELECT {STATE}, max(coalesce(pathInX0_interval, 0)) AS x0 FROM cand GROUP BY {STATE}) s"""


@check("cumulative_material", f"{KEYS} cum_x0:d", _MAT, "cand")
def _(x):
    return f.cumulative_material(x.cand, width=WIDTH)


_DIST = f"""SELECT {STATE}, cand_hit_id, {eta('state_theta', '1e-9')} AS eta, is_1d, abs(residual_l0) / sqrt(S00) AS z0,
                   abs(residual_l1) / sqrt(S11) AS z1, cum_x0
            FROM cand JOIN ({_MAT}) m USING ({STATE}) WHERE {TRUE_HIT} AND NOT majority_undefined"""


@check("true_hit_distances", f"{KEYS} cand_hit_id eta:d z0:d z1:d cum_x0:d", _DIST, "cand")
def _(x):
    return f.true_hit_distances(x.cand)


@check(
    "censored_rates_by_eta",
    "eta_bin:l total:l fail_3:l fail_7:l mean_x0:d",
    f"""SELECT {bucket('eta', [-2, -1, 0, 1, 2])} AS eta_bin, count(*) AS total, count(CASE WHEN d > 3 THEN 1 END) AS fail_3,
               count(CASE WHEN d > 7 THEN 1 END) AS fail_7, avg(cum_x0) AS mean_x0
        FROM (SELECT *, CASE WHEN is_1d THEN z0 ELSE greatest(z0, z1) END AS d FROM ({_DIST}) a) b GROUP BY 1""",
    "cand",
)
def _(x):
    return f.censored_rates(f.true_hit_distances(x.cand), [-9, -2, -1, 0, 1, 2, 9], [3.0, 7.0])


@check(
    "branch_summary",
    f"{BRANCH.replace(',', '')} x0_total:d mean_eta:d max_step:l has_true:b n_rows:l n_first:l n_first_true:l",
    f"""SELECT {BRANCH}, x0_total, mean_eta, max_step, has_true, n_rows, coalesce(n, 0) AS n_first, coalesce(k, 0) AS n_first_true
        FROM (SELECT {BRANCH}, sum(x0) AS x0_total, sum(e) / sum(n) AS mean_eta, max(step_k) AS max_step, bool_or(t) AS has_true, sum(n) AS n_rows
              FROM (SELECT {STATE}, max(pathInX0_interval) AS x0, sum({eta('state_theta', '1e-9')}) AS e, count(*) AS n,
                           bool_or({TRUE_HIT} AND NOT majority_undefined) AS t FROM cand GROUP BY {STATE}) s GROUP BY {BRANCH}) w
        LEFT JOIN (SELECT {BRANCH}, count(*) AS n, count(CASE WHEN {TRUE_HIT} THEN 1 END) AS k
                   FROM {_head('cand', BRANCH, 'cand_hit_id <> -1')} h WHERE rn <= 3 GROUP BY {BRANCH}) f USING ({BRANCH})""",
    "cand",
)
def _(x):
    return f.branch_summary(x.cand)


_TERM = f"""SELECT {BRANCH}, arg_max(n_hits, step_k) AS n_hits, arg_max(n_holes, step_k) AS n_holes, arg_max(n_seq_holes, step_k) AS n_seq_holes,
                   arg_max(state_qop, step_k) AS state_qop, count(*) AS n_rows FROM cand GROUP BY {BRANCH}"""


@check("terminal_rows", f"{BRANCH.replace(',', '')} n_hits:l n_holes:l n_seq_holes:l state_qop:d n_rows:l", _TERM, "cand")
def _(x):
    return f.terminal_rows(x.cand)


@check(
    "hole_cap_survival",
    "config cap:l n_branches:l n_surviving:l branch_fraction:d row_fraction:d",
    f"""SELECT config, cap, count(*) AS n_branches, count(CASE WHEN n_holes <= cap THEN 1 END) AS n_surviving,
               count(CASE WHEN n_holes <= cap THEN 1 END) * 1e0 / count(*) AS branch_fraction,
               coalesce(sum(CASE WHEN n_holes <= cap THEN n_rows END), 0) * 1e0 / sum(n_rows) AS row_fraction
        FROM ({_TERM}) t CROSS JOIN (VALUES ('tight', 0), ('medium', 1), ('loose', 2)) c(config, cap) GROUP BY 1, 2""",
    "cand",
)
def _(x):
    return f.hole_cap_survival(f.terminal_rows(x.cand), {"tight": 0, "medium": 1, "loose": 2})


@check(
    "occupancy_by_window",
    "window_n:d n_in_window:l is_pixel:b n_states:l n_rows:l n_pos:l",
    f"""SELECT w AS window_n, least(size, 199) AS n_in_window, is_pixel, count(*) AS n_states, sum(size) AS n_rows, sum(pos) AS n_pos
        FROM (SELECT {STATE}, is_pixel, w, count(*) AS size, count(CASE WHEN {TRUE_HIT} AND NOT majority_undefined THEN 1 END) AS pos
              FROM cand, (VALUES (3e0), (7e0), (10e0)) v(w)
              WHERE cand_hit_id <> -1 AND NOT is_1d AND greatest(abs(residual_l0) / sqrt(S00), abs(residual_l1) / sqrt(S11)) <= w
              GROUP BY ALL) s GROUP BY 1, 2, 3""",
    "cand",
)
def _(x):
    return f.occupancy_by_window(x.cand, [3.0, 7.0, 10.0])


@check(
    "in_ellipse_counts",
    f"{KEYS} cand_hit_id n_ellipse:l",
    f"SELECT {STATE}, cand_hit_id, count(CASE WHEN chi2_inc < 25 THEN 1 END) OVER (PARTITION BY {STATE}) AS n_ellipse FROM cand",
    "cand",
)
def _(x):
    return f.in_window_counts(x.cand, g.in_ellipse("chi2_inc", 5), "n_ellipse")


@check(
    "chi2_histogram",
    "bin:l label:b sensor:l count:l",
    f"""SELECT CAST(least(59, floor((log10(chi2_inc) + 3e0) / 1e-1)) AS BIGINT) AS bin, {TRUE_HIT} AS label, {SENSOR} AS sensor, count(*) AS count
        FROM cand WHERE chi2_inc > 0 AND log10(chi2_inc) BETWEEN -3 AND 3 GROUP BY 1, 2, 3""",
    "cand",
)
def _(x):
    return f.log_histogram(x.cand, "chi2_inc", {"label": f.is_true_hit(), "sensor": sensor_class("volume_id")}, n=60)


_EV = f"""SELECT event_id, count(*) AS total_rows, avg(CASE WHEN cand_hit_id = -1 THEN 1e0 ELSE 0e0 END) AS hole_fraction,
                 avg(CASE WHEN majority_undefined THEN 1e0 ELSE 0e0 END) AS undefined_fraction,
                 count(CASE WHEN {TRUE_HIT} AND NOT majority_undefined THEN 1 END) * 1e0 / count(CASE WHEN cand_hit_id <> -1 AND NOT majority_undefined THEN 1 END) AS positive_fraction,
                 quantile_cont(CASE WHEN cand_hit_id <> -1 THEN n_window END, 0.5) AS median_n_window,
                 quantile_cont(CASE WHEN cand_hit_id <> -1 AND chi2_inc > 0 THEN chi2_inc END, 0.5) AS median_chi2 FROM cand GROUP BY 1"""
_EV_COLS = ["total_rows", "hole_fraction", "undefined_fraction", "positive_fraction", "median_n_window", "median_chi2"]


@check(
    "event_summary",
    "event_id total_rows:l hole_fraction:d undefined_fraction:d positive_fraction:d median_n_window:d median_chi2:d outlier_flags",
    "SELECT *, concat_ws(', ', "
    + ", ".join(
        f"CASE WHEN count({c}) OVER () > 2 AND stddev_samp({c}) OVER () > 0 AND abs({c} - avg({c}) OVER ()) > 2 * stddev_samp({c}) OVER () THEN '{c}' END"
        for c in _EV_COLS
    )
    + f") AS outlier_flags FROM ({_EV}) e",
    "cand",
)
def _(x):
    return f.event_summary(x.cand)


@check(
    "target_means_by_step",
    "is_odd:b bin:l count:l mean_vstar_t1:d mean_vstar_t2:d",
    f"""SELECT branch_id % 2 = 1 AS is_odd, {bucket('step_k', [2.5, 5.5, 8.5])} AS bin, count(*) AS count,
               CASE WHEN count(*) >= 50 THEN avg(vstar_t1) END AS mean_vstar_t1, CASE WHEN count(*) >= 50 THEN avg(vstar_t2) END AS mean_vstar_t2
        FROM ({_TARGETS}) z WHERE vstar_t2 IS NOT NULL AND NOT tier_invariant_violated GROUP BY 1, 2""",
    "steps totals",
)
def _(x):
    d = valid_targets(logged_targets(x.steps, x.totals)).withColumn("is_odd", F.col("branch_id") % 2 == 1)
    return f.binned_means(d, "step_k", [-0.5, 2.5, 5.5, 8.5, 11.5], ["vstar_t1", "vstar_t2"], by=["is_odd"], min_count=50)


@check(
    "layer_means",
    "volume_id layer_id total_count:l mean_chi2_inc:d mean_n_window:d",
    "SELECT volume_id, layer_id, count(*) AS total_count, avg(chi2_inc) AS mean_chi2_inc, avg(n_window) AS mean_n_window FROM cand GROUP BY 1, 2",
    "cand",
)
def _(x):
    return f.layer_means(x.cand, ["chi2_inc", "n_window"])


_HOLES = f"""
  st AS (SELECT {STATE}, max(n_window) > 0 AS hit, max(volume_id) IN (20, 28) AS dead FROM cand GROUP BY {STATE}),
  c1 AS (SELECT *, coalesce(sum(CAST(NOT hit AS INT)) OVER w, 0) AS nh_all, coalesce(sum(CAST(NOT hit AND NOT dead AS INT)) OVER w, 0) AS nh_sensor FROM st
         WINDOW w AS (PARTITION BY {BRANCH} ORDER BY step_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  c2 AS (SELECT {STATE}, nh_all, nh_sensor, nh_all - coalesce(max(CASE WHEN hit THEN nh_all END) OVER w, 0) AS seq_all,
                nh_sensor - coalesce(max(CASE WHEN hit AND NOT dead THEN nh_sensor END) OVER w, 0) AS seq_sensor,
                nh_sensor - coalesce(max(CASE WHEN hit OR dead THEN nh_sensor END) OVER w, 0) AS seq_reset, nh_all - nh_sensor AS d_holes FROM c1
         WINDOW w AS (PARTITION BY {BRANCH} ORDER BY step_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@check(
    "hole_counter_mismatch",
    f"{KEYS} nh_all:l nh_sensor:l seq_all:l seq_sensor:l seq_reset:l d_holes:l",
    f"SELECT * FROM (WITH {_HOLES} SELECT * FROM c2) z",
    "cand",
)
def _(x):
    s = x.cand.groupBy(*KEYS.split()).agg(F.max("n_window").alias("n_window"), F.max("volume_id").alias("volume_id"))
    return f.hole_counter_mismatch(s, (20, 28), width=WIDTH)


@check(
    "hole_mismatch_profile",
    "step_k n:l mean_d:d p50:d p90:d",
    f"""SELECT * FROM (WITH {_HOLES} SELECT step_k, count(*) AS n, avg(d_holes) AS mean_d, quantile_cont(d_holes, 0.5) AS p50, quantile_cont(d_holes, 0.9) AS p90
        FROM c2 GROUP BY step_k) z""",
    "cand",
)
def _(x):
    from ..operators.ordered import exact_percentiles

    s = x.cand.groupBy(*KEYS.split()).agg(F.max("n_window").alias("n_window"), F.max("volume_id").alias("volume_id"))
    m = f.hole_counter_mismatch(s, (20, 28))
    q = exact_percentiles(m, "d_holes", [0.5, 0.9], by=["step_k"]).groupBy("step_k").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.9, F.col("value"))).alias("p90")
    )
    return m.groupBy("step_k").agg(F.count(F.lit(1)).alias("n"), F.avg("d_holes").alias("mean_d")).join(q, ["step_k"])


_CB, _OB = bucket("chi2_inc", [1, 4, 9, 25]), bucket("n_window", [2, 3, 5])
_CELLS = f"""SELECT event_id, {_CB} AS chi2_bin, {_OB} AS occ_bin, count(*) AS n, count(CASE WHEN {MEMBER} THEN 1 END) AS k
             FROM cand WHERE cand_hit_id <> -1 AND NOT majority_undefined GROUP BY 1, 2, 3"""


def _cells(x):
    from ..functions.strata import label_columns

    lab = label_columns()
    d = x.cand.where(lab["gate_row_mask"]).withColumn("label", lab["label_same_particle"])
    return f.event_cells(d, "label", bin_index("chi2_inc", [1, 4, 9, 25]), bin_index("n_window", [2, 3, 5]))


@check(
    "chi2_occupancy_contingency",
    "chi2_bin:l occ_bin:l n_rows:l n_correct:l frac:d n_events:l",
    f"SELECT chi2_bin, occ_bin, sum(n) AS n_rows, sum(k) AS n_correct, sum(k) * 1e0 / sum(n) AS frac, count(*) AS n_events FROM ({_CELLS}) c GROUP BY 1, 2",
    "cand",
)
def _(x):
    return f.contingency(_cells(x))


@check(
    "log_odds_lines",
    "occ_bin:l slope:d intercept:d",
    f"""SELECT occ_bin, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM (
          SELECT occ_bin, ([5e-1, 25e-1, 65e-1, 17e0, 40e0])[chi2_bin + 1] AS x, ln(p / (1 - p)) AS y FROM (
            SELECT chi2_bin, occ_bin, greatest(1e-6, least(1 - 1e-6, sum(k) * 1e0 / sum(n))) AS p FROM ({_CELLS}) c GROUP BY 1, 2) a) b GROUP BY 1""",
    "cand",
)
def _(x):
    return f.log_odds_lines(_cells(x), [0.5, 2.5, 6.5, 17.0, 40.0])


_REPLICAS = f"""
    WITH cells AS ({_CELLS}),
    ev AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT event_id FROM cells) d),
    times AS (
        SELECT boot, ev.event_id, count(*) AS times
        FROM (SELECT boot, least(floor(CAST('0x' || substr(md5('0|' || boot || '|' || i), 1, 13) AS BIGINT) / 4503599627370496e0 * m), m - 1) AS pick
              FROM ev, (SELECT unnest(range(100)) AS boot) r) p JOIN ev ON ev.i = pick
        GROUP BY 1, 2
    )
    SELECT boot, chi2_bin, occ_bin, sum(k * times) * 1e0 / sum(n * times) AS frac FROM cells JOIN times USING (event_id) GROUP BY 1, 2, 3
"""


@check(
    "bootstrap_bands",
    "chi2_bin:l occ_bin:l frac_std:d frac_lo:d frac_hi:d",
    f"""SELECT chi2_bin, occ_bin, stddev_samp(frac) AS frac_std, quantile_cont(frac, 25e-3) AS frac_lo, quantile_cont(frac, 975e-3) AS frac_hi
        FROM ({_REPLICAS}) b GROUP BY 1, 2""",
    "cand",
)
def _(x):
    cells = _cells(x)
    return f.bootstrap_bands(f.bootstrap_fractions(cells, f.bootstrap_multiplicity(cells, 100)))


@check(
    "bootstrap_separation",
    "boot:l separation:d",
    f"""SELECT boot, avg(s - d) AS separation FROM (
          SELECT boot, chi2_bin, max(CASE WHEN occ_bin = 0 THEN y END) AS s, max(CASE WHEN occ_bin = 3 THEN y END) AS d FROM (
            SELECT boot, chi2_bin, occ_bin, ln(p / (1 - p)) AS y FROM (SELECT boot, chi2_bin, occ_bin, greatest(1e-6, least(1 - 1e-6, frac)) AS p FROM ({_REPLICAS}) b) c) e
          GROUP BY 1, 2) g GROUP BY 1""",
    "cand",
)
def _(x):
    cells = _cells(x)
    return f.separation(f.bootstrap_fractions(cells, f.bootstrap_multiplicity(cells, 100)), 0, 3)


@check(
    "bootstrap_draw_totals",
    "boot:l draws:l",
    f"""SELECT b AS boot, (SELECT count(DISTINCT event_id) FROM ({_CELLS}) c) AS draws FROM (SELECT unnest(range(100)) AS b) r""",
    "cand",
)
def _(x):
    return f.bootstrap_multiplicity(_cells(x), 100).groupBy("boot").agg(F.sum("times").alias("draws"))


def resolution_sql(rows: str, max_shared: int, min_hits: int) -> str:
    """Body of a WITH RECURSIVE: ``resolved`` (event_id, seed_id, survived), one branch of each event dropped a step."""
    return f"""
      picked AS (SELECT event_id, seed_id, cand_hit_id, chi2_inc FROM {rows} WHERE is_ckf_selected),
      own AS (SELECT DISTINCT event_id, seed_id, cand_hit_id FROM picked),
      sized AS (
        SELECT event_id, seed_id, n, chi2 FROM (SELECT event_id, seed_id, count(*) AS n FROM own GROUP BY 1, 2 HAVING count(*) >= {min_hits}) a
        JOIN (SELECT event_id, seed_id, sum(chi2_inc) AS chi2 FROM picked GROUP BY 1, 2) b USING (event_id, seed_id)),
      alive(event_id, seeds) AS (
        SELECT event_id, list(seed_id) FROM sized GROUP BY event_id
        UNION ALL
        SELECT event_id, list_filter(seeds, lambda s: s <> worst.seed_id) FROM (
          SELECT event_id, any_value(seeds) AS seeds,
                 list({{'seed_id': seed_id, 'shared': shared}} ORDER BY shared * 1e0 / n DESC, n, chi2 DESC NULLS LAST, seed_id)[1] AS worst
          FROM (
            SELECT o.event_id, o.seed_id, any_value(o.seeds) AS seeds, z.n, z.chi2, count(CASE WHEN o.owners > 1 THEN 1 END) AS shared
            FROM (SELECT a.event_id, a.seeds, w.seed_id, w.cand_hit_id, count(*) OVER (PARTITION BY a.event_id, w.cand_hit_id) AS owners
                  FROM alive a JOIN own w ON w.event_id = a.event_id AND list_contains(a.seeds, w.seed_id)) o
            JOIN sized z ON z.event_id = o.event_id AND z.seed_id = o.seed_id
            GROUP BY o.event_id, o.seed_id, z.n, z.chi2) r
          GROUP BY event_id) t
        WHERE worst.shared >= {max_shared}),
      ends AS (SELECT event_id, arg_min(seeds, len(seeds)) AS seeds FROM alive GROUP BY event_id),
      resolved AS (
        SELECT e.event_id, e.seed_id, coalesce(list_contains(ends.seeds, e.seed_id), false) AS survived
        FROM (SELECT DISTINCT event_id, seed_id FROM {rows}) e LEFT JOIN ends ON ends.event_id = e.event_id)"""


@check(
    "greedy_shared_hit_resolution",
    "event_id seed_id survived:b",
    f"SELECT * FROM (WITH RECURSIVE {resolution_sql('cand', 2, 3)} SELECT * FROM resolved) z",
    "cand",
)
def _(x):
    return resolve.resolve_shared(x.cand, max_shared=2, min_hits=3)


@check(
    "duplicated_branch_hits",
    "event_id seed_id cand_hit_id n:l",
    "SELECT event_id, seed_id, cand_hit_id, count(*) AS n FROM fork WHERE is_ckf_selected GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "fork",
)
def _(x):
    return resolve.duplicated_hits(x.fork)
