"""State tables, logged targets, state classes, worklists and rollout targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import targets as t
from ..operators.expand import branch_history
from ..sources.sinks import number_worklist
from .registry import check
from .sqltext import LOGODDS, MEMBER, SENSOR, STATE, eta
from .views import view

KEYS = STATE.replace(",", "")
WIDTH = 5  # months per chunk: the long-branch path runs on every query of this module

view("steps", "cand")(
    """
    SELECT event_id, seed_id, branch_id, step_k,
           max(CASE WHEN is_ckf_selected AND cand_hit_id >= 0 AND {member} THEN 1 ELSE 0 END) AS sel_correct,
           max(CASE WHEN is_ckf_selected AND cand_hit_id >= 0 AND NOT {member} THEN 1 ELSE 0 END) AS sel_wrong,
           max(CASE WHEN majority_true_hit_on_surface THEN 1 ELSE 0 END) = 1 AS maj_hit_on_surface,
           max(branch_majority_pid) AS branch_majority_pid
    FROM cand GROUP BY event_id, seed_id, branch_id, step_k
    """.replace("{member}", "coalesce(array_contains(contrib_pids, branch_majority_pid), false)")
)
view("totals", "simhits")(
    "SELECT event_id, particle_id, count(*) AS n_total FROM simhits GROUP BY event_id, particle_id"
)


@check(
    "step_table",
    f"{KEYS} sel_correct:l sel_wrong:l maj_hit_on_surface:b branch_majority_pid:l",
    "SELECT * FROM steps",
    "steps",
)
def _(x):
    return t.step_table(x.cand)


@check(
    "past_counts",
    "event_id seed_id step_k n_correct:l n_wrong:l",
    f"""SELECT event_id, seed_id, step_k, sum(c) OVER w AS n_correct, sum(b) OVER w AS n_wrong FROM (
          SELECT event_id, seed_id, step_k, max(CAST(is_ckf_selected AND cand_hit_id >= 0 AND {MEMBER} AS INT)) AS c,
                 max(CAST(is_ckf_selected AND cand_hit_id >= 0 AND NOT {MEMBER} AS INT)) AS b
          FROM cand WHERE NOT majority_undefined GROUP BY 1, 2, 3) a
        WINDOW w AS (PARTITION BY event_id, seed_id ORDER BY step_k)""",
    "cand",
)
def _(x):
    return t.past_counts(x.cand, width=WIDTH)


@check(
    "future_counts",
    f"{KEYS} n_future:l",
    f"""SELECT {STATE}, coalesce(sum(CAST(maj_hit_on_surface AS INT)) OVER (PARTITION BY event_id, seed_id, branch_id
          ORDER BY step_k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS n_future FROM steps""",
    "steps",
)
def _(x):
    return t.future_counts(x.steps, "maj_hit_on_surface", "n_future", width=WIDTH)


_TARGETS = f"""
  SELECT *, least(completeness, purity) AS vstar_t2, least(comp1, pur1) AS vstar_t1,
         coalesce(least(comp1, pur1) < least(completeness, purity) - 1e-12, false) AS tier_invariant_violated
  FROM (
    SELECT *, CASE WHEN n_total > 0 THEN least(1e0, (n_correct + f2) * 1e0 / n_total) END AS completeness,
           CASE WHEN n_correct + n_wrong + f2 > 0 THEN least(1e0, (n_correct + f2) * 1e0 / (n_correct + n_wrong + f2)) ELSE 0e0 END AS purity0,
           CASE WHEN n_total > 0 THEN CASE WHEN n_correct + n_wrong + f2 > 0
                THEN least(1e0, (n_correct + f2) * 1e0 / (n_correct + n_wrong + f2)) ELSE 0e0 END END AS purity,
           CASE WHEN n_total > 0 THEN least(1e0, (n_correct + f1) * 1e0 / n_total) END AS comp1,
           CASE WHEN n_total > 0 THEN CASE WHEN n_correct + n_wrong + f1 > 0
                THEN least(1e0, (n_correct + f1) * 1e0 / (n_correct + n_wrong + f1)) ELSE 0e0 END END AS pur1
    FROM (
      SELECT s.*, n_total, sum(sel_correct) OVER w AS n_correct, sum(sel_wrong) OVER w AS n_wrong,
             coalesce(sum(m) OVER f, 0) AS f2, greatest(n_total - sum(m) OVER w, 0) AS f1
      FROM (SELECT *, CAST(maj_hit_on_surface AS INT) AS m FROM steps) s
           LEFT JOIN totals k ON k.event_id = s.event_id AND k.particle_id = s.branch_majority_pid
      WINDOW w AS (PARTITION BY s.event_id, seed_id, branch_id ORDER BY step_k),
             f AS (PARTITION BY s.event_id, seed_id, branch_id ORDER BY step_k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
    ) a
  ) b"""


@check(
    "logged_targets",
    f"{KEYS} n_correct:l n_wrong:l completeness:d purity:d vstar_t1:d vstar_t2:d tier_invariant_violated:b",
    f"SELECT {STATE}, n_correct, n_wrong, completeness, purity0 AS purity, vstar_t1, vstar_t2, tier_invariant_violated FROM ({_TARGETS}) z",
    "steps totals",
)
def _(x):
    return t.logged_targets(x.steps, x.totals, width=WIDTH)


@check(
    "valid_target_rows",
    f"{KEYS} vstar_t2:d",
    f"SELECT {STATE}, vstar_t2 FROM ({_TARGETS}) z WHERE vstar_t2 IS NOT NULL AND NOT tier_invariant_violated "
    "AND (event_id, seed_id) IN (SELECT (event_id, seed_id) FROM cand WHERE NOT majority_undefined)",
    "steps totals cand",
)
def _(x):
    valid = t.valid_targets(t.logged_targets(x.steps, x.totals))
    return t.majority_defined(valid, x.cand.select("event_id", "seed_id", "majority_undefined"))


@check(
    "branch_history_sensors_only",
    f"{KEYS} n_hits:l n_holes:l n_seq_holes:l",
    f"""SELECT {STATE}, n_hits, n_holes, n_holes - coalesce(max(CASE WHEN hit = 1 THEN n_holes END) OVER w, 0) AS n_seq_holes
        FROM (SELECT *, coalesce(sum(hit) OVER w, 0) AS n_hits, coalesce(sum(hole) OVER w, 0) AS n_holes
              FROM (SELECT {STATE}, CASE WHEN max(n_window) > 0 THEN 1 ELSE 0 END AS hit,
                           CASE WHEN max(n_window) = 0 AND max({SENSOR}) >= 0 THEN 1 ELSE 0 END AS hole
                    FROM cand GROUP BY {STATE}) a
              WINDOW w AS (PARTITION BY event_id, seed_id, branch_id ORDER BY step_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) b
        WINDOW w AS (PARTITION BY event_id, seed_id, branch_id ORDER BY step_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "cand",
)
def _(x):
    from ..functions.strata import is_sensor

    s = x.cand.groupBy(*KEYS.split()).agg(F.max("n_window").alias("n_window"), F.max("volume_id").alias("volume_id"))
    hole = (F.col("n_window") == 0) & is_sensor("volume_id")
    return branch_history(s, t.BRANCH, "step_k", hole=hole, width=WIDTH)


@check(
    "value_features",
    f"{KEYS} eta:d state_qop:d sigma2_l0:d sigma2_l1:d sum_gate_logodds:d min_gate_logodds:d x0_accumulated:d",
    f"""SELECT {STATE}, {eta('th')} AS eta, state_qop, sigma2_l0, sigma2_l1, sum(coalesce(lo, 0)) OVER w AS sum_gate_logodds,
               coalesce(min(lo) OVER w, 0) AS min_gate_logodds, sum(x0) OVER w AS x0_accumulated
        FROM (SELECT {STATE}, min(state_theta) AS th, min(state_qop) AS state_qop, min(cov_00) AS sigma2_l0, min(cov_06) AS sigma2_l1,
                     min(pathInX0_interval) AS x0, max(CASE WHEN is_ckf_selected AND cand_hit_id <> -1 THEN {LOGODDS} END) AS lo
              FROM cand GROUP BY {STATE}) a
        WINDOW w AS (PARTITION BY event_id, seed_id, branch_id ORDER BY step_k)""",
    "cand",
)
def _(x):
    return t.value_features(x.cand, width=WIDTH)


view("classes", "cand", cand="event_id, seed_id")(
    """
    SELECT event_id, seed_id, step_k, n_truth, sel_hit, truth_pick,
           CASE WHEN lead(sel_hit) OVER w IS NULL THEN 'tip'
                WHEN lead(sel_hit) OVER w = lead(truth_pick) OVER w THEN 'collapse' ELSE 'divergence' END AS state_class
    FROM (
        SELECT c.event_id, c.seed_id, c.step_k, count(CASE WHEN truth THEN 1 END) AS n_truth,
               coalesce(min(CASE WHEN is_ckf_selected THEN cand_hit_id END), -1) AS sel_hit,
               coalesce(min(CASE WHEN truth AND rn = 1 THEN cand_hit_id END), -1) AS truth_pick
        FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id, seed_id, step_k, truth ORDER BY chi2_inc, cand_hit_id) AS rn
            FROM (SELECT *, coalesce(array_contains(contrib_pids, branch_majority_pid), false)
                            AND NOT majority_undefined AND cand_hit_id >= 0 AS truth FROM cand) a
        ) c
        GROUP BY c.event_id, c.seed_id, c.step_k
    ) s
    WINDOW w AS (PARTITION BY event_id, seed_id ORDER BY step_k)
    """
)


@check(
    "state_classes",
    "event_id seed_id step_k n_truth:l sel_hit:l truth_pick:l state_class",
    "SELECT * FROM classes",
    "classes",
)
def _(x):
    return t.classify_states(x.cand, width=WIDTH)


@check(
    "truth_greedy_pick",
    "event_id seed_id step_k truth_pick:l",
    "SELECT event_id, seed_id, step_k, truth_pick FROM classes WHERE truth_pick >= 0",
    "classes",
)
def _(x):
    return t.truth_pick(x.cand)


# States with filtered and predicted parameters, some missing; passive ones on volume 20.
view("locations", "cand")(
    """
    SELECT event_id, seed_id, step_k, min(volume_id) AS volume_id, min(layer_id) AS layer_id,
           CASE WHEN min(volume_id) = 20 OR (seed_id + step_k) % 5 = 0 THEN 0 ELSE min(module_id) END AS module_id,
           CASE WHEN step_k % 3 <> 0 THEN min(state_theta) END AS theta_flt, min(state_theta) + 1e0 AS theta_prt,
           CASE WHEN step_k % 4 <> 0 THEN min(cov_00) END AS err_flt, min(cov_00) + 1e0 AS err_prt
    FROM cand GROUP BY event_id, seed_id, step_k
    """
)
view("surface_ids", "cand")(
    """
    SELECT volume_id, layer_id, module_id, min(src) AS src FROM (
        SELECT DISTINCT volume_id, layer_id, module_id, 0 AS src FROM cand WHERE module_id % 2 = 0
        UNION ALL SELECT DISTINCT volume_id, layer_id, module_id, 1 AS src FROM cand
    ) u WHERE module_id > 0 GROUP BY volume_id, layer_id, module_id
    """
)
_GID = "(volume_id << 56) | (layer_id << 36) | (module_id << 8) | CASE WHEN src = 0 THEN 3 ELSE 0 END"


def _surfaces(x):
    from ..functions.ids import encode_surface

    tri = x.cand.select("volume_id", "layer_id", "module_id").distinct()
    gid = encode_surface("volume_id", "layer_id", "module_id")
    measured = tri.where("module_id % 2 = 0").select((gid + 3).alias("geometry_id"))
    return t.surface_map(measured, tri.select(gid.alias("geometry_id")))


@check("surface_id_translation", "volume_id layer_id module_id true_gid:l", f"SELECT volume_id, layer_id, module_id, {_GID} AS true_gid FROM surface_ids", "surface_ids")
def _(x):
    return _surfaces(x)


_WORK = f"""
  SELECT l.event_id, l.seed_id, l.step_k, c.state_class, m.pid AS majority_pid,
         last_value(gid IGNORE NULLS) OVER w AS geometry_id, last_value(CASE WHEN gid IS NOT NULL THEN theta END IGNORE NULLS) OVER w AS par0,
         last_value(CASE WHEN gid IS NOT NULL THEN err END IGNORE NULLS) OVER w AS e0
  FROM (SELECT o.event_id, o.seed_id, o.step_k, coalesce(theta_flt, theta_prt) AS theta, coalesce(err_flt, err_prt) AS err, g.gid
        FROM locations o LEFT JOIN (SELECT *, {_GID} AS gid FROM surface_ids) g USING (volume_id, layer_id, module_id)) l
  JOIN classes c USING (event_id, seed_id, step_k)
  JOIN (SELECT event_id, seed_id, max(branch_majority_pid) AS pid FROM cand GROUP BY 1, 2) m USING (event_id, seed_id)
  WINDOW w AS (PARTITION BY l.event_id, l.seed_id ORDER BY l.step_k)"""


def _worklist(x):
    states = t.filtered_else_predicted(x.locations, ["theta", "err"])
    majority = x.cand.groupBy("event_id", "seed_id").agg(F.max("branch_majority_pid").alias("branch_majority_pid"))
    return t.worklist(x.classes, states, _surfaces(x), majority, ["theta"], ["err"], width=WIDTH)


_KEPT = f"""SELECT event_id, seed_id, step_k, geometry_id, par0, e0 * e0 AS var0, majority_pid FROM ({_WORK}) z
            WHERE state_class IN ('tip', 'divergence') AND majority_pid >= 0 AND geometry_id IS NOT NULL"""


@check(
    "rollout_worklist",
    "event_id rollout_id:l seed_id step_k geometry_id:l par0:d var0:d majority_pid:l",
    f"SELECT row_number() OVER (PARTITION BY event_id ORDER BY seed_id, step_k) - 1 AS rollout_id, * FROM ({_KEPT}) k",
    "locations surface_ids classes cand",
)
def _(x):
    return number_worklist(_worklist(x)[0])


@check(
    "worklist_join_report",
    "n_states:l n_missing_parameters:l n_missing_surface:l n_kept:l",
    f"""SELECT count(*) AS n_states, count(CASE WHEN par0 IS NULL THEN 1 END) AS n_missing_parameters,
               count(CASE WHEN geometry_id IS NULL THEN 1 END) AS n_missing_surface, count(geometry_id) AS n_kept
        FROM ({_WORK}) z WHERE state_class IN ('tip', 'divergence') AND majority_pid >= 0""",
    "locations surface_ids classes cand",
)
def _(x):
    return _worklist(x)[1]


@check(
    "filtered_else_predicted",
    "event_id seed_id step_k theta:d err:d",
    "SELECT event_id, seed_id, step_k, coalesce(theta_flt, theta_prt) AS theta, coalesce(err_flt, err_prt) AS err FROM locations",
    "locations",
)
def _(x):
    return t.filtered_else_predicted(x.locations, ["theta", "err"])


# Rollout hits: lines of an order stand for the hits found from a start state.
view("rollout_hits", plain=True)(
    """
    SELECT CAST(year(l_shipdate) AS BIGINT) AS event_id, l_suppkey * 12 + month(l_shipdate) - 1 AS rollout_id,
           CASE WHEN l_quantity > 30 THEN l_partkey ELSE -1 END AS meas_id, l_quantity
    FROM {t:lineitem}
    """
)
view("work", "classes")(
    """
    SELECT event_id, seed_id * 12 + step_k AS rollout_id, seed_id, step_k FROM classes
    WHERE state_class IN ('tip', 'divergence') AND (seed_id + event_id) % 13 <> 0
    """
)
_FUT = """SELECT h.event_id, h.rollout_id, w.seed_id, w.step_k, count(CASE WHEN meas_id >= 0 THEN 1 END) AS n_findable,
                 count(CASE WHEN meas_id < 0 THEN 1 END) AS n_future_holes
          FROM rollout_hits h LEFT JOIN work w ON w.event_id = h.event_id AND w.rollout_id = h.rollout_id GROUP BY 1, 2, 3, 4"""


@check(
    "rollout_futures",
    "event_id rollout_id seed_id step_k n_findable:l n_future_holes:l",
    _FUT,
    "rollout_hits work",
)
def _(x):
    return t.rollout_futures(x.rollout_hits, x.work)


_ROLL = f"""
  joined AS (
    SELECT c.event_id, c.seed_id, c.step_k, state_class, sel_hit, f.n_findable, p.n_correct, p.n_wrong, k.n_total,
           state_class IN ('tip', 'divergence') AS anchor
    FROM classes c
    LEFT JOIN ({_FUT}) f ON f.event_id = c.event_id AND f.seed_id = c.seed_id AND f.step_k = c.step_k
    LEFT JOIN (SELECT event_id, seed_id, step_k, sum(sel_correct) OVER w AS n_correct, sum(sel_wrong) OVER w AS n_wrong
               FROM steps WHERE seed_id % 17 <> 0 WINDOW w AS (PARTITION BY event_id, seed_id ORDER BY step_k)) p
      ON p.event_id = c.event_id AND p.seed_id = c.seed_id AND p.step_k = c.step_k
    LEFT JOIN (SELECT DISTINCT s.event_id, seed_id, n_total FROM steps s JOIN totals t
               ON t.event_id = s.event_id AND t.particle_id = s.branch_majority_pid) k
      ON k.event_id = c.event_id AND k.seed_id = c.seed_id
  ),
  judged AS (
    SELECT event_id, seed_id, count(*) AS n,
           CASE WHEN count(CASE WHEN anchor AND n_findable IS NULL THEN 1 END) > 0 THEN 'missing_rollout'
                WHEN count(CASE WHEN n_correct IS NULL THEN 1 END) > 0 THEN 'missing_past'
                WHEN count(CASE WHEN coalesce(n_total, 0) <= 0 THEN 1 END) > 0 THEN 'missing_total' END AS reason
    FROM joined GROUP BY 1, 2
  ),
  seg AS (
    SELECT j.*, sum(CASE WHEN anchor THEN 1 ELSE 0 END) OVER w AS seg, lag(sel_hit) OVER w AS child
    FROM joined j JOIN judged g USING (event_id, seed_id) WHERE g.reason IS NULL
    WINDOW w AS (PARTITION BY j.event_id, j.seed_id ORDER BY step_k DESC)
  ),
  found AS (
    SELECT *, first_value(n_findable) OVER w + sum(CASE WHEN NOT anchor AND child >= 0 THEN 1 ELSE 0 END) OVER w AS full_
    FROM seg WINDOW w AS (PARTITION BY event_id, seed_id, seg ORDER BY step_k DESC)
  ),
  rolled AS (
    SELECT event_id, seed_id, step_k, full_ AS n_findable_full,
           greatest(0e0, least(1e0, (n_correct + full_) * 1e0 / n_total,
             CASE WHEN n_correct + n_wrong + full_ > 0 THEN (n_correct + full_) * 1e0 / (n_correct + n_wrong + full_) ELSE 0e0 END)) AS vstar_rollout
    FROM found
  )"""


def _rollout(x):
    past = t.past_counts(x.cand)
    totals = x.steps.select("event_id", "seed_id", F.col("branch_majority_pid").alias("particle_id")).distinct()
    totals = totals.join(x.totals, ["event_id", "particle_id"], "inner")
    return t.rollout_targets(x.classes, t.rollout_futures(x.rollout_hits, x.work), past, totals, width=WIDTH, open_ends=True)


_RV = "rollout_hits work steps totals"


@check(
    "rollout_targets",
    "event_id seed_id step_k n_findable_full:l vstar_rollout:d",
    f"SELECT * FROM (WITH {_ROLL} SELECT * FROM rolled) z",
    _RV,
)
def _(x):
    return _rollout(x)[0]


@check(
    "rollout_drop_report",
    "reason n_branches:l n_states:l",
    f"""SELECT * FROM (WITH {_ROLL} SELECT reason, count(*) AS n_branches, sum(n) AS n_states FROM judged
        WHERE reason IS NOT NULL GROUP BY reason) z""",
    _RV,
)
def _(x):
    return _rollout(x)[1]


@check(
    "truth_suffix_check",
    "n_states_compared:l disagree_rate:d mean_abs_diff:d max_abs_diff:d p50_abs_diff:d p90_abs_diff:d p99_abs_diff:d n_suffix_branches:l",
    f"""SELECT * FROM (WITH {_ROLL},
          tg AS ({_TARGETS}),
          ok AS (SELECT event_id, seed_id FROM classes GROUP BY 1, 2 HAVING count(CASE WHEN state_class = 'divergence' THEN 1 END) <= 0),
          d AS (SELECT abs(vstar_rollout - vstar_t2) AS d FROM rolled JOIN ok USING (event_id, seed_id)
                JOIN tg USING (event_id, seed_id, step_k))
        SELECT count(d) AS n_states_compared, avg(CASE WHEN d > 0.01 THEN 1e0 ELSE 0e0 END) AS disagree_rate, avg(d) AS mean_abs_diff,
               max(d) AS max_abs_diff, quantile_cont(d, 0.5) AS p50_abs_diff, quantile_cont(d, 0.9) AS p90_abs_diff,
               quantile_cont(d, 0.99) AS p99_abs_diff, (SELECT count(*) FROM ok) AS n_suffix_branches FROM d) z""",
    _RV,
)
def _(x):
    return t.suffix_check(x.classes, _rollout(x)[0], t.logged_targets(x.steps, x.totals))


@check(
    "attach_rollout_targets",
    "event_id seed_id step_k vstar_rollout:d window_nsigma:d",
    f"""SELECT * FROM (WITH {_ROLL} SELECT s.event_id, s.seed_id, s.step_k, vstar_rollout, 7e0 AS window_nsigma
        FROM steps s JOIN rolled USING (event_id, seed_id, step_k)) z""",
    _RV,
)
def _(x):
    return t.attach_targets(x.steps, _rollout(x)[0], 7.0)[0]


@check(
    "rollout_window_comparison",
    "n_rollouts:l n_unpaired:l n_decreased:l n_increased:l",
    """SELECT count(*) AS n_rollouts, count(CASE WHEN a IS NULL OR b IS NULL THEN 1 END) AS n_unpaired,
              count(CASE WHEN a > b THEN 1 END) AS n_decreased, count(CASE WHEN a < b THEN 1 END) AS n_increased
       FROM (SELECT event_id, rollout_id, count(CASE WHEN meas_id >= 0 AND l_quantity > 40 THEN 1 END) AS a FROM rollout_hits
             WHERE l_quantity > 5 GROUP BY 1, 2) n
       FULL JOIN (SELECT event_id, rollout_id, count(CASE WHEN meas_id >= 0 THEN 1 END) AS b FROM rollout_hits GROUP BY 1, 2) w
       USING (event_id, rollout_id)""",
    "rollout_hits",
)
def _(x):
    h = x.rollout_hits.withColumns({"seed_id": F.lit(0), "step_k": F.lit(0)})
    work = h.select("event_id", "rollout_id", "seed_id", "step_k").distinct()
    shut = F.when(F.col("l_quantity") > 40, F.col("meas_id")).otherwise(F.lit(-1))
    narrow = t.rollout_futures(h.where("l_quantity > 5").withColumn("meas_id", shut), work)
    return t.compare_rollout_windows(narrow, t.rollout_futures(h, work))


@check(
    "rollout_coverage",
    "event_id n_rollouts:l n_findable:l is_missing:b is_empty:b",
    """SELECT m.event_id, coalesce(n, 0) AS n_rollouts, coalesce(s, 0) AS n_findable, n IS NULL AS is_missing, coalesce(s = 0, false) AS is_empty
       FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS event_id FROM orders) m
       LEFT JOIN (SELECT event_id, count(DISTINCT rollout_id) AS n, sum(CASE WHEN meas_id >= 0 AND event_id <> 1997 THEN 1 ELSE 0 END) AS s
                  FROM rollout_hits WHERE event_id <> 1996 GROUP BY 1) f USING (event_id)""",
    "rollout_hits",
)
def _(x):
    manifest = x.table("orders").select(F.year("o_orderdate").cast("long").alias("event_id"))
    h = x.rollout_hits.where("event_id <> 1996").withColumn(
        "meas_id", F.when(F.col("event_id") != 1997, F.col("meas_id")).otherwise(F.lit(-1))
    )
    work = h.select("event_id", "rollout_id", F.lit(0).alias("seed_id"), F.lit(0).alias("step_k")).distinct()
    return t.rollout_coverage(manifest, t.rollout_futures(h, work))
