"""Sampling, scoring, selection, stopping and the re-aimed fit."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import sampling as s
from ..operators import scoring as m
from .registry import check
from .sqltext import MEMBER, STATE
from .views import view

KEYS = STATE.replace(",", "")
HIDDEN, DIM = 4, 64


def _w(i: int, j: int) -> float:
    return round(math.sin(1.0 + 3 * i + 7 * j), 6)


def _model() -> m.Mlp:
    w0 = np.array([[_w(i, j) for j in range(DIM)] for i in range(HIDDEN)])
    w1 = np.array([[_w(9, i) for i in range(HIDDEN)]])
    b0, b1 = np.array([_w(5, i) for i in range(HIDDEN)]), np.array([0.25])
    names = tuple(f"e{j}" for j in range(DIM))
    return m.Mlp(names, (0.01,) * DIM, (0.125,) * DIM, (w0, w1), (b0, b1))


def _layers(spark, model: m.Mlp):
    rows = []
    for k, (w, b) in enumerate(zip(model.weights, model.biases)):
        rows += [(k, i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
        rows += [(k, i, -1, float(v)) for i, v in enumerate(b)]
    stats = [(i, n, model.mu[i], model.sigma[i]) for i, n in enumerate(model.features)]
    return (
        spark.createDataFrame(rows, "layer int, row int, col int, value double"),
        spark.createDataFrame(stats, "position int, feature string, mu double, sigma double"),
    )


def _hidden(i: int) -> str:
    terms = " + ".join(f"((CAST(embedding[{j + 1}] AS DOUBLE) - 1e-2) / 125e-3) * {_w(i, j)!r}::DOUBLE" for j in range(DIM))
    return f"({terms} + {_w(5, i)!r}::DOUBLE)"


_MLP = f"""SELECT vec_id, {' + '.join(f'h{i} / (1e0 + exp(-h{i})) * {_w(9, i)!r}::DOUBLE' for i in range(HIDDEN))} + 25e-2 AS logit
           FROM (SELECT vec_id, {', '.join(f'{_hidden(i)} AS h{i}' for i in range(HIDDEN))} FROM embeddings) h"""


@check("mlp_scores", "vec_id logit:d", _MLP)
def _(x):
    e = x.table("embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(DIM)])
    return m.score(wide, m.mlp_from_table(*_layers(x.spark, _model())))


@check(
    "mlp_scores_calibrated",
    "vec_id prob:d",
    f"SELECT vec_id, 1e0 / (1e0 + exp(-((9e-1 + 5e-2 * ln(1 + vec_id % 7)) * logit - 1e-1 - 2e-2 * ln(1 + vec_id % 7)))) AS prob FROM ({_MLP}) s",
)
def _(x):
    from ..functions.stats import platt_occupancy

    e = x.table("embeddings")
    wide = e.select("vec_id", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(DIM)])
    n = F.lit(1) + F.col("vec_id") % 7
    return m.score(wide, _model()).withColumn("prob", platt_occupancy("logit", n, (0.9, 0.05, -0.1, -0.02)))


# --- sampling -----------------------------------------------------------------------------------

view("pool")(
    """
    SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 1e4 END AS chi2
    FROM {t:orders}
    """
)
_SAMPLE_COUNTS = "n_rows:l n_pos:l n_neg:l n_unknown:l"


def _sample_counts(d):
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("y") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_neg"),
        F.count(F.when(F.col("row_id").isNull(), 1)).alias("n_unknown"),
    )


_COUNT_SQL = "SELECT 4 * p AS n_rows, p AS n_pos, 3 * p AS n_neg, 0 AS n_unknown FROM (SELECT sum(y) AS p FROM pool) a"


@check("uniform_subsample_counts", _SAMPLE_COUNTS, _COUNT_SQL, "pool")
def _(x):
    return _sample_counts(s.uniform_subsample(x.pool, "y", "row_id", 3, seed=7))


@check("hard_negative_subsample_counts", _SAMPLE_COUNTS, _COUNT_SQL, "pool")
def _(x):
    return _sample_counts(s.weighted_subsample(x.pool, "y", "row_id", s.hard_weight("chi2"), 3, seed=7))


_DRAWN_SQL = """
    WITH neg AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i FROM pool WHERE y = 0),
    draws AS (
        SELECT least(floor(u * n), n - 1) AS i
        FROM (SELECT CAST('0x' || substr(md5('7|' || row_id || '|' || rep), 1, 13) AS BIGINT) / 4503599627370496e0 AS u
              FROM pool, (SELECT unnest(range(1, 4)) AS rep) r WHERE y = 1) h, (SELECT count(*) AS n FROM neg) c
    )
    SELECT row_id, 0 AS y, count(*) AS copies FROM draws JOIN neg USING (i) GROUP BY 1
    UNION ALL SELECT row_id, 1 AS y, count(*) AS copies FROM pool WHERE y = 1 GROUP BY 1
"""


@check("uniform_subsample", "row_id y:l copies:l", _DRAWN_SQL, "pool")
def _(x):
    return s.uniform_subsample(x.pool, "y", "row_id", 3, seed=7).groupBy("row_id", "y").agg(F.count(F.lit(1)).alias("copies"))


_WEIGHTED_SQL = """
    WITH neg AS (
        SELECT row_id, w, sum(w) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS w_before
        FROM (SELECT row_id, CAST(greatest(floor(1e0 / greatest(chi2, 1e-3) * 1048576e0), 1) AS HUGEINT) AS w FROM pool WHERE y = 0 AND chi2 IS NOT NULL) u
    ),
    draws AS (
        SELECT CAST('0x' || substr(md5('7|' || row_id || '|' || rep), 1, 13) AS HUGEINT) * (SELECT sum(w) FROM neg) // 4503599627370496 AS spot
        FROM pool, (SELECT unnest(range(1, 4)) AS rep) r WHERE y = 1
    )
    SELECT row_id, 0 AS y, count(*) AS copies FROM draws JOIN neg ON spot >= w_before AND spot < w_before + w GROUP BY 1
    UNION ALL SELECT row_id, 1 AS y, count(*) AS copies FROM pool WHERE y = 1 GROUP BY 1
"""


@check("hard_negative_subsample", "row_id y:l copies:l", _WEIGHTED_SQL, "pool")
def _(x):
    d = s.weighted_subsample(x.pool, "y", "row_id", s.hard_weight("chi2"), 3, seed=7)
    return d.groupBy("row_id", "y").agg(F.count(F.lit(1)).alias("copies"))


@check(
    "hard_negatives_never_weightless",
    "n_weightless:l",
    f"SELECT count(CASE WHEN p.chi2 IS NULL THEN 1 END) AS n_weightless FROM (SELECT * FROM ({_WEIGHTED_SQL}) d WHERE y = 0) d JOIN pool p USING (row_id)",
    "pool",
)
def _(x):
    d = s.weighted_subsample(x.pool, "y", "row_id", s.hard_weight("chi2"), 3, seed=7)
    return d.where("y = 0").agg(F.count(F.when(F.col("chi2").isNull(), 1)).alias("n_weightless"))


@check(
    "prior_logit_shift",
    "n_pos_orig:l n_neg_orig:l n_pos_new:l n_neg_new:l prior_logit_shift:d",
    """SELECT p AS n_pos_orig, n AS n_neg_orig, p AS n_pos_new, 3 * p AS n_neg_new, ln(1e0 / 3) - ln(p * 1e0 / n) AS prior_logit_shift
       FROM (SELECT sum(y) AS p, sum(1 - y) AS n FROM pool) a""",
    "pool",
)
def _(x):
    return s.class_counts(x.pool, s.uniform_subsample(x.pool, "y", "row_id", 3), "y")


_W = "SELECT CASE WHEN chi2 IS NULL THEN 0e0 ELSE 1e0 / greatest(chi2, 1e-3) END AS w FROM pool WHERE y = 0"


@check(
    "draw_diagnostics",
    "n_take:l n_pool:l expected_distinct:d coverage:d max_expected_copies:d top1_mass:d top1000_mass:d kish_ess:d",
    f"""SELECT 5000 AS n_take, count(*) AS n_pool, sum(1 - pow(1 - w / t, 5000)) AS expected_distinct, sum(1 - pow(1 - w / t, 5000)) / 5000 AS coverage,
               max(w / t) * 5000 AS max_expected_copies, max(w / t) AS top1_mass, sum(CASE WHEN rn <= 1000 THEN w / t END) AS top1000_mass,
               sum(w) * sum(w) / sum(w * w) AS kish_ess
        FROM (SELECT w, sum(w) OVER () AS t, row_number() OVER (ORDER BY w DESC) AS rn FROM ({_W}) a WHERE w > 0) b""",
    "pool",
)
def _(x):
    return s.draw_diagnostics(x.pool.where("y = 0"), s.hard_weight("chi2"), 5000)


@check(
    "marginal_oversampling",
    "y:l n:l",
    "SELECT y, sum(CASE WHEN chi2 BETWEEN 5 AND 10 THEN 4 ELSE 1 END) AS n FROM pool GROUP BY y",
    "pool",
)
def _(x):
    marginal = F.coalesce(F.col("chi2").between(5, 10), F.lit(False))
    return s.oversample(x.pool, marginal, 3).groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@check(
    "unambiguous_rows",
    f"{KEYS} cand_hit_id",
    f"SELECT {STATE}, cand_hit_id FROM cand WHERE coalesce(len(contrib_pids), 0) <= 1",
    "cand",
)
def _(x):
    from ..functions.strata import label_columns

    return s.drop_ambiguous(x.cand.withColumn("label_ambiguous", label_columns()["label_ambiguous"]))


@check(
    "soft_label_rows",
    "label:d n:l weight:d",
    """SELECT label, count(*) AS n, sum(weight) AS weight FROM (
         SELECT 1e0 AS label, target AS weight FROM scores UNION ALL SELECT 0e0, 1 - target FROM scores) u WHERE weight > 0 GROUP BY label""",
    "scores",
)
def _(x):
    return s.soft_label_rows(x.scores.select("target", "logit"), "target").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")
    )


# --- selection ---------------------------------------------------------------------------------------

_SCORED = """SELECT *, exp(-coalesce(chi2_inc, 1e3) / 2e1) AS score, coalesce(abs(residual_l0) <= 15 * sqrt(S00), false) AS inw FROM cand"""


def _scored(x):
    score = F.exp(-F.coalesce("chi2_inc", F.lit(1e3)) / 20)
    return x.cand.withColumn("score", score), F.coalesce(F.abs("residual_l0") <= 15 * F.sqrt("S00"), F.lit(False))


@check(
    "gate_selection",
    f"{KEYS} cand_hit_id",
    f"""SELECT {STATE}, cand_hit_id FROM (SELECT *, row_number() OVER (PARTITION BY {STATE} ORDER BY score DESC, cand_hit_id) AS rn
          FROM ({_SCORED}) s WHERE cand_hit_id <> -1 AND inw AND score >= 2e-1) r WHERE rn <= 2""",
    "cand",
)
def _(x):
    d, w = _scored(x)
    return m.select_candidates(d, "score", 0.2, 2, w)


_OUT = f"""SELECT {STATE}, n_candidates, n_in_window, n_passed, sa, sr, mx,
                  CASE WHEN n_candidates = 0 THEN 'no_measurements' WHEN n_in_window = 0 THEN 'window_failure' WHEN n_passed = 0 THEN 'gate_failure' END AS hole_cause
           FROM (SELECT {STATE}, count(CASE WHEN cand_hit_id <> -1 THEN 1 END) AS n_candidates, count(CASE WHEN cand_hit_id <> -1 AND inw THEN 1 END) AS n_in_window,
                        count(CASE WHEN cand_hit_id <> -1 AND inw AND score >= 2e-1 THEN 1 END) AS n_passed,
                        sum(CASE WHEN cand_hit_id <> -1 AND inw AND score >= 2e-1 THEN chi2_inc END) AS sa,
                        sum(CASE WHEN cand_hit_id <> -1 AND inw AND score < 2e-1 THEN chi2_inc END) AS sr,
                        max(CASE WHEN cand_hit_id <> -1 AND inw AND score >= 2e-1 THEN chi2_inc END) AS mx
                 FROM ({_SCORED}) s GROUP BY {STATE}) g"""


@check("gate_outcome", f"{KEYS} n_candidates:l n_in_window:l n_passed:l hole_cause", _OUT, "cand")
def _(x):
    d, w = _scored(x)
    return m.selection_outcome(d, "score", 0.2, w)


@check(
    "gate_counters",
    "event_id n_accepted:l n_rejected:l n_prefiltered:l n_hole_no_measurements:l n_hole_window_failure:l n_hole_gate_failure:l "
    "sum_chi2_accepted:d sum_chi2_rejected:d max_chi2_accepted:d",
    f"""SELECT event_id, sum(n_passed) AS n_accepted, sum(n_in_window - n_passed) AS n_rejected, sum(n_candidates - n_in_window) AS n_prefiltered,
               count(CASE WHEN hole_cause = 'no_measurements' THEN 1 END) AS n_hole_no_measurements,
               count(CASE WHEN hole_cause = 'window_failure' THEN 1 END) AS n_hole_window_failure,
               count(CASE WHEN hole_cause = 'gate_failure' THEN 1 END) AS n_hole_gate_failure,
               coalesce(sum(sa), 0) AS sum_chi2_accepted, coalesce(sum(sr), 0) AS sum_chi2_rejected, max(mx) AS max_chi2_accepted
        FROM ({_OUT}) o GROUP BY event_id""",
    "cand",
)
def _(x):
    d, w = _scored(x)
    return m.selection_counters(m.selection_outcome(d, "score", 0.2, w))


@check(
    "branch_stop_decision",
    "event_id seed_id branch_id n_states:l stop_step:l decision",
    """SELECT event_id, seed_id, branch_id, count(*) AS n_states, min(CASE WHEN bad THEN step_k END) AS stop_step,
              CASE WHEN min(CASE WHEN bad THEN step_k END) IS NULL THEN 'continue'
                   WHEN arg_min(n_hits, step_k) FILTER (WHERE bad) >= 6 THEN 'stop_keep' ELSE 'stop_drop' END AS decision
       FROM (SELECT event_id, seed_id, branch_id, step_k, n_hits, n_hits >= 3 AND p < 45e-2 AS bad
             FROM (SELECT DISTINCT event_id, seed_id, branch_id, step_k, n_hits, ((seed_id * 31 + step_k * 17 + event_id) % 100) / 1e2 AS p FROM cand) a) b
       GROUP BY 1, 2, 3""",
    "cand",
)
def _(x):
    st = x.cand.select(*KEYS.split(), "n_hits").distinct()
    p = ((F.col("seed_id") * 31 + F.col("step_k") * 17 + F.col("event_id")) % 100) / 100
    return m.stop_decision(st.withColumn("p", p), "p", 0.45)


# The optimum of the unpenalised fit has a vanishing gradient.
@check(
    "logit_fit_gradient",
    "n:l g_logit:d g_occ:d g_bias:d",
    "SELECT count(*) AS n, 0e0 AS g_logit, 0e0 AS g_occ, 0e0 AS g_bias FROM scores",
    "scores",
)
def _(x):
    from ..functions.stats import sigmoid

    d = x.scores.select("logit", F.col("n_window").cast("double").alias("occ"), "label")
    w, b, _ = m.fit_logit(d, d, ["logit", "occ"], penalties=(0.0,))
    r = sigmoid(m.linear_logit(["logit", "occ"], w, b)) - F.col("label")
    near = lambda e: F.round(F.avg(e), 4)
    return d.agg(
        F.count(F.lit(1)).alias("n"),
        near(r * F.col("logit")).alias("g_logit"),
        near(r * F.col("occ")).alias("g_occ"),
        near(r).alias("g_bias"),
    )


@check("soft_label_fit", "feature weight:d")
def _(x):
    d = x.scores.select("logit", F.col("n_window").cast("double").alias("occ"), "target")
    soft = s.soft_label_rows(d, "target")
    w, b, _ = m.fit_logit(soft, d.withColumnRenamed("target", "label"), ["logit", "occ"], weight="weight")
    # One row per feature of the model, next to the number of training rows it came from.
    names = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("weight")) for n, v in zip(["logit", "occ", "bias"], [*w, b])])
    return soft.agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("r")).select("r.*")


@check(
    "soft_label_likelihood",
    "weight:d loss:d g_logit:d g_occ:d g_bias:d",
    """SELECT count(*) AS weight, avg(ln(1e0 + exp(z)) - target * z) AS loss, avg((1e0 / (1e0 + exp(-z)) - target) * logit) AS g_logit,
              avg((1e0 / (1e0 + exp(-z)) - target) * n_window) AS g_occ, avg(1e0 / (1e0 + exp(-z)) - target) AS g_bias
       FROM (SELECT *, 4e-1 * logit - 5e-2 * n_window + 1e-1 AS z FROM scores WHERE target IS NOT NULL) a""",
    "scores",
)
def _(x):
    # Two weighted rows for each soft target say the same as the target itself.
    d = x.scores.select("logit", F.col("n_window").cast("double").alias("occ"), "target")
    return m.logit_likelihood(s.soft_label_rows(d, "target"), ["logit", "occ"], [0.4, -0.05], 0.1, weight="weight")


# --- traces ----------------------------------------------------------------------------------------------


@check(
    "gate_choice_quality",
    "step_k n:l mean_ratio:d chose_best:d mean_acc_chi2:d mean_min_chi2:d median_ratio:d",
    f"""SELECT step_k, count(*) AS n, avg(a / greatest(b, 1e-6)) AS mean_ratio, avg(CASE WHEN abs(a - b) < 1e-2 THEN 1e0 ELSE 0e0 END) AS chose_best,
               avg(a) AS mean_acc_chi2, avg(b) AS mean_min_chi2, quantile_cont(a / greatest(b, 1e-6), 0.5) AS median_ratio
        FROM (SELECT {STATE}, min(CASE WHEN (cand_hit_id + step_k) % 3 = 0 THEN chi2_inc END) AS a, min(chi2_inc) AS b FROM cand GROUP BY {STATE}) s
        WHERE a IS NOT NULL GROUP BY step_k""",
    "cand",
)
def _(x):
    return m.gate_choice_quality(x.cand.withColumn("acc", (F.col("cand_hit_id") + F.col("step_k")) % 3 == 0), "acc")


@check(
    "chi2_quantiles_by_step",
    "step_k which q:d value:d",
    " UNION ALL ".join(
        f"""SELECT step_k, '{which}' AS which, {q} AS q, quantile_cont(chi2_inc, {q}) AS value FROM cand
            WHERE chi2_inc IS NOT NULL {cond} GROUP BY step_k"""
        for which, cond in (("all", ""), ("accepted", "AND is_ckf_selected"))
        for q in (0.25, 0.5, 0.9)
    ),
    "cand",
)
def _(x):
    return m.chi2_quantiles(x.cand, "is_ckf_selected", [0.25, 0.5, 0.9])


_DRIFT = {"n_window": (2.0, 1.5), "state_theta": (1.5, 0.05), "pathInX0_interval": (0.03, 0.0)}


@check(
    "feature_drift",
    "feature emp_mean:d emp_std:d std_ratio:d frac_z_gt_3:d frac_z_gt_5:d frac_z_gt_10:d matches:b median_z:d",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, avg({n}) AS emp_mean, stddev_pop({n}) AS emp_std,
                   {f'stddev_pop({n}) / {sd}::DOUBLE' if sd else 'NULL'} AS std_ratio,
                   {', '.join((f'avg(CASE WHEN abs(({n} - {mu}::DOUBLE) / {sd}::DOUBLE) > {k} THEN 1e0 ELSE 0e0 END)' if sd else 'NULL') + f' AS frac_z_gt_{k}' for k in (3, 5, 10))},
                   {f'stddev_pop({n}) / {sd}::DOUBLE BETWEEN 1e-1 AND 1e1' if sd else 'false'} AS matches,
                   {f'quantile_cont(({n} - {mu}::DOUBLE) / {sd}::DOUBLE, 0.5)' if sd else 'NULL'} AS median_z FROM cand"""
        for n, (mu, sd) in _DRIFT.items()
    ),
    "cand",
)
def _(x):
    return m.feature_drift(x.cand, _DRIFT)


@check(
    "acceptance_by_volume",
    "volume_id n:l n_pos:l n_acc:l n_acc_pos:l mean_score:d acceptance:d purity:d recall:d",
    f"""SELECT volume_id, count(*) AS n, sum(y) AS n_pos, count(CASE WHEN p >= 5e-1 THEN 1 END) AS n_acc, count(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 END) AS n_acc_pos,
               avg(p) AS mean_score, count(CASE WHEN p >= 5e-1 THEN 1 END) * 1e0 / count(*) AS acceptance,
               coalesce(count(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 END) * 1e0 / nullif(count(CASE WHEN p >= 5e-1 THEN 1 END), 0), 0) AS purity,
               coalesce(count(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 END) * 1e0 / nullif(sum(y), 0), 0) AS recall
        FROM (SELECT volume_id, exp(-chi2_inc / 2e1) AS p, CAST({MEMBER} AS INT) AS y FROM cand WHERE cand_hit_id <> -1) a GROUP BY volume_id""",
    "cand",
)
def _(x):
    from ..functions.strata import label_columns
    from ..operators.failure import volume_scores

    d = x.cand.where("cand_hit_id <> -1").select(
        "volume_id", F.exp(-F.col("chi2_inc") / 20).alias("p"), label_columns()["label_same_particle"].alias("y")
    )
    return volume_scores(d, "p", "y")
