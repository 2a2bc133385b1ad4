"""Reliability, calibration errors, curves, audits and Platt fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import logit_edges, platt
from ..operators import calibration as c
from ..operators import platt as p
from .registry import check
from .sqltext import CHI2P, EDGES30, OCC_LABEL, bucket, wilson95
from .views import view

B30 = bucket("prob", EDGES30[1:-1])
_REL_COLS = "bin:l bin_lo:d bin_hi:d mean_predicted:d observed_fraction:d count:l n_positive:l ci_lower:d ci_upper:d sparse:b"


def _edge_rows(edges, geometric=True) -> str:
    rows = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        mid = (max(lo, 1e-300) * max(hi, 1e-300)) ** 0.5 if geometric else 0.5 * (lo + hi)
        rows.append(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE, {mid!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) e(bin, bin_lo, bin_hi, midpoint)"


def _reliability_sql(source: str, edges, by: str = "", binned: str = B30, min_count: int = 100) -> str:
    strata = f"CROSS JOIN (SELECT DISTINCT {by} FROM {source}) st" if by else ""
    using = f"({by}, bin)" if by else "(bin)"
    cols = f"{by}, " if by else ""
    lo, hi = wilson95("k", "n")
    return f"""
    SELECT {cols}bin, bin_lo, bin_hi, mean_predicted, CASE WHEN n > 0 THEN k * 1e0 / n ELSE 0e0 END AS observed_fraction,
           n AS count, k AS n_positive, {lo} AS ci_lower, {hi} AS ci_upper, n < {min_count} AS sparse
    FROM (SELECT {cols}bin, bin_lo, bin_hi, coalesce(sp / n, midpoint) AS mean_predicted, coalesce(n, 0) AS n, coalesce(k, 0) AS k
          FROM {_edge_rows(edges)} {strata}
          LEFT JOIN (SELECT {cols}{binned} AS bin, count(*) AS n, sum(label) AS k, sum(prob) AS sp FROM {source} GROUP BY ALL) s
          USING {using}) a"""


@check("reliability_log_odds_bins", _REL_COLS, _reliability_sql("scores", EDGES30), "scores")
def _(x):
    return c.reliability(x.scores, "prob", "label")


@check(
    "reliability_by_occupancy",
    f"occ {_REL_COLS}",
    _reliability_sql(f"(SELECT *, {OCC_LABEL} AS occ FROM scores) q", EDGES30, by="occ"),
    "scores",
)
def _(x):
    from ..functions.strata import occupancy_stratum

    return c.reliability(x.scores.withColumn("occ", occupancy_stratum("n_window")), "prob", "label", by=["occ"])


def _errors_sql(source: str, by: str = "", binned: str = B30) -> str:
    cols = f"{by}, " if by else ""
    return f"""
    SELECT {cols}sum(n) AS n_rows, sum(gap * n) / sum(n) AS ece, coalesce(max(CASE WHEN n >= 100 THEN gap END), 0) AS mce,
           arg_max(n, gap) FILTER (WHERE n >= 100) AS worst_bin_count, count(CASE WHEN n >= 100 THEN 1 END) AS n_bins_eligible,
           coalesce(sum(CASE WHEN n >= 100 THEN n END), 0) AS n_rows_eligible,
           coalesce(sum(CASE WHEN n >= 100 THEN n END), 0) * 1e0 / sum(n) AS frac_rows_eligible
    FROM (SELECT {cols}{binned} AS bin, count(*) AS n, abs(sum(label) * 1e0 / count(*) - sum(prob) / count(*)) AS gap
          FROM {source} GROUP BY ALL) b {f'GROUP BY {by}' if by else ''}"""


_ERR_COLS = "n_rows:l ece:d mce:d worst_bin_count:l n_bins_eligible:l n_rows_eligible:l frac_rows_eligible:d"


@check("calibration_errors", _ERR_COLS, _errors_sql("scores"), "scores")
def _(x):
    return c.calibration_errors(x.scores, "prob", "label")


@check("calibration_errors_by_event", f"event_id {_ERR_COLS}", _errors_sql("scores", "event_id"), "scores")
def _(x):
    return c.calibration_errors(x.scores, "prob", "label", by=["event_id"])


def _region_sql(source: str, lo: float, hi: float, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    e = logit_edges(10, lo, hi)
    return f"""
    SELECT {cols}sum(n) AS n_rows, CASE WHEN sum(n) >= 100 THEN sum(gap) / sum(n) END AS dr_ece,
           CASE WHEN sum(n) >= 100 THEN sum(k) * 1e0 / sum(n) END AS positive_fraction
    FROM (SELECT {cols}{bucket('prob', e[1:-1])} AS bin, count(*) AS n, sum(label) AS k, abs(sum(label) - sum(prob)) AS gap
          FROM {source} WHERE prob >= {lo}e0 AND prob <= {hi}e0 GROUP BY ALL) b {f'GROUP BY {by}' if by else ''}"""


@check("decision_region_error", "n_rows:l dr_ece:d positive_fraction:d", _region_sql("scores", 0.01, 0.99), "scores")
def _(x):
    return c.region_error(x.scores, "prob", "label")


_LIN20 = [i / 20 for i in range(21)]
_SOFT = f"""
  SELECT bin, bin_lo, bin_hi, coalesce(p, midpoint) AS mean_predicted, coalesce(t, 0) AS mean_target, coalesce(n, 0) AS count,
         CASE WHEN n > 0 THEN greatest(0, t - coalesce(1.96e0 * s / sqrt(n), 0)) ELSE 0 END AS ci_lower,
         CASE WHEN n > 0 THEN least(1, t + coalesce(1.96e0 * s / sqrt(n), 0)) ELSE 1 END AS ci_upper, coalesce(n, 0) < 100 AS sparse
  FROM {_edge_rows(_LIN20, False)} LEFT JOIN (
    SELECT {bucket('prob', _LIN20[1:-1])} AS bin, count(*) AS n, avg(prob) AS p, avg(target) AS t, stddev_samp(target) AS s
    FROM scores GROUP BY 1) s USING (bin)"""


@check(
    "soft_reliability",
    "bin:l bin_lo:d bin_hi:d mean_predicted:d mean_target:d count:l ci_lower:d ci_upper:d sparse:b",
    _SOFT,
    "scores",
)
def _(x):
    return c.soft_reliability(x.scores, "prob", "target")


@check(
    "soft_calibration_error",
    "soft_ece:d",
    f"SELECT sum(abs(mean_target - mean_predicted) * count) / sum(count) AS soft_ece FROM ({_SOFT}) s",
    "scores",
)
def _(x):
    return c.soft_calibration_error(c.soft_reliability(x.scores, "prob", "target"))


@check(
    "grid_curves",
    "edge:l threshold_logit:d tp:l fp:l tpr:d fpr:d precision:d",
    """SELECT edge, -20e0 + edge * 1e-1 AS threshold_logit, tp, fp, tp * 1e0 / np AS tpr, fp * 1e0 / nn AS fpr,
              CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) END AS precision
       FROM (SELECT edge, t.np, t.nn, coalesce(sum(p) FILTER (WHERE logit >= -20e0 + edge * 1e-1 AND edge < 400), 0) AS tp,
                    coalesce(sum(q) FILTER (WHERE logit >= -20e0 + edge * 1e-1 AND edge < 400), 0) AS fp
             FROM (SELECT unnest(range(401)) AS edge) g,
                  (SELECT logit, sum(label) AS p, sum(1 - label) AS q FROM scores GROUP BY 1) h,
                  (SELECT sum(label) AS np, sum(1 - label) AS nn FROM scores) t
             GROUP BY 1, 2, 3) a""",
    "scores",
)
def _(x):
    return c.grid_curves(x.scores, "logit", "label", n=400)


def _ranking_sql(source: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
    SELECT {cols}max(np) AS n_pos, max(nn) AS n_neg,
           CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(p * (nn - fp) + 5e-1 * p * n) / (max(np) * 1e0 * max(nn)) END AS auc_roc,
           CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(p * tp * 1e0 / (tp + fp)) / max(np) END AS auc_pr
    FROM (SELECT {cols}p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER ({part}) AS np, sum(n) OVER ({part}) AS nn
          FROM (SELECT {cols}prob, sum(label) AS p, sum(1 - label) AS n FROM {source} GROUP BY ALL) d
          WINDOW w AS ({part} ORDER BY prob DESC)) a {f'GROUP BY {by}' if by else ''}"""


@check("ranking_metrics", "n_pos:l n_neg:l auc_roc:d auc_pr:d", _ranking_sql("scores"), "scores")
def _(x):
    return c.ranking_metrics(x.scores, "prob", "label")


@check("ranking_metrics_by_occupancy", "n_window n_pos:l n_neg:l auc_roc:d auc_pr:d", _ranking_sql("scores", "n_window"), "scores")
def _(x):
    return c.ranking_metrics(x.scores, "prob", "label", by=["n_window"])


_HIST = """SELECT g.bin, coalesce(n, 0) AS count, coalesce(sp, 0) AS sum_prob, coalesce(k, 0) AS sum_label
           FROM (SELECT unnest(range(1000)) AS bin) g LEFT JOIN (
             SELECT least(999, floor(prob / 1e-3)) AS bin, count(*) AS n, sum(prob) AS sp, sum(label) AS k FROM scores GROUP BY 1) h
           ON h.bin = g.bin"""


@check("probability_histogram", "bin:l count:l sum_prob:d sum_label:l", _HIST, "scores")
def _(x):
    return c.probability_histogram(x.scores, "prob", "label")


@check(
    "rebinned_histogram",
    "bin:l bin_lo:d bin_hi:d mean_predicted:d observed_fraction:d count:l n_positive:l ci_lower:d ci_upper:d sparse:b",
    f"""SELECT bin, bin / 2e1 AS bin_lo, (bin + 1) / 2e1 AS bin_hi,
               CASE WHEN n > 0 THEN sp / n ELSE (bin + 5e-1) / 2e1 END AS mean_predicted,
               CASE WHEN n > 0 THEN k * 1e0 / n ELSE 0e0 END AS observed_fraction, n AS count, k AS n_positive,
               CASE WHEN n > 0 THEN {wilson95('k', 'n')[0]} ELSE 0e0 END AS ci_lower,
               CASE WHEN n > 0 THEN {wilson95('k', 'n')[1]} ELSE 0e0 END AS ci_upper, n < 100 AS sparse
        FROM (SELECT CAST(floor(bin / 5e1) AS BIGINT) AS bin, sum(count) AS n, sum(sum_prob) AS sp, sum(sum_label) AS k
              FROM ({_HIST}) h GROUP BY 1) r""",
    "scores",
)
def _(x):
    return c.rebin(c.probability_histogram(x.scores, "prob", "label"), 1000, 20)


view("estimates", "scores")(
    """
    SELECT event_id, label, n_window, eta, 1e0 / (1e0 + exp(-(8e-1 * logit - 3e-1))) AS platt2,
           prob AS raw, CASE WHEN exp(-chi2_inc / 2e0) < 1e-6 THEN 1e-6 ELSE exp(-chi2_inc / 2e0) END AS chi2
    FROM scores
    """
)
_LONG = f"""
  (SELECT label, estimator, prob, family, stratum FROM (
     SELECT label, estimator, prob, 'all' AS family, 'all' AS stratum FROM est
     UNION ALL SELECT label, estimator, prob, 'occupancy', {OCC_LABEL} FROM est
     UNION ALL SELECT label, estimator, prob, 'event', CAST(event_id AS VARCHAR) FROM est) u WHERE stratum IS NOT NULL) lng"""
_EST = """est AS (SELECT *, 'platt2' AS estimator, platt2 AS prob FROM estimates UNION ALL
                  SELECT *, 'raw', raw FROM estimates UNION ALL SELECT *, 'chi2', chi2 FROM estimates)"""
_BY = "estimator, family, stratum"
_AUDIT = f"""
  SELECT {_BY}, e.n_rows, CASE WHEN e.n_rows >= 1000 THEN ece END AS ece, CASE WHEN e.n_rows >= 1000 THEN mce END AS mce,
         CASE WHEN e.n_rows >= 1000 THEN r.dr_ece END AS dr_ece, coalesce(r.n_rows, 0) AS dr_n_rows, e.n_rows < 1000 AS skipped
  FROM ({_errors_sql(_LONG, _BY)}) e LEFT JOIN ({_region_sql(_LONG, 0.01, 0.99, _BY)}) r USING ({_BY})"""


def _audit(x):
    return c.stratified_audit(x.estimates, ["platt2", "raw", "chi2"], _strata(), "label")


@check(
    "stratified_audit",
    "estimator family stratum n_rows:l ece:d mce:d dr_ece:d dr_n_rows:l skipped:b",
    f"SELECT * FROM (WITH {_EST} {_AUDIT}) z",
    "estimates",
)
def _(x):
    return _audit(x)


def _strata():
    from ..functions.strata import occupancy_stratum

    return {"all": F.lit("all"), "occupancy": occupancy_stratum("n_window"), "event": F.col("event_id")}


# Engines differ in the last bits of exp(): rounded, equal scores are equal in both and none lies on an edge of the grid.
_EST9 = _EST.replace("platt2 AS prob", "round(platt2, 9) AS prob").replace("'raw', raw", "'raw', round(raw, 9)").replace("'chi2', chi2", "'chi2', round(chi2, 9)")


def _rounded(x):
    return x.estimates.withColumns({e: F.round(e, 9) for e in ("platt2", "raw", "chi2")})


@check(
    "stratified_metric_bundles",
    "estimator family stratum n_pos:l n_neg:l auc_roc:d auc_pr:d n_rows:l ece:d mce:d dr_n_rows:l dr_ece:d threshold_n_rows:l threshold_ece:d base_rate:d",
    f"""SELECT * FROM (WITH {_EST9}
        SELECT *, n_pos * 1e0 / (n_pos + n_neg) AS base_rate FROM ({_ranking_sql(_LONG, _BY)}) a JOIN ({_errors_sql(_LONG, _BY)}) e USING ({_BY})
        LEFT JOIN (SELECT {_BY}, n_rows AS dr_n_rows, dr_ece FROM ({_region_sql(_LONG, 0.01, 0.99, _BY)}) r) r USING ({_BY})
        LEFT JOIN (SELECT {_BY}, n_rows AS threshold_n_rows, dr_ece AS threshold_ece FROM ({_region_sql(_LONG, 0.01, 0.5, _BY)}) t) t USING ({_BY})) z""",
    "estimates",
)
def _(x):
    return c.stratified_bundles(_rounded(x), ["platt2", "raw", "chi2"], _strata(), "label")


_LOGIT_LONG = _LONG.replace("label, estimator, prob, family, stratum", "label, estimator, ln(prob / (1e0 - prob)) AS logit, family, stratum", 1)


@check(
    "stratified_grid_curves",
    "estimator family stratum edge:l tp:l fp:l tpr:d fpr:d precision:d",
    f"""SELECT * FROM (WITH {_EST9},
          h AS (SELECT {_BY}, greatest(0, least(399, floor((least(20e0, greatest(-20e0, logit)) + 20e0) * 1e1))) AS edge, sum(label) AS p, sum(1 - label) AS q
                FROM {_LOGIT_LONG} GROUP BY ALL),
          g AS (SELECT * FROM (SELECT DISTINCT {_BY} FROM h) k, (SELECT unnest(range(401)) AS edge) e),
          s AS (SELECT {_BY}, g.edge, sum(coalesce(p, 0)) OVER w AS tp, sum(coalesce(q, 0)) OVER w AS fp,
                       sum(coalesce(p, 0)) OVER (PARTITION BY {_BY}) AS np, sum(coalesce(q, 0)) OVER (PARTITION BY {_BY}) AS nn
                FROM g LEFT JOIN h USING ({_BY}, edge) WINDOW w AS (PARTITION BY {_BY} ORDER BY g.edge DESC))
        SELECT {_BY}, edge, tp, fp, CASE WHEN np > 0 THEN tp * 1e0 / np END AS tpr, CASE WHEN nn > 0 THEN fp * 1e0 / nn END AS fpr,
               CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) END AS precision FROM s) z""",
    "estimates",
)
def _(x):
    logits = _rounded(x).withColumns({e: F.log(F.col(e) / (1 - F.col(e))) for e in ("platt2", "raw", "chi2")})
    return c.stratified_curves(logits, ["platt2", "raw", "chi2"], _strata(), "label", n=400)


@check(
    "stratified_probability_histograms",
    "estimator family stratum bin:l count:l sum_prob:d sum_label:l",
    f"""SELECT * FROM (WITH {_EST},
          h AS (SELECT {_BY}, least(99, floor(prob / 1e-2)) AS bin, count(*) AS n, sum(prob) AS sp, sum(label) AS k FROM {_LONG} GROUP BY ALL),
          g AS (SELECT * FROM (SELECT DISTINCT {_BY} FROM h) k, (SELECT unnest(range(100)) AS bin) b)
        SELECT {_BY}, bin, coalesce(n, 0) AS count, coalesce(sp, 0) AS sum_prob, coalesce(k, 0) AS sum_label FROM g LEFT JOIN h USING ({_BY}, bin)) z""",
    "estimates",
)
def _(x):
    return c.stratified_histograms(x.estimates, ["platt2", "raw", "chi2"], _strata(), "label", n=100)


@check(
    "audit_verdicts",
    "ece:d dr_ece:d baseline_dr_ece:d worst_stratum_ece:d wider_ece:d passes_overall_target:b passes_stratum_target:b "
    "passes_decision_region_target:b beats_baseline:b recommend_wider:b",
    f"""SELECT *, ece < 0.01 AS passes_overall_target, w < 0.02 AS passes_stratum_target, dr_ece < 0.02 AS passes_decision_region_target,
               dr_ece < baseline_dr_ece AS beats_baseline, NOT w < 0.02 AND wider_ece < ece AS recommend_wider, w AS worst_stratum_ece
        FROM (SELECT max(ece) FILTER (WHERE family = 'all' AND estimator = 'platt2') AS ece,
                     max(dr_ece) FILTER (WHERE family = 'all' AND estimator = 'platt2') AS dr_ece,
                     max(dr_ece) FILTER (WHERE family = 'all' AND estimator = 'chi2') AS baseline_dr_ece,
                     max(ece) FILTER (WHERE family <> 'all' AND estimator = 'platt2') AS w,
                     max(ece) FILTER (WHERE family = 'all' AND estimator = 'raw') AS wider_ece
              FROM (WITH {_EST} {_AUDIT}) a) v""",
    "estimates",
)
def _(x):
    return c.audit_verdicts(_audit(x), "platt2", "chi2", "raw")


@check(
    "metric_bundle_by_event",
    "event_id n_pos:l n_neg:l auc_roc:d auc_pr:d n_rows:l ece:d mce:d dr_n_rows:l dr_ece:d threshold_n_rows:l threshold_ece:d base_rate:d",
    f"""SELECT *, n_pos * 1e0 / (n_pos + n_neg) AS base_rate FROM ({_ranking_sql('scores', 'event_id')}) a
        JOIN ({_errors_sql('scores', 'event_id')}) e USING (event_id)
        LEFT JOIN (SELECT event_id, n_rows AS dr_n_rows, dr_ece FROM ({_region_sql('scores', 0.01, 0.99, 'event_id')}) r) r USING (event_id)
        LEFT JOIN (SELECT event_id, n_rows AS threshold_n_rows, dr_ece AS threshold_ece
                   FROM ({_region_sql('scores', 0.01, 0.5, 'event_id')}) t) t USING (event_id)""",
    "scores",
)
def _(x):
    return c.metric_bundle(x.scores, "prob", "label", by=["event_id"])


@check(
    "quantile_reliability",
    _REL_COLS,
    f"""SELECT bin, bin_lo, bin_hi, sp / n AS mean_predicted, k * 1e0 / n AS observed_fraction, n AS count, k AS n_positive,
               {wilson95('k', 'n')[0]} AS ci_lower, {wilson95('k', 'n')[1]} AS ci_upper, n < 1 AS sparse
        FROM (SELECT bin, min(q[bin + 1]) AS bin_lo, min(q[bin + 2]) AS bin_hi, count(*) AS n, sum(label) AS k, sum(prob) AS sp
              FROM (SELECT *, CAST(prob >= q[2] AS INT) + CAST(prob >= q[3] AS INT) + CAST(prob >= q[4] AS INT) + CAST(prob >= q[5] AS INT) AS bin
                    FROM scores, (SELECT quantile_cont(prob, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM scores) e) b GROUP BY bin) r""",
    "scores",
)
def _(x):
    return c.quantile_reliability(x.scores, "prob", "label", n=5)


@check(
    "quantile_strata",
    "stratum:l n:l lo:d hi:d",
    """SELECT CAST(chi2_inc >= q[2] AS INT) + CAST(chi2_inc >= q[3] AS INT) + CAST(chi2_inc >= q[4] AS INT) + CAST(chi2_inc >= q[5] AS INT) AS stratum,
              count(*) AS n, min(chi2_inc) AS lo, max(chi2_inc) AS hi
       FROM scores, (SELECT quantile_cont(chi2_inc, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM scores) e GROUP BY 1""",
    "scores",
)
def _(x):
    d = c.quantile_stratum(x.scores, "chi2_inc", 5, "stratum")
    return d.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.min("chi2_inc").alias("lo"), F.max("chi2_inc").alias("hi")
    )


@check(
    "linear_reliability",
    "bin:l count:l mean_predicted:d observed_fraction:d",
    """SELECT least(19, floor(p / 5e-2)) AS bin, count(*) AS count, avg(p) AS mean_predicted, avg(label) AS observed_fraction
       FROM (SELECT prob * 11e-1 AS p, label FROM scores) s WHERE p <= 1 GROUP BY 1""",
    "scores",
)
def _(x):
    return c.linear_reliability(x.scores.withColumn("p", F.col("prob") * 1.1), "p", "label")


@check(
    "rank_correlation",
    "n:l spearman:d",
    """SELECT count(*) AS n, corr(ra, rb) AS spearman FROM (
         SELECT rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2e0 AS ra,
                rank() OVER (ORDER BY chi2_inc) + (count(*) OVER (PARTITION BY chi2_inc) - 1) / 2e0 AS rb FROM scores) r""",
    "scores",
)
def _(x):
    return c.rank_correlation(x.scores, "prob", "chi2_inc")


@check(
    "value_audit",
    "n_rows:l target_mean:d bce:d entropy_floor:d excess_bce:d mse:d wrongly_pruned_frac:d wrongly_kept_frac:d",
    """SELECT count(*) AS n_rows, avg(target) AS target_mean, avg(b) AS bce, avg(f) AS entropy_floor, avg(b) - avg(f) AS excess_bce,
              avg((prob - target) * (prob - target)) AS mse, avg(CASE WHEN prob < 5e-1 AND target >= 5e-1 THEN 1e0 ELSE 0e0 END) AS wrongly_pruned_frac,
              avg(CASE WHEN prob >= 5e-1 AND target < 5e-1 THEN 1e0 ELSE 0e0 END) AS wrongly_kept_frac
       FROM (SELECT *, -(target * ln(prob) + (1 - target) * ln(1 - prob)) AS b, -(y * ln(y) + (1 - y) * ln(1 - y)) AS f
             FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, target)) AS y FROM scores) s) a""",
    "scores",
)
def _(x):
    return c.value_audit(x.scores, "prob", "target")


@check(
    "value_audit_one_window",
    "n_rows:l target_mean:d mse:d",
    """SELECT count(*) AS n_rows, avg(target) AS target_mean, avg((prob - target) * (prob - target)) AS mse
       FROM scores WHERE n_window = 7""",
    "scores",
)
def _(x):
    d = x.scores.withColumn("window_nsigma", F.col("n_window").cast("double"))
    return c.value_audit(c.window_filter(d, 7.0), "prob", "target")


@check(
    "calibrator_slope_violations",
    "n_window_at_slope_zero:d n_rows_slope_nonpositive:l frac_rows_slope_nonpositive:d min_slope:d max_n_window:d",
    """SELECT exp(7e-1 / 45e-2) AS n_window_at_slope_zero, count(CASE WHEN s <= 0 THEN 1 END) AS n_rows_slope_nonpositive,
              count(CASE WHEN s <= 0 THEN 1 END) * 1e0 / count(*) AS frac_rows_slope_nonpositive, min(s) AS min_slope, max(n_window) AS max_n_window
       FROM (SELECT *, 7e-1 - 45e-2 * ln(n_window) AS s FROM scores) a""",
    "scores",
)
def _(x):
    return c.slope_violations(x.scores, "n_window", (0.7, -0.45, 0.0, 0.0))


@check(
    "score_monotonicity",
    "frac_non_increasing:d mean_diff:d v_big_mean:d v_small_mean:d",
    """SELECT avg(CASE WHEN s <= b THEN 1e0 ELSE 0e0 END) AS frac_non_increasing, avg(b - s) AS mean_diff, avg(b) AS v_big_mean, avg(s) AS v_small_mean
       FROM (SELECT 1e0 / (1e0 + exp(-(logit + 1e-1 * 10 * (n_window - 3)))) AS b, 1e0 / (1e0 + exp(-(logit + 1e-1 * 3 * (n_window - 3)))) AS s FROM scores) a""",
    "scores",
)
def _(x):
    at = lambda w: platt(F.col("logit") + F.lit(0.1) * w * (F.col("n_window") - 3), 1.0, 0.0)
    return c.monotonicity(x.scores.select(at(3).alias("s"), at(10).alias("b")), "s", "b")


# The optimum of the fit is where its gradient vanishes; SQL checks the gradient at the fitted point.


@check(
    "platt_fit_gradient",
    "n:l g_slope:d g_offset:d descended:b",
    "SELECT count(*) AS n, 0e0 AS g_slope, 0e0 AS g_offset, true AS descended FROM scores",
    "scores",
)
def _(x):
    fit = p.fit_platt(x.scores, "logit", "label")
    r = platt("logit", *fit.params) - F.col("label")
    falls = all(a >= b - 1e-12 for a, b in zip(fit.trace, fit.trace[1:]))
    return x.scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(r * F.col("logit")), 7).alias("g_slope"),
        F.round(F.avg(r), 7).alias("g_offset"),
        F.lit(falls).alias("descended"),
    )


@check(
    "platt_occupancy_fit_gradient",
    "n:l g0:d g1:d g2:d g3:d",
    "SELECT count(*) AS n, 0e0 AS g0, 0e0 AS g1, 0e0 AS g2, 0e0 AS g3 FROM scores",
    "scores",
)
def _(x):
    from ..functions.stats import log_occupancy, platt_occupancy

    fit = p.fit_platt_occupancy(x.scores, "logit", "label", "n_window")
    r = platt_occupancy("logit", "n_window", fit.params) - F.col("label")
    w, z = log_occupancy("n_window"), F.col("logit")
    g = [r * z, r * z * w, r, r * w]
    return x.scores.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(e), 7).alias(f"g{i}") for i, e in enumerate(g)])


@check(
    "chi2_probability_calibration",
    f"occ {_ERR_COLS}",
    _errors_sql(f"(SELECT {OCC_LABEL} AS occ, {CHI2P} AS prob, CAST(coalesce(list_contains(contrib_pids, branch_majority_pid), false) AS INT) AS label "
                "FROM cand WHERE NOT majority_undefined AND cand_hit_id <> -1) q", "occ"),
    "cand",
)
def _(x):
    from ..functions.geometry import chi2_probability
    from ..functions.strata import label_columns, occupancy_stratum

    lab = label_columns()
    d = x.cand.where(lab["gate_row_mask"]).select(
        occupancy_stratum("n_window").alias("occ"),
        chi2_probability("chi2_inc").alias("prob"),
        lab["label_same_particle"].alias("label"),
    )
    return c.calibration_errors(d, "prob", "label", by=["occ"])
