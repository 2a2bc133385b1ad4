"""Scalar expressions row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as feat
from ..functions import geometry as g
from ..functions import ids, stats, strata
from ..functions.expr import bin_index, grid_index
from .registry import check
from .sqltext import CHI2P, EDGES30, LOGODDS, MEMBER, NEED, OCC_LABEL, SENSOR, bucket, clip, eta, wilson, wilson95

KEY = "event_id branch_id step_k cand_hit_id"
HITS = "SELECT * FROM cand WHERE cand_hit_id >= 0"


@check(
    "surface_id_codec",
    "l_orderkey l_linenumber l_partkey packed:l volume:l layer:l module:l cleared:l particle:l",
    """SELECT l_orderkey, l_linenumber, l_partkey, packed + 5 AS packed, v AS volume, l AS layer, m AS module,
              packed AS cleared, particle
       FROM (SELECT *, (v << 56) | (l << 36) | (m << 8) AS packed,
                    (v << 48) | (l << 32) | (m % 1000 << 16) | (3 << 8) | 7 AS particle
             FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 60 AS v, l_partkey % 4000 AS l,
                          l_orderkey % 900000 AS m FROM lineitem) a) b""",
)
def _(x):
    d = x.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_suppkey") % 60).alias("v"),
        (F.col("l_partkey") % 4000).alias("l"),
        (F.col("l_orderkey") % 900000).alias("m"),
    )
    d = d.withColumn("packed", ids.encode_surface("v", "l", "m") + 5)
    vol, lay, mod = ids.decode_surface("packed")
    return d.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "packed",
        vol.alias("volume"),
        lay.alias("layer"),
        mod.alias("module"),
        ids.clear_ring("packed").alias("cleared"),
        ids.encode_particle("v", "l", F.col("m") % 1000, F.lit(3), F.lit(7)).alias("particle"),
    )


@check(
    "window_predicates",
    f"{KEY} half0:d half1:d boxed:b near:b ellipse:b need:d",
    f"""SELECT event_id, branch_id, step_k, cand_hit_id, 3 * sqrt(S00) AS half0, 3 * sqrt(S11) AS half1,
              abs(residual_l0) <= 3 * sqrt(S00) AND (is_1d OR abs(residual_l1) <= 3 * sqrt(S11)) AS boxed,
              sqrt(residual_l0 * residual_l0 + CASE WHEN is_1d THEN 0 ELSE residual_l1 * residual_l1 END) <= 5 AS near,
              chi2_inc < 9 AS ellipse, {NEED} AS need
       FROM ({HITS}) h""",
    "cand",
)
def _(x):
    d = x.cand.where("cand_hit_id >= 0")
    return d.select(
        *KEY.split(),
        g.half_width("S00", 3).alias("half0"),
        g.half_width("S11", 3).alias("half1"),
        g.in_box("residual_l0", "residual_l1", "S00", "S11", "is_1d", 3).alias("boxed"),
        g.in_radius("residual_l0", "residual_l1", "is_1d", 5.0).alias("near"),
        g.in_ellipse("chi2_inc", 3).alias("ellipse"),
        g.needed_window("residual_l0", "residual_l1", "S00", "S11", "is_1d").alias("need"),
    )


@check(
    "chi2_increment",
    f"{KEY} chi2:d chi2_full:d diag:d ratio:d delta:d rho:d",
    f"""SELECT event_id, branch_id, step_k, cand_hit_id, chi2_inc AS chi2, full_ AS chi2_full, diag,
              CASE WHEN diag > 1e-12 THEN full_ / diag END AS ratio, full_ - diag AS delta, rho
       FROM (SELECT *, CASE WHEN is_1d THEN NULL ELSE chi2_inc END AS full_,
                    residual_l0 * residual_l0 / S00 + residual_l1 * residual_l1 / S11 AS diag,
                    S01 / sqrt(S00 * S11) AS rho FROM ({HITS}) h) k""",
    "cand",
)
def _(x):
    d = x.cand.where("cand_hit_id >= 0")
    r = ("residual_l0", "residual_l1", "S00", "S01", "S11")
    both = g.chi2_full_and_diagonal(*r)
    return d.select(
        *KEY.split(),
        g.chi2_increment(*r, "is_1d").alias("chi2"),
        both["chi2_full"].alias("chi2_full"),
        both["chi2_diag"].alias("diag"),
        both["chi2_ratio"].alias("ratio"),
        both["chi2_delta"].alias("delta"),
        g.correlation("S00", "S01", "S11").alias("rho"),
    )


@check(
    "correlation_from_pulls",
    f"{KEY} rho:d",
    """SELECT event_id, branch_id, step_k, cand_hit_id,
              CASE WHEN abs(c - diag) < 1e-12 THEN 0e0
                   WHEN abs(c) < 1e-30 THEN NULL
                   WHEN hi BETWEEN -1 AND 1 AND ab <> 0 AND hi * ab >= 0 THEN hi
                   WHEN lo BETWEEN -1 AND 1 AND ab <> 0 AND lo * ab >= 0 THEN lo
                   WHEN hi BETWEEN -1 AND 1 THEN hi
                   WHEN lo BETWEEN -1 AND 1 THEN lo
                   ELSE greatest(-1e0, least(1e0, hi)) END AS rho
       FROM (SELECT *, (ab + root) / c AS hi, (ab - root) / c AS lo
             FROM (SELECT *, sqrt(greatest(ab * ab - c * (diag - c), 0e0)) AS root
                   FROM (SELECT *, a * b AS ab, a * a + b * b AS diag
                         FROM (SELECT event_id, branch_id, step_k, cand_hit_id, chi2_inc AS c,
                                      residual_l0 / sqrt(S00) AS a, residual_l1 / sqrt(S11) AS b
                               FROM cand WHERE cand_hit_id >= 0 AND NOT is_1d) p) q) r) s""",
    "cand",
)
def _(x):
    d = x.cand.where("cand_hit_id >= 0 AND NOT is_1d")
    a, b = F.col("residual_l0") / F.sqrt("S00"), F.col("residual_l1") / F.sqrt("S11")
    return d.select(*KEY.split(), g.correlation_from_pulls("chi2_inc", a, b).alias("rho"))


@check(
    "kinematics",
    f"{KEY} eta:d pt:d chol_S_00:d chol_S_10:d chol_S_11:d p_chi2:d logodds:d kappa_u:d kappa_v:d q_tilde:d",
    f"""SELECT event_id, branch_id, step_k, cand_hit_id, {eta('state_theta')} AS eta,
              CASE WHEN state_qop <> 0 THEN abs(1e0 / state_qop) * sin(state_theta) END AS pt,
              sqrt(S00) AS chol_S_00, S01 / sqrt(S00) AS chol_S_10,
              sqrt(greatest(S11 - (S01 / sqrt(S00)) * (S01 / sqrt(S00)),
                            CASE WHEN S11 IS NULL THEN NULL ELSE 1e-30 END)) AS chol_S_11,
              {CHI2P} AS p_chi2, {LOGODDS} AS logodds,
              clus_s_u / (1 + thickness * abs(tan(alpha_u)) / pitch_u) AS kappa_u,
              clus_s_v / (1 + thickness * abs(tan(alpha_v)) / pitch_v) AS kappa_v,
              clus_q_tot / (thickness * sqrt(1 + tan(alpha_u) * tan(alpha_u) + tan(alpha_v) * tan(alpha_v))) AS q_tilde
       FROM cand""",
    "cand",
)
def _(x):
    chol = g.cholesky_2x2("S00", "S01", "S11")
    return x.cand.select(
        *KEY.split(),
        g.pseudorapidity("state_theta").alias("eta"),
        g.transverse_momentum("state_qop", "state_theta").alias("pt"),
        *[c.alias(n) for n, c in chol.items()],
        g.chi2_probability("chi2_inc").alias("p_chi2"),
        g.chi2_log_odds("chi2_inc").alias("logodds"),
        g.extent_ratio("clus_s_u", "thickness", "alpha_u", "pitch_u").alias("kappa_u"),
        g.extent_ratio("clus_s_v", "thickness", "alpha_v", "pitch_v").alias("kappa_v"),
        g.charge_per_path("clus_q_tot", "thickness", "alpha_u", "alpha_v").alias("q_tilde"),
    )


_GATE_SQL = {
    "chol_S_00": "sqrt(S00)",
    "chol_S_10": "S01 / sqrt(S00)",
    "chol_S_11": "CASE WHEN S11 IS NULL THEN NULL ELSE sqrt(greatest(S11 - S01 * S01 / S00, 1e-30)) END",
    "kappa_u": "clus_s_u / (1 + thickness * abs(tan(alpha_u)) / pitch_u)",
    "kappa_v": "clus_s_v / (1 + thickness * abs(tan(alpha_v)) / pitch_v)",
    "q_tilde": "clus_q_tot / (thickness * sqrt(1 + tan(alpha_u) * tan(alpha_u) + tan(alpha_v) * tan(alpha_v)))",
    "eta": eta("state_theta"),
}


@check(
    "gate_features",
    "event_id branch_id cand_hit_id " + " ".join(f"{n}:d" for n in feat.GATE_FEATURES),
    "SELECT event_id, branch_id, cand_hit_id, "
    + ", ".join(f"coalesce(CAST({_GATE_SQL.get(n, n)} AS DOUBLE), 0e0) AS {n}" for n in feat.GATE_FEATURES)
    + " FROM cand",
    "cand",
)
def _(x):
    return feat.gate_features(x.cand, carry=("event_id", "branch_id", "cand_hit_id"))


_SUBSET = feat.select_features(feat.feature_rows(), ["kalman", "context"], ["state_qop"])


@check(
    "feature_subset_means",
    "feature mean:d",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, avg(coalesce(CAST({_GATE_SQL.get(n, n)} AS DOUBLE), 0e0)) AS mean FROM cand"
        for n in _SUBSET
    ),
    "cand",
)
def _(x):
    d = feat.gate_features(x.cand)
    return feat.norm_stats(d, _SUBSET, skip=()).select("feature", F.col("mu").alias("mean"))


@check(
    "norm_stats",
    "feature mu:d sigma:d",
    "SELECT feature, CASE WHEN skip THEN 0e0 ELSE avg(v) END AS mu, "
    "CASE WHEN skip OR stddev_pop(v) = 0 THEN 1e0 ELSE stddev_pop(v) END AS sigma FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {str(n in feat.UNSCALED).lower()} AS skip, "
        f"coalesce(CAST({_GATE_SQL.get(n, n)} AS DOUBLE), 0e0) AS v FROM cand"
        for n in feat.GATE_FEATURES
    )
    + ") f GROUP BY feature, skip",
    "cand",
)
def _(x):
    return feat.norm_stats(feat.gate_features(x.cand), feat.GATE_FEATURES)


@check(
    "standardised_features",
    "event_id branch_id cand_hit_id clus_q_tot:d n_hits:d eta:d",
    f"""SELECT event_id, branch_id, cand_hit_id, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS clus_q_tot,
              CAST(n_hits AS DOUBLE) AS n_hits, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS eta
       FROM (SELECT *, coalesce(clus_q_tot, 0e0) AS q, {eta('state_theta')} AS e FROM cand) f""",
    "cand",
)
def _(x):
    names = ["clus_q_tot", "n_hits", "eta"]
    d = feat.gate_features(x.cand, carry=("event_id", "branch_id", "cand_hit_id"))
    return feat.standardise(d, feat.collect_stats(feat.norm_stats(d, names)))


@check(
    "truth_labels",
    f"{KEY} label:l ambiguous:b trainable:b correct:l wrong:l accepted:b",
    f"""SELECT event_id, branch_id, step_k, cand_hit_id, CAST({MEMBER} AS INT) AS label,
              coalesce(len(contrib_pids), 0) > 1 AS ambiguous, NOT majority_undefined AND cand_hit_id <> -1 AS trainable,
              CAST(is_ckf_selected AND cand_hit_id >= 0 AND {MEMBER} AS INT) AS correct,
              CAST(is_ckf_selected AND cand_hit_id >= 0 AND NOT {MEMBER} AS INT) AS wrong,
              {MEMBER} AND coalesce(chi2_inc < 49, false) AS accepted
       FROM cand""",
    "cand",
)
def _(x):
    lab = strata.label_columns()
    ok, bad = strata.selected_outcome("is_ckf_selected", "cand_hit_id", "branch_majority_pid", "contrib_pids")
    return x.cand.select(
        *KEY.split(),
        lab["label_same_particle"].alias("label"),
        lab["label_ambiguous"].alias("ambiguous"),
        lab["gate_row_mask"].alias("trainable"),
        ok.alias("correct"),
        bad.alias("wrong"),
        strata.rollout_accepts("branch_majority_pid", "contrib_pids", "chi2_inc", 7).alias("accepted"),
    )


def _labelled(x_sql: str, edges, fmt: str) -> str:
    out = "CASE "
    for i in range(len(edges) - 1):
        op = "<=" if i == len(edges) - 2 else "<"
        label = fmt.format(edges[i], edges[i + 1])
        out += f"WHEN {x_sql} >= {edges[i]} AND {x_sql} {op} {edges[i + 1]} THEN '{label}' "
    return out + "END"


@check(
    "strata",
    f"{KEY} eta_bin:l sensor:l occ:l eta_label abs_label occ_label pixel:b barrel:b",
    f"""SELECT event_id, branch_id, step_k, cand_hit_id,
              {bucket('e', [-3.5 + i * 0.05 for i in range(1, 140)])} AS eta_bin, {SENSOR} AS sensor,
              {bucket('n_window', [2, 5, 10, 20])} AS occ,
              {_labelled('e', strata.ETA_EDGES, 'eta[{:+.1f},{:+.1f}]')} AS eta_label,
              {_labelled('abs(e)', strata.ABS_ETA_EDGES, '|eta|[{:.1f},{:.1f})')} AS abs_label,
              {OCC_LABEL} AS occ_label, volume_id IN (16, 17, 18) AS pixel, volume_id IN (17, 24, 29) AS barrel
       FROM (SELECT *, {eta('state_theta')} AS e FROM cand) f""",
    "cand",
)
def _(x):
    d = x.cand.withColumn("e", g.pseudorapidity("state_theta"))
    pixel, barrel = strata.sensor_flags("volume_id", barrel=(17, 24, 29))
    return d.select(
        *KEY.split(),
        strata.eta_grid_index("e").alias("eta_bin"),
        strata.sensor_class("volume_id").alias("sensor"),
        strata.occupancy_index("n_window").alias("occ"),
        strata.eta_stratum("e").alias("eta_label"),
        strata.abs_eta_stratum("e").alias("abs_label"),
        strata.occupancy_stratum("n_window").alias("occ_label"),
        pixel.alias("pixel"),
        barrel.alias("barrel"),
    )


_PLATT4 = (1.01048, -0.00224, -0.04648, 0.00592)


@check(
    "calibrator_maps",
    "n_window logit_bin n:l p2:d p4:d raw_odds:d bce:d",
    f"""SELECT n_window, {bucket('prob', EDGES30[1:-1])} AS logit_bin, count(*) AS n,
              avg(1e0 / (1e0 + exp(-(1.00481e0 * logit - 0.03729e0)))) AS p2,
              avg(1e0 / (1e0 + exp(-((1.01048e0 - 0.00224e0 * ln(n_window)) * logit - 0.04648e0 + 0.00592e0 * ln(n_window))))) AS p4,
              avg(ln({clip('prob', '1e-6', '1e0 - 1e-6')} / (1e0 - {clip('prob', '1e-6', '1e0 - 1e-6')}))) AS raw_odds,
              avg(greatest(logit, 0e0) - logit * label + ln(1e0 + exp(-abs(logit)))) AS bce
       FROM scores GROUP BY 1, 2""",
    "scores",
)
def _(x):
    return x.scores.groupBy("n_window", bin_index("prob", EDGES30[1:-1]).alias("logit_bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(stats.platt("logit", 1.00481, -0.03729)).alias("p2"),
        F.avg(stats.platt_occupancy("logit", "n_window", _PLATT4)).alias("p4"),
        F.avg(stats.log_odds("prob")).alias("raw_odds"),
        F.avg(stats.bce_with_logits("logit", "label")).alias("bce"),
    )


@check(
    "wilson_intervals",
    "l_suppkey k:l n:l lo:d hi:d lo95:d hi95:d",
    f"""SELECT l_suppkey, k, n, {wilson('k', 'n')[0]} AS lo, {wilson('k', 'n')[1]} AS hi,
              {wilson95('k', 'n')[0]} AS lo95, {wilson95('k', 'n')[1]} AS hi95
       FROM (SELECT l_suppkey, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS k
             FROM lineitem GROUP BY l_suppkey) a""",
)
def _(x):
    d = x.table("lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("k")
    )
    lo, hi = stats.wilson("k", "n")
    lo95, hi95 = stats.wilson95("k", "n")
    return d.select("l_suppkey", "k", "n", lo.alias("lo"), hi.alias("hi"), lo95.alias("lo95"), hi95.alias("hi95"))


@check(
    "uniform_grid_bins",
    "bin:l n:l",
    """SELECT CASE WHEN x >= 10 THEN 99 ELSE CAST(floor(x * 10) AS BIGINT) END AS bin, count(*) AS n
       FROM (SELECT greatest(0, least(10, l_quantity / 4)) AS x FROM lineitem) a GROUP BY 1""",
)
def _(x):
    d = x.table("lineitem")
    return d.groupBy(grid_index(F.col("l_quantity") / 4, 0.0, 10.0, 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
