"""Reliability tables, calibration errors, curves and audits.

Scores are binned once with partial aggregation; everything after that works on
tables of a few dozen bins per stratum.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, clip, col, count_if, grid_index, ratio, true
from ..functions.stats import bce, log_occupancy, logit_edges, wilson95
from ..session import cut_lineage
from .ordered import exact_percentiles, value_prefix

# Fixed values of the calibration report.
MIN_BIN_COUNT = 100
MIN_STRATUM_ROWS = 1000
DECISION_REGION = (0.01, 0.99)
THRESHOLD_REGION = (0.01, 0.5)
GRID_LOGIT_RANGE = (-20.0, 20.0)
GRID_POINTS = 4000
PROB_HIST_BINS = 1000
ECE_TARGET_OVERALL = 0.01
ECE_TARGET_STRATUM = 0.02


def bin_table(spark: SparkSession, edges: Sequence[float], geometric: bool = True) -> DataFrame:
    """One row per bin with its limits and the point that stands for it when empty."""
    rows = []
    for i in range(len(edges) - 1):
        lo, hi = float(edges[i]), float(edges[i + 1])
        mid = math.sqrt(max(lo, 1e-300) * max(hi, 1e-300)) if geometric else 0.5 * (lo + hi)
        rows.append((i, lo, hi, mid))
    return spark.createDataFrame(rows, "bin int, bin_lo double, bin_hi double, midpoint double")


def bin_sums(df: DataFrame, pred: str, label: str, edges: Sequence[float], by: Sequence[str] = ()):
    """Counts and sums per bin; values outside the edges go to the end bins."""
    b = bin_index(pred, list(edges)[1:-1]).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(col(label).cast("double")).alias("sum_label"),
        F.sum(pred).alias("sum_pred"),
    )


def reliability(
    df: DataFrame,
    pred: str,
    label: str,
    edges: Sequence[float] | None = None,
    by: Sequence[str] = (),
    min_count: int = MIN_BIN_COUNT,
) -> DataFrame:
    """Reliability table with every bin present for every stratum."""
    by = list(by)
    edges = list(edges) if edges is not None else logit_edges(30)
    sums = bin_sums(df, pred, label, edges, by)
    grid = bin_table(df.sparkSession, edges)
    if by:
        bins = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("bin"),
                        F.lit(float(edges[i])).alias("bin_lo"),
                        F.lit(float(edges[i + 1])).alias("bin_hi"),
                        F.lit(
                            math.sqrt(max(edges[i], 1e-300) * max(edges[i + 1], 1e-300))
                        ).alias("midpoint"),
                    )
                    for i in range(len(edges) - 1)
                ]
            )
        )
        grid = sums.select(*by).distinct().select(*by, bins.alias("_b")).select(*by, "_b.*")
    j = grid.join(sums, [*by, "bin"], "left")
    n, k = F.coalesce("count", F.lit(0)), F.coalesce("sum_label", F.lit(0.0))
    lo, hi = wilson95("n_positive", "count")
    return (
        j.select(
            *by,
            "bin",
            "bin_lo",
            "bin_hi",
            F.coalesce(ratio("sum_pred", "count"), F.col("midpoint")).alias("mean_predicted"),
            F.coalesce(ratio("sum_label", "count"), F.lit(0.0)).alias("observed_fraction"),
            n.alias("count"),
            k.cast("long").alias("n_positive"),
        )
        .withColumns({"ci_lower": lo, "ci_upper": hi, "sparse": F.col("count") < min_count})
    )


def calibration_errors(
    df: DataFrame,
    pred: str,
    label: str,
    edges: Sequence[float] | None = None,
    by: Sequence[str] = (),
    min_count: int = MIN_BIN_COUNT,
) -> DataFrame:
    """ECE over all bins and MCE over bins with support, with the worst bin."""
    by = list(by)
    edges = list(edges) if edges is not None else logit_edges(30)
    sums = bin_sums(df, pred, label, edges, by)
    gap = F.abs(F.col("sum_label") / F.col("count") - F.col("sum_pred") / F.col("count"))
    live = F.col("count") >= min_count
    worst = F.max(F.when(live, F.struct(F.col("_gap"), -F.col("bin"), F.col("count").alias("n"))))
    agg = sums.withColumn("_gap", gap).groupBy(*by).agg(
        F.sum("count").alias("n_rows"),
        (F.sum(F.col("_gap") * F.col("count")) / F.sum("count")).alias("ece"),
        worst.alias("_w"),
        count_if(live).alias("n_bins_eligible"),
        F.coalesce(F.sum(F.when(live, F.col("count"))), F.lit(0)).alias("n_rows_eligible"),
    )
    return agg.select(
        *by,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("ece", F.lit(0.0)).alias("ece"),
        F.coalesce(F.col("_w._gap"), F.lit(0.0)).alias("mce"),
        F.col("_w.n").alias("worst_bin_count"),
        "n_bins_eligible",
        F.lit(len(edges) - 1).alias("n_bins_total"),
        "n_rows_eligible",
        F.coalesce(ratio("n_rows_eligible", "n_rows"), F.lit(0.0)).alias("frac_rows_eligible"),
    )


def region_error(
    df: DataFrame,
    pred: str,
    label: str,
    region: tuple[float, float] = DECISION_REGION,
    n_bins: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """ECE inside a closed probability range; NULL below the minimum row count."""
    by = list(by)
    lo, hi = region
    inside = df.where((F.col(pred) >= lo) & (F.col(pred) <= hi))
    sums = bin_sums(inside, pred, label, logit_edges(n_bins, lo, hi), by)
    gap = F.abs(F.col("sum_label") - F.col("sum_pred"))
    agg = sums.groupBy(*by).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
        F.sum(gap).alias("_g"),
        F.sum("sum_label").alias("_k"),
    )
    enough = F.col("n_rows") >= MIN_BIN_COUNT
    return agg.select(
        *by,
        "n_rows",
        F.when(enough, F.col("_g") / F.col("n_rows")).alias("dr_ece"),
        F.when(enough, F.col("_k") / F.col("n_rows")).alias("positive_fraction"),
    )


def soft_reliability(
    df: DataFrame,
    pred: str,
    target: str,
    edges: Sequence[float] | None = None,
    min_count: int = MIN_BIN_COUNT,
) -> DataFrame:
    """Reliability of a target in [0, 1] on equal-width bins, with a standard-error band."""
    edges = list(edges) if edges is not None else [i / 20 for i in range(21)]
    b = bin_index(pred, edges[1:-1]).cast("int").alias("bin")
    sums = df.groupBy(b).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(pred).alias("_p"),
        F.avg(target).alias("_t"),
        F.stddev_samp(target).alias("_s"),
    )
    j = bin_table(df.sparkSession, edges, geometric=False).join(sums, ["bin"], "left")
    half = F.coalesce(F.lit(1.96) * F.col("_s") / F.sqrt("count"), F.lit(0.0))
    seen = F.col("count").isNotNull()
    return j.select(
        "bin",
        "bin_lo",
        "bin_hi",
        F.coalesce("_p", F.col("midpoint")).alias("mean_predicted"),
        F.coalesce("_t", F.lit(0.0)).alias("mean_target"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.when(seen, F.greatest(F.lit(0.0), F.col("_t") - half)).otherwise(F.lit(0.0)).alias("ci_lower"),
        F.when(seen, F.least(F.lit(1.0), F.col("_t") + half)).otherwise(F.lit(1.0)).alias("ci_upper"),
        (F.coalesce("count", F.lit(0)) < min_count).alias("sparse"),
    )


def soft_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_target") - F.col("mean_predicted")) * F.col("count")
    return table.agg(F.coalesce(F.sum(gap) / F.sum("count"), F.lit(0.0)).alias("soft_ece"))


# --- discrimination -------------------------------------------------------------------


def _on_grid(hist: DataFrame, by: list[str], cell: str, cells: int) -> DataFrame:
    """``hist`` with a row for every cell of every group; sums are null where there was none."""
    if by:
        groups = hist.select(*by).distinct()
    else:
        groups = hist.sparkSession.range(1).select()
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(cell))
    return grid.join(hist, [*by, cell], "left")


def grid_curves(
    df: DataFrame, logit: str, label: str, n: int = GRID_POINTS, span: tuple[float, float] = GRID_LOGIT_RANGE, by: Sequence[str] = ()
) -> DataFrame:
    """ROC and precision-recall counts at every edge of a fixed log-odds grid, for each group."""
    by = list(by)
    hist = df.groupBy(*by, grid_index(logit, *span, n).alias("edge")).agg(
        count_if(true(label)).alias("pos"), count_if(~true(label)).alias("neg")
    )
    return _curves(hist, by, n, span)


def _curves(hist: DataFrame, by: list[str], n: int, span: tuple[float, float]) -> DataFrame:
    """Suffix sums of ``pos`` and ``neg`` over the edges of each group: n + 1 rows, independent of the data."""
    lo, hi = span
    full = _on_grid(hist, by, "edge", n + 1).select(*by, "edge", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    group = by or [F.lit(0)]
    above = Window.partitionBy(*group).orderBy(F.col("edge").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    c = full.select(
        *by,
        "edge",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("n_pos"),
        F.sum("neg").over(whole).alias("n_neg"),
    )
    threshold = F.lit(lo) + F.col("edge") * F.lit((hi - lo) / n)
    return c.select(
        *by,
        "edge",
        threshold.alias("threshold_logit"),
        "tp",
        "fp",
        ratio("tp", "n_pos").alias("tpr"),
        ratio("fp", "n_neg").alias("fpr"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC area and average precision; NULL for a single class.

    Rows are first merged by distinct score, then prefix sums give the rank sum
    (ties count half) and the precision at each recall step.
    """
    by = list(by)
    merged = df.groupBy(*by, score).agg(
        count_if(true(label)).alias("_p"), count_if(~true(label)).alias("_n")
    )
    return _ranked(merged, score, by)


def _ranked(merged: DataFrame, score: str, by: list[str]) -> DataFrame:
    """:func:`ranking_metrics` of distinct scores with their positives ``_p`` and negatives ``_n``."""
    p = value_prefix(merged, score, {"p": "_p", "n": "_n"}, by=by, descending=True)
    above_n = F.col("n_before")
    auc_part = F.col("_p") * (F.col("n_total") - above_n - F.col("_n")) + F.lit(0.5) * F.col("_p") * F.col("_n")
    tp = F.col("p_before") + F.col("_p")
    seen = tp + F.col("n_before") + F.col("_n")
    agg = p.groupBy(*by).agg(
        F.max("p_total").alias("n_pos"),
        F.max("n_total").alias("n_neg"),
        F.sum(auc_part).alias("_a"),
        F.sum(F.col("_p") * tp / seen).alias("_ap"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(
        *by,
        "n_pos",
        "n_neg",
        F.when(both, F.col("_a") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc_roc"),
        F.when(both, F.col("_ap") / F.col("n_pos")).alias("auc_pr"),
    )


def probability_histogram(df: DataFrame, prob: str, label: str, n: int = PROB_HIST_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Count, probability sum and label sum per equal-width bin (all bins present), for each group."""
    by = list(by)
    p = clip(prob, 0.0, 1.0)
    sums = df.groupBy(*by, grid_index(prob, 0.0, 1.0, n).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(p).alias("sum_prob"),
        F.sum(col(label).cast("long")).alias("sum_label"),
    )
    return _histogram(sums, by, n)


def _histogram(sums: DataFrame, by: list[str], n: int) -> DataFrame:
    zero = {"count": 0, "sum_prob": 0.0, "sum_label": 0}
    return _on_grid(sums, by, "bin", n).select(*by, "bin", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zero.items()])


def rebin(hist: DataFrame, fine: int, coarse: int, min_count: int = MIN_BIN_COUNT) -> DataFrame:
    """Merge whole fine bins into ``coarse`` equal bins; exact, so ``coarse`` must divide ``fine``."""
    if fine % coarse:
        raise ValueError(f"{coarse} does not divide {fine}: the result would not be exact")
    sums = hist.groupBy(F.floor(F.col("bin") / (fine // coarse)).cast("int").alias("bin")).agg(
        F.sum("count").alias("count"), F.sum("sum_prob").alias("_p"), F.sum("sum_label").alias("n_positive")
    )
    lo, hi = wilson95("n_positive", "count")
    some = F.col("count") > 0
    mid = (F.col("bin") + 0.5) / F.lit(float(coarse))
    return sums.select(
        "bin",
        (F.col("bin") / F.lit(float(coarse))).alias("bin_lo"),
        ((F.col("bin") + 1) / F.lit(float(coarse))).alias("bin_hi"),
        F.coalesce(ratio("_p", "count"), mid).alias("mean_predicted"),
        F.coalesce(ratio("n_positive", "count"), F.lit(0.0)).alias("observed_fraction"),
        "count",
        "n_positive",
        F.when(some, lo).otherwise(F.lit(0.0)).alias("ci_lower"),
        F.when(some, hi).otherwise(F.lit(0.0)).alias("ci_upper"),
        (F.col("count") < min_count).alias("sparse"),
    )


# --- audits -----------------------------------------------------------------------------


BY = ["estimator", "family", "stratum"]


def _by_estimator(df: DataFrame, estimators: Sequence[str], strata: Mapping[str, Column | str], label: str) -> tuple[DataFrame, list[str]]:
    """One row per row and estimator (``pred``, ``label``), with the stratum of each family in a column of its own."""
    scores = [v for e in estimators for v in (F.lit(e), F.col(e).cast("double"))]
    columns = [f"_s{k}" for k in range(len(strata))]
    named = df.select(
        F.col(label).cast("double").alias("label"),
        *[F.col(e) for e in estimators],
        *[col(c).cast("string").alias(n) for n, c in zip(columns, strata.values(), strict=True)],
    )
    return named.select("label", *columns, F.stack(F.lit(len(estimators)), *scores).alias("estimator", "pred")), columns


def _rolled_up(cells: DataFrame, columns: list[str], strata: Mapping[str, Column | str], keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of merged cells per estimator, family, stratum and ``keys``: rows are repeated for each family only here."""
    families = [v for n, c in zip(strata, columns, strict=True) for v in (F.lit(n), F.col(c))]
    each = cells.select("estimator", *keys, *sums, F.stack(F.lit(len(columns)), *families).alias("family", "stratum"))
    return each.where(F.col("stratum").isNotNull()).groupBy(*BY, *keys).agg(*[F.sum(c).alias(c) for c in sums])


def stratified_cells(df: DataFrame, estimators: Sequence[str], strata: Mapping[str, Column | str], label: str) -> DataFrame:
    """Sums per estimator, family, stratum and bin of every binned metric, from one pass over the rows.

    ``main`` is the bin of the calibration error, ``decision`` and ``threshold`` those of the regions (null outside).
    Rows are merged by all strata and bins at once; the merged cells, not the rows, are then given to each family.
    """
    long, columns = _by_estimator(df, estimators, strata, label)
    bins = {"main": bin_index("pred", logit_edges(30)[1:-1])}
    for name, (lo, hi) in {"decision": DECISION_REGION, "threshold": THRESHOLD_REGION}.items():
        bins[name] = F.when((F.col("pred") >= lo) & (F.col("pred") <= hi), bin_index("pred", logit_edges(10, lo, hi)[1:-1]))
    merged = long.groupBy("estimator", *columns, *[b.cast("int").alias(n) for n, b in bins.items()]).agg(
        F.count(F.lit(1)).alias("count"), F.sum("label").alias("sum_label"), F.sum("pred").alias("sum_pred")
    )
    return _rolled_up(merged, columns, strata, list(bins), ["count", "sum_label", "sum_pred"])


def _region_of_cells(cells: DataFrame, bins: str, rows: str, error: str) -> DataFrame:
    """As :func:`region_error`, from cells."""
    sums = cells.where(F.col(bins).isNotNull()).groupBy(*BY, bins).agg(*[F.sum(c).alias(c) for c in ("count", "sum_label", "sum_pred")])
    agg = sums.groupBy(*BY).agg(F.sum("count").alias(rows), F.sum(F.abs(F.col("sum_label") - F.col("sum_pred"))).alias("_g"))
    return agg.select(*BY, rows, F.when(F.col(rows) >= MIN_BIN_COUNT, F.col("_g") / F.col(rows)).alias(error))


def _main_of_cells(cells: DataFrame, min_count: int = MIN_BIN_COUNT) -> DataFrame:
    """As :func:`calibration_errors`, from cells: n_rows, ece, mce."""
    sums = cells.groupBy(*BY, "main").agg(*[F.sum(c).alias(c) for c in ("count", "sum_label", "sum_pred")])
    gap = F.abs(F.col("sum_label") / F.col("count") - F.col("sum_pred") / F.col("count"))
    return sums.withColumn("_gap", gap).groupBy(*BY).agg(
        F.sum("count").alias("n_rows"),
        (F.sum(F.col("_gap") * F.col("count")) / F.sum("count")).alias("ece"),
        F.coalesce(F.max(F.when(F.col("count") >= min_count, F.col("_gap"))), F.lit(0.0)).alias("mce"),
    )


def stratified_audit(
    df: DataFrame,
    estimators: Sequence[str],
    strata: Mapping[str, Column | str],
    label: str,
    min_rows: int = MIN_STRATUM_ROWS,
) -> DataFrame:
    """ECE, MCE and decision-region ECE per estimator and stratum.

    Strata below ``min_rows`` are listed with NULL metrics.
    """
    cells = cut_lineage(stratified_cells(df, estimators, strata, label), "cells")
    j = _main_of_cells(cells).join(_region_of_cells(cells, "decision", "dr_n_rows", "dr_ece"), BY, "left")
    ok = F.col("n_rows") >= min_rows
    return j.select(
        *BY,
        "n_rows",
        *[F.when(ok, F.col(c)).alias(c) for c in ("ece", "mce", "dr_ece")],
        F.coalesce("dr_n_rows", F.lit(0)).alias("dr_n_rows"),
        (~ok).alias("skipped"),
    )


def stratified_bundles(df: DataFrame, estimators: Sequence[str], strata: Mapping[str, Column | str], label: str) -> DataFrame:
    """Discrimination and calibration scalars per estimator and stratum (compare :func:`metric_bundle`)."""
    cells = cut_lineage(stratified_cells(df, estimators, strata, label), "cells")
    long, columns = _by_estimator(df, estimators, strata, label)
    scores = long.groupBy("estimator", *columns, "pred").agg(F.sum("label").cast("long").alias("_p"), F.count(F.lit(1)).alias("_c"))
    merged = _rolled_up(scores, columns, strata, ["pred"], ["_p", "_c"]).withColumn("_n", F.col("_c") - F.col("_p"))
    out = _ranked(merged, "pred", BY).join(_main_of_cells(cells), BY)
    out = out.join(_region_of_cells(cells, "decision", "dr_n_rows", "dr_ece"), BY, "left")
    out = out.join(_region_of_cells(cells, "threshold", "threshold_n_rows", "threshold_ece"), BY, "left")
    return out.withColumn("base_rate", F.col("n_pos") / F.col("n_rows"))


def stratified_curves(
    df: DataFrame,
    estimators: Sequence[str],
    strata: Mapping[str, Column | str],
    label: str,
    n: int = GRID_POINTS,
    span: tuple[float, float] = GRID_LOGIT_RANGE,
) -> DataFrame:
    """:func:`grid_curves` per estimator and stratum; the estimators are log-odds."""
    long, columns = _by_estimator(df, estimators, strata, label)
    merged = long.groupBy("estimator", *columns, grid_index("pred", *span, n).alias("edge")).agg(
        F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("all")
    )
    hist = _rolled_up(merged, columns, strata, ["edge"], ["pos", "all"])
    return _curves(hist.select(*BY, "edge", "pos", (F.col("all") - F.col("pos")).alias("neg")), BY, n, span)


def stratified_histograms(df: DataFrame, estimators: Sequence[str], strata: Mapping[str, Column | str], label: str, n: int = PROB_HIST_BINS) -> DataFrame:
    """:func:`probability_histogram` per estimator and stratum."""
    long, columns = _by_estimator(df, estimators, strata, label)
    merged = long.groupBy("estimator", *columns, grid_index("pred", 0.0, 1.0, n).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(clip("pred", 0.0, 1.0)).alias("sum_prob"), F.sum("label").cast("long").alias("sum_label")
    )
    return _histogram(_rolled_up(merged, columns, strata, ["bin"], ["count", "sum_prob", "sum_label"]), BY, n)


def audit_verdicts(audit: DataFrame, chosen: str, baseline: str, wider: str | None = None) -> DataFrame:
    """One row of pass/fail verdicts from a stratified audit with an ``all`` family."""
    whole = F.col("family") == "all"
    get = lambda e, c: F.max(F.when(whole & (F.col("estimator") == e), F.col(c)))
    strata = F.max(F.when(~whole & (F.col("estimator") == chosen), F.col("ece")))
    v = audit.agg(
        get(chosen, "ece").alias("ece"),
        get(chosen, "dr_ece").alias("dr_ece"),
        get(baseline, "dr_ece").alias("baseline_dr_ece"),
        F.coalesce(strata, F.lit(0.0)).alias("worst_stratum_ece"),
        *([get(wider, "ece").alias("wider_ece")] if wider else []),
    )
    false = F.lit(False)
    out = v.withColumns(
        {
            "passes_overall_target": F.coalesce(F.col("ece") < ECE_TARGET_OVERALL, false),
            "passes_stratum_target": F.col("worst_stratum_ece") < ECE_TARGET_STRATUM,
            "passes_decision_region_target": F.coalesce(F.col("dr_ece") < ECE_TARGET_STRATUM, false),
            "beats_baseline": F.coalesce(F.col("dr_ece") < F.col("baseline_dr_ece"), false),
        }
    )
    if wider:
        better = F.coalesce(F.col("wider_ece") < F.col("ece"), false)
        out = out.withColumn("recommend_wider", ~F.col("passes_stratum_target") & better)
    return out


def metric_bundle(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Discrimination and calibration scalars side by side."""
    by = list(by)
    keys = by or ["_one"]
    d = df if by else df.withColumn("_one", F.lit(1))
    parts = [
        ranking_metrics(d, score, label, by=keys),
        calibration_errors(d, score, label, by=keys).select(*keys, "n_rows", "ece", "mce"),
        region_error(d, score, label, DECISION_REGION, by=keys).select(
            *keys, F.col("n_rows").alias("dr_n_rows"), "dr_ece"
        ),
        region_error(d, score, label, THRESHOLD_REGION, by=keys).select(
            *keys, F.col("n_rows").alias("threshold_n_rows"), F.col("dr_ece").alias("threshold_ece")
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    out = out.withColumn("base_rate", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    return out if by else out.drop("_one")


def value_audit(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Cross entropy, its floor and excess, squared error and threshold mistakes."""
    y = clip(target, 1e-7, 1.0 - 1e-7)
    floor = -(y * F.log(y) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - y))
    p = F.col(pred)
    hard = lambda c: F.avg(c.cast("double"))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(target).alias("target_mean"),
        F.avg(bce(pred, target)).alias("bce"),
        F.avg(floor).alias("entropy_floor"),
        (F.avg(bce(pred, target)) - F.avg(floor)).alias("excess_bce"),
        F.avg((p - F.col(target)) * (p - F.col(target))).alias("mse"),
        hard((p < 0.5) & (F.col(target) >= 0.5)).alias("wrongly_pruned_frac"),
        hard((p >= 0.5) & (F.col(target) < 0.5)).alias("wrongly_kept_frac"),
    )


def window_filter(df: DataFrame, window: float, column: str = "window_nsigma") -> DataFrame:
    """Rows of one window value; refuses a table without the column or without such rows."""
    if column not in df.columns:
        raise ValueError(f"table has no {column!r} column")
    near = F.abs(F.col(column) - window) <= 1e-8 + 1e-5 * abs(window)
    kept = df.where(near)
    if kept.isEmpty():
        raise ValueError(f"no rows with {column} == {window}")
    return kept


def slope_violations(df: DataFrame, n_window: str, params: tuple[float, float, float, float]) -> DataFrame:
    """Rows on which the occupancy-dependent map decreases in the logit."""
    a0, a1, _, _ = params
    slope = F.lit(a0) + F.lit(a1) * log_occupancy(n_window)
    crossing = math.exp(-a0 / a1) if a1 else math.inf
    return df.agg(
        F.lit(crossing).alias("n_window_at_slope_zero"),
        count_if(slope <= 0).alias("n_rows_slope_nonpositive"),
        (count_if(slope <= 0) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("frac_rows_slope_nonpositive"),
        F.min(slope).alias("min_slope"),
        F.max(F.greatest(col(n_window).cast("double"), F.lit(1.0))).alias("max_n_window"),
    )


def monotonicity(df: DataFrame, small: str, big: str) -> DataFrame:
    """Share of rows whose score does not rise when the column shrinks, with the means."""
    return df.agg(
        F.avg((F.col(small) <= F.col(big)).cast("double")).alias("frac_non_increasing"),
        F.avg(F.col(big) - F.col(small)).alias("mean_diff"),
        F.avg(big).alias("v_big_mean"),
        F.avg(small).alias("v_small_mean"),
    )


# --- quantile strata -----------------------------------------------------------------------


def quantile_edges(df: DataFrame, value: str, n: int, nudge: float | None = None) -> list[float]:
    """n+1 exact quantile edges made strictly increasing (next float, or plus ``nudge``)."""
    probs = [i / n for i in range(n + 1)]
    rows = exact_percentiles(df, value, probs).collect()
    edges = [v for _, v in sorted((r.q, r.value) for r in rows)]
    for i in range(1, len(edges)):
        if edges[i] <= edges[i - 1]:
            edges[i] = edges[i - 1] + nudge if nudge else math.nextafter(edges[i - 1], math.inf)
    return edges


def quantile_stratum(df: DataFrame, value: str, n: int = 5, out: str = "quantile", nudge=None) -> DataFrame:
    """Add the 0-based quantile stratum of a value."""
    edges = quantile_edges(df, value, n, nudge)
    return df.withColumn(out, bin_index(value, edges[1:-1]))


def quantile_reliability(df: DataFrame, pred: str, label: str, n: int = 10, by: Sequence[str] = ()):
    """Reliability on bins of equal population."""
    edges = quantile_edges(df, pred, n)
    return reliability(df, pred, label, edges=edges, by=by, min_count=1)


def linear_reliability(df: DataFrame, pred: str, label: str, n: int = 20) -> DataFrame:
    """Equal-width reliability that leaves out rows outside [0, 1]."""
    inside = df.where((F.col(pred) >= 0) & (F.col(pred) <= 1))
    return inside.groupBy(grid_index(pred, 0.0, 1.0, n).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(pred).alias("mean_predicted"),
        F.avg(col(label).cast("double")).alias("observed_fraction"),
    )


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks for ties (one row)."""
    from .ordered import average_rank

    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(
        F.count(F.lit(1)).alias("_w")
    )
    rx = average_rank(pairs, x, "_w").withColumnRenamed("rank", "_rx")
    ry = average_rank(pairs, y, "_w").withColumnRenamed("rank", "_ry")
    r = pairs.join(rx, [x], "inner").join(ry, [y], "inner")
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    m = r.agg(
        F.sum(w).alias("n"),
        (F.sum(w * a) / F.sum(w)).alias("ma"),
        (F.sum(w * b) / F.sum(w)).alias("mb"),
        (F.sum(w * a * b) / F.sum(w)).alias("mab"),
        (F.sum(w * a * a) / F.sum(w)).alias("maa"),
        (F.sum(w * b * b) / F.sum(w)).alias("mbb"),
    )
    cov = F.col("mab") - F.col("ma") * F.col("mb")
    va, vb = F.col("maa") - F.col("ma") ** 2, F.col("mbb") - F.col("mb") ** 2
    return m.select("n", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))
