"""Contributors, branch majorities and truth labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import true
from .ordered import best_by, first_n

BRANCH = ("event_id", "track_nr")


def contributors(hit_map: DataFrame, simhits: DataFrame) -> DataFrame:
    """Sorted distinct particles of each measurement with equal charge shares."""
    j = hit_map.join(simhits.select("event_id", "hit_id", "particle_id"), ["event_id", "hit_id"], "inner")
    return (
        j.where(F.col("particle_id").isNotNull())
        .groupBy("event_id", "measurement_id")
        .agg(F.array_sort(F.collect_set("particle_id")).alias("contrib_pids"))
        .withColumn(
            "contrib_charge_frac",
            F.transform("contrib_pids", lambda _: (F.lit(1.0) / F.size("contrib_pids")).cast("float")),
        )
    )


def mode_by(rows: DataFrame, keys, value: str, out: str, count_out: str | None = None) -> DataFrame:
    """Most frequent value per group, the smallest one on ties."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(value).alias("v"))).alias("_b")
    )
    cols = [F.col("_b.v").alias(out)]
    if count_out:
        cols.append((-F.col("_b.neg")).alias(count_out))
    return best.select(*keys, *cols)


def state_primary(states: DataFrame, pids: str = "contrib_pids") -> DataFrame:
    """Mode of each state's contributor list and the list length."""
    keys = ["event_id", "track_nr", "state_idx"]
    flat = states.select(*keys, F.explode(pids).alias("_pid"))
    top = mode_by(flat, keys, "_pid", "state_primary_pid")
    return states.join(top, keys, "left").withColumn(
        "state_n_contribs", F.size(F.coalesce(F.col(pids), F.array().cast("array<long>")))
    )


def branch_majority(states: DataFrame, keys=BRANCH, order="state_idx", first: int = 3, need: int = 2):
    """Particle shared by at least ``need`` of the first ``first`` measurement states.

    Branches with fewer measurement states or no agreement are undefined (−1).
    """
    keys = list(keys)
    head = first_n(states.where(F.col("state_n_contribs") > 0), keys, [order], first)
    top = mode_by(head, keys, "state_primary_pid", "_pid", "_n")
    size = head.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    voted = top.join(size, keys, "inner").where((F.col("_size") >= first) & (F.col("_n") >= need))
    return _with_default(states.select(*keys).distinct(), voted, keys)


def whole_branch_majority(states: DataFrame, keys=BRANCH, share=(2, 3)) -> DataFrame:
    """Particle holding at least two thirds of all measurement states of the branch."""
    keys = list(keys)
    hits = states.where(F.col("state_n_contribs") > 0)
    top = mode_by(hits, keys, "state_primary_pid", "_pid", "_n")
    size = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    voted = top.join(size, keys, "inner").where(F.col("_n") * share[1] >= F.col("_size") * share[0])
    return _with_default(states.select(*keys).distinct(), voted, keys)


def _with_default(branches: DataFrame, voted: DataFrame, keys) -> DataFrame:
    j = branches.join(voted.select(*keys, "_pid"), list(keys), "left")
    return j.select(
        *keys,
        F.coalesce("_pid", F.lit(-1)).cast("long").alias("branch_majority_pid"),
        F.col("_pid").isNull().alias("majority_undefined"),
    )


def with_truth(rows: DataFrame, contribs: DataFrame, majority: DataFrame, simhits: DataFrame, branch="track_nr"):
    """Contributor lists, branch majority and the on-surface flag on every row."""
    return with_contributors(with_majority(rows, majority, simhits, branch), contribs)


def with_contributors(rows: DataFrame, contribs: DataFrame) -> DataFrame:
    """Contributor lists and charge shares of each candidate; empty where there are none."""
    c = contribs.withColumnRenamed("measurement_id", "cand_hit_id")
    return fill_contributors(rows.join(c, ["event_id", "cand_hit_id"], "left"))


def fill_contributors(rows: DataFrame) -> DataFrame:
    """Empty lists where a candidate has no contributors."""
    empty = lambda t: F.array().cast(f"array<{t}>")
    return rows.withColumns(
        {
            "contrib_pids": F.coalesce("contrib_pids", empty("long")),
            "contrib_charge_frac": F.coalesce("contrib_charge_frac", empty("float")),
        }
    )


def with_majority(rows: DataFrame, majority: DataFrame, simhits: DataFrame, branch="track_nr") -> DataFrame:
    """Branch majority and the on-surface flag; both belong to the state, not the candidate."""
    j = rows.join(majority, ["event_id", branch], "left").withColumns(
        {
            "branch_majority_pid": F.coalesce("branch_majority_pid", F.lit(-1)).cast("long"),
            "majority_undefined": F.coalesce("majority_undefined", F.lit(True)),
        }
    )
    return with_on_surface(j, simhits)


def with_on_surface(rows: DataFrame, simhits: DataFrame) -> DataFrame:
    """Does the branch particle have any simhit on the surface of the state?"""
    seen = (
        simhits.select("event_id", F.col("particle_id").alias("branch_majority_pid"), "geometry_id")
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return (
        rows.join(seen, ["event_id", "branch_majority_pid", "geometry_id"], "left")
        .withColumn("majority_true_hit_on_surface", true("_seen") & ~F.col("majority_undefined"))
        .drop("_seen")
    )


def particle_totals(simhits: DataFrame) -> DataFrame:
    """Simhits per particle."""
    return simhits.groupBy("event_id", "particle_id").agg(F.count(F.lit(1)).alias("n_total"))


def branch_totals(majority: DataFrame, simhits: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """Simhit total of each branch's particle; 0 or NULL when it has none."""
    t = particle_totals(simhits).withColumnRenamed("particle_id", "branch_majority_pid")
    j = majority.join(t, ["event_id", "branch_majority_pid"], "left")
    return j.withColumn("n_total", F.coalesce("n_total", F.lit(0))) if missing_as_zero else j


def particle_pt(simhits: DataFrame) -> DataFrame:
    """Transverse momentum at each particle's earliest simhit.

    A missing time sorts last and the file position breaks ties; the first known
    momentum in that order is taken.
    """
    pt = F.hypot("tpx", "tpy")
    known = simhits.withColumn("pt_gev", pt).where(F.col("pt_gev").isNotNull() & ~F.isnan("pt_gev"))
    when = F.when(~F.isnan("tt"), F.col("tt"))
    order = [when.isNull().alias("late"), when.alias("tt"), F.col("hit_id")]
    first = best_by(known, ["event_id", "particle_id"], order, "pt_gev", "pt_gev")
    everyone = simhits.select("event_id", "particle_id").distinct()
    return everyone.join(first, ["event_id", "particle_id"], "left")
