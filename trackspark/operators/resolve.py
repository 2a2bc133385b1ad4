"""Greedy resolution of branches that share hits.

The rule: while the branch with the highest shared-hit fraction (then fewer
hits, then larger chi2, then lower id) shares at least ``max_shared`` hits, drop
it. Written sequentially this is one global priority loop; here the connected
components of the branch-hit graph run it on their own.

Why components can: a branch's fraction changes only when another owner of one of its
hits is dropped, so never from another component. Priorities only fall, so the global
loop is the merge of the components' pops in falling order, and it ends at the first
popped branch, of any component, that shares too little: at the highest of the
components' stop keys (the bar). What a component drops above the bar is dropped,
what it drops below it stays.

A component of more than ``COMPONENT_ROWS`` rows is not given to one task: whole sets of its
branches are decided per round. Look at a shared hit and order its owners by
priority. If a branch is not the last of them, then at the moment it is popped the
hit still has at least two owners, whatever happened to those before it. A branch
that is last on none of its shared hits is therefore popped with exactly its
present priority.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if, true
from ..session import cut_lineage, discard, scratch_path
from .graph import components

BRANCH = ("event_id", "seed_id")
#: Branch-hit rows of a component that one task resolves.
COMPONENT_ROWS = 1_000_000
POPS = "event_id long, seed_id long, fraction double, few long, chi2 double, stop boolean"


def branch_hits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct accepted hits of each branch, and its hit count and chi2 sum."""
    picked = rows.where(true("is_ckf_selected"))
    hits = picked.select(*BRANCH, "cand_hit_id").distinct()
    size = hits.groupBy(*BRANCH).agg(F.count(F.lit(1)).alias("n_hits"))
    chi2 = picked.groupBy(*BRANCH).agg(F.sum("chi2_inc").alias("chi2_sum"))
    return hits, size.join(chi2, list(BRANCH), "inner")


def duplicated_hits(rows: DataFrame) -> DataFrame:
    """Branches that list a hit twice (the rule assumes there are none)."""
    picked = rows.where(true("is_ckf_selected")).groupBy(*BRANCH, "cand_hit_id").agg(F.count(F.lit(1)).alias("n"))
    return picked.where(F.col("n") > 1)


def _key():
    return F.struct("fraction", "few", "chi2", (-F.col("seed_id")).alias("seed"))


def resolve_shared(rows: DataFrame, max_shared: int = 3, min_hits: int = 7, refuse_repeats: bool = False) -> DataFrame:
    """``survived`` for every branch that occurs in ``rows``.

    A hit that a branch lists twice counts once, or is an error with ``refuse_repeats``.
    """
    if max_shared < 1:
        raise ValueError("max_shared must be 1 at least")
    if refuse_repeats and not duplicated_hits(rows).isEmpty():
        raise ValueError("some branch lists a hit twice")
    hits, branches = branch_hits(rows)
    long_enough = branches.where(F.col("n_hits") >= min_hits)
    owned = cut_lineage(hits.join(long_enough, list(BRANCH), "inner"), "owned")
    # Only shared hits matter from here on: a branch without one is popped after all that are dropped.
    hit = ["event_id", "cand_hit_id"]
    owners = owned.groupBy(*hit).agg(F.count(F.lit(1)).alias("_n"), F.min("seed_id").alias("_first")).where("_n > 1")
    shared = cut_lineage(owned.join(cut_lineage(owners, "owners"), hit), "shared")
    discard(owned)
    labels = components(shared, ["event_id"], "seed_id", "_first").withColumnRenamed("node", "seed_id")
    placed = cut_lineage(shared.drop("_n", "_first").join(labels, list(BRANCH)), "placed")
    sizes = placed.groupBy("event_id", "component").agg(F.count(F.lit(1)).alias("_rows"))
    giants = cut_lineage(sizes.where(F.col("_rows") > COMPONENT_ROWS).drop("_rows"), "giants")
    group = ["event_id", "component"]
    pops = placed.join(giants, group, "left_anti").groupBy(*group).applyInPandas(_pops(max_shared), POPS)
    if not giants.isEmpty():
        pops = pops.unionByName(_rounds(placed.join(giants, group, "left_semi").drop("component"), max_shared))
    keyed = cut_lineage(pops.select(*BRANCH, _key().alias("key"), "stop"), "pops")
    discard(placed)
    bar = keyed.where("stop").groupBy("event_id").agg(F.max("key").alias("bar"))
    gone = keyed.where("NOT stop").join(bar, ["event_id"], "left").where(F.col("bar").isNull() | (F.col("key") > F.col("bar")))
    keep = long_enough.select(*BRANCH).join(gone.select(*BRANCH), list(BRANCH), "left_anti")
    everyone = rows.select(*BRANCH).distinct()
    return everyone.join(keep.withColumn("_k", F.lit(True)), list(BRANCH), "left").select(
        *BRANCH, F.coalesce("_k", F.lit(False)).alias("survived")
    )


def _pops(max_shared: int):
    """Pops of one component in order, down to the first that shares too little."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        event = int(group["event_id"].iloc[0])
        hits: dict[int, list[int]] = {}
        owners: dict[int, set[int]] = {}
        for s, h in zip(group["seed_id"].tolist(), group["cand_hit_id"].tolist(), strict=True):
            hits.setdefault(s, []).append(h)
            owners.setdefault(h, set()).add(s)
        facts = group.drop_duplicates("seed_id").set_index("seed_id")
        size, chi2 = facts["n_hits"].to_dict(), facts["chi2_sum"].to_dict()
        shared = {s: len(h) for s, h in hits.items()}

        def entry(s: int) -> tuple:
            # The largest priority first; a missing chi2 is the smallest.
            c = chi2[s]
            return (-shared[s] / size[s], size[s], (1, 0.0) if c is None or c != c else (0, -c), s, shared[s])

        heap = [entry(s) for s in hits]
        heapq.heapify(heap)
        out: list[tuple] = []
        gone: set[int] = set()
        while heap:
            *_, s, n = heapq.heappop(heap)
            if s in gone or n != shared[s]:
                continue
            out.append((event, s, shared[s] / size[s], -size[s], chi2[s], n < max_shared))
            if n < max_shared:
                break
            gone.add(s)
            for h in hits[s]:
                left = owners[h]
                left.discard(s)
                if len(left) == 1:
                    (other,) = left
                    shared[other] -= 1
                    heapq.heappush(heap, entry(other))
        return pd.DataFrame(out, columns=["event_id", "seed_id", "fraction", "few", "chi2", "stop"])

    return run


def _rounds(owned: DataFrame, max_shared: int) -> DataFrame:
    """Pops of components of any size, as ``POPS``; a table of constant plan size.

    Each round is two aggregations and two joins over the hits that some undecided branch still shares.
    The undecided branch of highest priority is decided in any round, so the loop ends.
    """
    spark = owned.sparkSession
    found = scratch_path(spark, "pops")
    spark.createDataFrame([], POPS).write.parquet(found)
    owned = cut_lineage(owned.withColumn("fixed", F.lit(False)), "owned")
    while True:
        bar = spark.read.schema(POPS).parquet(found).where("stop").groupBy("event_id").agg(F.max(_key()).alias("bar"))
        state = cut_lineage(_round(owned, bar), "decided")
        decided = state.where("decided").withColumn("stop", F.col("shared") < max_shared)
        decided.select("event_id", "seed_id", "fraction", F.col("few").cast("long").alias("few"), "chi2", "stop").write.mode("append").parquet(found)
        counts = state.agg(count_if(F.col("decided")).alias("n"), count_if(~F.col("decided")).alias("left")).first()
        if not counts.n or not counts.left:
            return spark.read.schema(POPS).parquet(found)
        # Popped branches give up their hits; those that stop keep theirs but are settled.
        evicted = decided.where("NOT stop").select(*BRANCH)
        settled = decided.where("stop").select(*BRANCH, F.lit(True).alias("_now"))
        rest = (
            owned.join(evicted, list(BRANCH), "left_anti")
            .join(settled, list(BRANCH), "left")
            .withColumn("fixed", F.col("fixed") | F.coalesce("_now", F.lit(False)))
            .drop("_now")
        )
        live = rest.groupBy("event_id", "cand_hit_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and("fixed").alias("_done"))
        live = live.where("_n > 1 AND NOT _done").select("event_id", "cand_hit_id")
        smaller = cut_lineage(rest.join(live, ["event_id", "cand_hit_id"], "left_semi"), "owned")
        discard(owned)
        discard(state)
        owned = smaller


def _round(owned: DataFrame, bar: DataFrame) -> DataFrame:
    """Present priority of each undecided branch and whether it can be decided now. All hits of ``owned`` are shared."""
    per_branch = owned.groupBy(*BRANCH).agg(
        F.count(F.lit(1)).alias("shared"), F.max("n_hits").alias("n_hits"), F.max("chi2_sum").alias("chi2"), F.max("fixed").alias("fixed")
    )
    ranked = per_branch.withColumns({"fraction": F.col("shared") / F.col("n_hits"), "few": -F.col("n_hits")}).withColumn("key", _key())
    # Below the bar nothing is ever popped again.
    ranked = (
        ranked.join(bar, ["event_id"], "left")
        .withColumn("fixed", F.col("fixed") | F.coalesce(F.col("key") < F.col("bar"), F.lit(False)))
        .drop("bar")
    )
    on_hit = owned.select(*BRANCH, "cand_hit_id").join(ranked.select(*BRANCH, "key"), list(BRANCH), "inner")
    last = on_hit.groupBy("event_id", "cand_hit_id").agg(F.min("key").alias("_last"))
    blocked = (
        on_hit.join(last, ["event_id", "cand_hit_id"], "inner")
        .where(F.col("key") == F.col("_last"))
        .select(*BRANCH)
        .distinct()
        .withColumn("_blocked", F.lit(True))
    )
    return (
        ranked.where(~F.col("fixed"))
        .join(blocked, list(BRANCH), "left")
        .withColumn("decided", F.col("_blocked").isNull())
        .drop("_blocked", "fixed", "key")
    )
