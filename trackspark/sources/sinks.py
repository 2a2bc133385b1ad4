"""Writers: candidate tables, feature tables with their meta row, worklists and back-fills."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import count_if
from .schema import require_columns, same_schema, to_schema

# Settings that make up the environment hash.
HASHED_SETTINGS = (
    "window_n",
    "num_seeds_per_spm",
    "seed_minPt",
    "seed_impactMax",
    "seed_sigmaScattering",
    "ckf_chi2CutOffMeasurement",
    "ckf_chi2CutOffOutlier",
    "ckf_numMeasurementsCutOff",
    "ckf_nMeasurementsMin",
    "ckf_maxHolesAndOutliers",
    "ckf_ptMin",
    "digi_config",
    "forbid_loc0_cut",
)


def config_hash(config: Mapping[str, object], keys: Sequence[str] | None = HASHED_SETTINGS) -> str:
    """First 16 hex digits of the SHA-256 of the canonical settings."""
    payload = dict(config) if keys is None else {k: config.get(k) for k in keys}
    text = json.dumps(payload, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def config_hash_column(fields: Sequence[str]):
    """The same kind of hash over columns of a table of settings."""
    packed = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]))
    return F.substring(F.sha2(packed, 256), 1, 16)


def write_candidates(df: DataFrame, path: str, hash_value: str, mode: str = "errorifexists") -> None:
    """Candidate table partitioned by event, sorted by branch and step inside each file.

    Rows are dealt by ranges of (event, seed): a large event is written by many tasks,
    each file holds a run of its seeds, and a point read opens the one that has it.
    """
    out = to_schema(df, hash_value)
    (
        out.repartitionByRange("event_id", "seed_id")
        .sortWithinPartitions("event_id", "seed_id", "branch_id", "step_k", "cand_hit_id")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("event_id")
        .parquet(path)
    )


def write_features(
    features: DataFrame,
    path: str,
    names: Sequence[str],
    label: str,
    partition: Sequence[str] = (),
    is_partial: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Feature table and its meta row (rows, positives, names, sources, partial marker).

    Counts come from the written table, so they describe what readers will see.
    """
    writer = features.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{path}/rows")
    stored = features.sparkSession.read.parquet(f"{path}/rows")
    feature_meta(stored, names, label, is_partial).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def feature_meta(stored: DataFrame, names: Sequence[str], label: str, is_partial: bool = False) -> DataFrame:
    sources = F.count_distinct("event_id") if "event_id" in stored.columns else F.lit(None).cast("long")
    return stored.agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(F.col(label) > 0.5).alias("n_pos"), sources.alias("n_sources")
    ).select(
        "n_rows",
        "n_pos",
        "n_sources",
        F.array(*[F.lit(n) for n in names]).alias("feature_names"),
        F.lit(is_partial).alias("is_partial"),
    )


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows and meta row; refuses a table whose row count differs from its meta."""
    rows, meta = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/meta")
    m = meta.first()
    require_columns(rows, m.feature_names)
    if rows.count() != m.n_rows:
        raise ValueError(f"{path}: row count differs from its meta row")
    return rows, meta


def concat_windows(tables: Mapping[float, DataFrame]) -> DataFrame:
    """Feature tables of several windows as one, after checking that they agree."""
    same_schema({str(k): v for k, v in tables.items()})
    out = None
    for window, df in tables.items():
        part = df if "window_nsigma" in df.columns else df.withColumn("window_nsigma", F.lit(float(window)))
        out = part if out is None else out.unionByName(part)
    return out


def write_worklist(work: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Worklist rows numbered 0.. per event in (seed_id, step_k) order, as CSV; returns them.

    Numbers come from per-bucket counts over the seed range, not from one sorted task.
    """
    numbered = number_worklist(work)
    numbered.write.mode(mode).option("header", True).csv(path)
    return numbered


def number_worklist(work: DataFrame) -> DataFrame:
    from ..operators.ordered import value_prefix

    p = value_prefix(work, "seed_id", {"_one": F.lit(1)}, by=["event_id"], ties=["step_k"])
    rest = [c for c in work.columns if c != "event_id"]
    return p.select("event_id", F.col("_one_before").cast("long").alias("rollout_id"), *rest)


def back_fill(
    table: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Fill missing values of ``columns`` from another table, and report the fill rates.

    The result is a new table; nothing is changed in place.
    """
    s = source.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in columns])
    j = table.join(s, list(keys), "left")
    old = {c: F.col(c) if c in table.columns else F.lit(None) for c in columns}
    filled = j.withColumns({c: F.coalesce(old[c], F.col(f"_f_{c}")) for c in columns})
    report = j.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(old[c]).alias(f"{c}_before") for c in columns],
        *[F.count(F.coalesce(old[c], F.col(f"_f_{c}"))).alias(f"{c}_after") for c in columns],
    )
    return filled.drop(*[f"_f_{c}" for c in columns]), report
