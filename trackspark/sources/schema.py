"""Declared schemas, their defaults and the column checks shared by scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of the expanded candidate table.
CANDIDATE_COLUMNS = (
    "event_id", "seed_id", "branch_id", "parent_branch_id", "step_k", "layer_id", "surface_id", "volume_id",
    "state_l0", "state_l1", "state_phi", "state_theta", "state_qop", "state_t", "cov_00", "cov_01", "cov_02",
    "cov_03", "cov_04", "cov_05", "cov_06", "cov_07", "cov_08", "cov_09", "cov_10", "cov_11", "cov_12", "cov_13",
    "cov_14", "cov_15", "cov_16", "cov_17", "cov_18", "cov_19", "cov_20", "pred_l0", "pred_l1", "cand_hit_id",
    "residual_l0", "residual_l1", "S00", "S01", "S11", "chi2_inc", "var_local0", "var_local1", "is_1d", "clus_s_u",
    "clus_s_v", "clus_q_tot", "clus_sigma_uu", "clus_sigma_uv", "clus_sigma_vv", "alpha_u", "alpha_v", "pitch_u",
    "pitch_v", "thickness", "is_pixel", "is_barrel", "n_window", "geometric_density", "pathInX0_interval",
    "dead_module_flag", "layer_embed_idx", "n_hits", "n_holes", "n_seq_holes", "action_taken", "is_ckf_selected",
    "sel_l0", "sel_l1", "prune_reason", "contrib_pids", "contrib_charge_frac", "branch_majority_pid",
    "majority_undefined", "majority_true_hit_on_surface", "truth_residual_l0", "truth_residual_l1", "vstar_soft",
    "env_config_hash",
)
_IDS = CANDIDATE_COLUMNS[:8]
_LONGS = {
    *_IDS,
    "cand_hit_id",
    "n_window",
    "geometric_density",
    "dead_module_flag",
    "layer_embed_idx",
    "n_hits",
    "n_holes",
    "n_seq_holes",
    "action_taken",
    "prune_reason",
    "branch_majority_pid",
}
_BOOLS = {"is_1d", "is_pixel", "is_barrel", "is_ckf_selected", "majority_undefined", "majority_true_hit_on_surface"}
# Columns of the older table generation are the same without these.
LATER_COLUMNS = ("var_local0", "var_local1", "is_1d", "is_ckf_selected", "sel_l0", "sel_l1")
# Names under which intermediate tables carry schema columns.
ALIASES = {
    "state_l0": "pred_l0",
    "state_l1": "pred_l1",
    "state_phi": "pred_phi",
    "state_theta": "pred_theta",
    "state_qop": "pred_qop",
    "state_t": "pred_t",
    "surface_id": "module_id",
    "seed_id": "track_nr",
    "branch_id": "track_nr",
    "step_k": "state_idx",
}


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def column_type(name: str) -> T.DataType:
    if name == "contrib_pids":
        return T.ArrayType(T.LongType())
    if name == "contrib_charge_frac":
        return T.ArrayType(T.FloatType())
    if name == "env_config_hash":
        return T.StringType()
    if name in _LONGS:
        return T.LongType()
    return T.BooleanType() if name in _BOOLS else T.DoubleType()


def candidate_schema(older: bool = False) -> T.StructType:
    names = [c for c in CANDIDATE_COLUMNS if not (older and c in LATER_COLUMNS)]
    return T.StructType([T.StructField(c, column_type(c)) for c in names])


def column_default(name: str) -> Column:
    """Value of a schema column that a table does not provide."""
    if name == "contrib_pids" or name == "contrib_charge_frac":
        return F.array()
    if name == "majority_undefined":
        return F.lit(True)
    if name == "is_ckf_selected":
        return F.lit(False)
    if name in _LONGS and name not in ("event_id", "step_k", "layer_id", "surface_id"):
        return F.lit(-1)
    return F.lit(None)


def to_schema(df: DataFrame, config_hash: str, columns: Iterable[str] = CANDIDATE_COLUMNS) -> DataFrame:
    """Rename, fill, cast and order the columns of a candidate table."""
    out = []
    for name in columns:
        if name == "env_config_hash":
            c = F.lit(config_hash)
        elif name in df.columns:
            c = F.col(name)
        elif ALIASES.get(name) in df.columns:
            c = F.col(ALIASES[name])
        else:
            c = column_default(name)
        out.append(c.cast(column_type(name)).alias(name))
    return df.select(*out)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, or :class:`MissingColumns`."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return df.select(*names)


def same_schema(tables: Mapping[str, DataFrame]) -> None:
    """Raise unless all tables have the same names and types in the same order."""
    first = None
    for name, df in tables.items():
        if first is None:
            first = (name, df.dtypes)
        elif df.dtypes != first[1]:
            raise ValueError(f"table {name!r} differs from {first[0]!r}: {df.dtypes} != {first[1]}")


# --- decision log ------------------------------------------------------------------------

# Decision-log layout; vectors carry their fixed length.
ACTIONS = {"accepted": 0, "rejected": 1, "hole": 2, "branch_pruned": 3}
PRUNE_REASONS = {
    "none": 0,
    "branch_cap": 1,
    "chi2_measurement": 2,
    "chi2_outlier": 3,
    "global_branch_limit": 4,
    "other": 255,
}
VECTOR_LENGTHS = {
    "state": 6,
    "cov_packed": 21,
    "pred_local": 2,
    "residual": 2,
    "incidence": 2,
    "truth_residual": 2,
}
DECISION_LOG_DDL = """
event_id bigint, seed_id bigint, branch_id bigint, parent_branch_id bigint, step_k int,
layer_id int, surface_id bigint, state array<float>, cov_packed array<float>, pred_local array<float>,
cand_hit_id bigint, residual array<float>, chi2_inc float, cluster_feats array<float>, incidence array<float>,
sensor_props array<float>, occupancy_feats array<float>, context_feats array<float>, branch_feats array<float>,
action_taken tinyint, prune_reason smallint, contrib_pids array<bigint>, contrib_charge_frac array<float>,
branch_majority_pid bigint, majority_true_hit_on_surface tinyint, truth_residual array<float>, vstar_soft float,
env_config_hash string
"""


def decision_log_schema() -> T.StructType:
    return T.StructType.fromDDL(DECISION_LOG_DDL)


def assert_decision_schema(df: DataFrame) -> None:
    missing = [f.name for f in decision_log_schema() if f.name not in df.columns]
    if missing:
        raise MissingColumns(f"decision log lacks {missing}")


def decision_violations(df: DataFrame, config_hash: str, log_prune_reasons: bool = True) -> DataFrame:
    """One row per broken rule and decision row: foreign hash, missing prune reason, wrong vector length."""
    rules = {"foreign_hash": ~F.col("env_config_hash").eqNullSafe(F.lit(config_hash))}
    if log_prune_reasons:
        pruned = F.col("action_taken") == ACTIONS["branch_pruned"]
        rules["missing_prune_reason"] = pruned & (F.coalesce("prune_reason", F.lit(0)) == PRUNE_REASONS["none"])
    for name, n in VECTOR_LENGTHS.items():
        if name in df.columns:
            rules[f"length_{name}"] = F.coalesce(F.size(name), F.lit(-1)) != n
    hits = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    keys = [k for k in ("event_id", "seed_id", "branch_id", "step_k", "cand_hit_id") if k in df.columns]
    return df.select(*keys, F.explode(hits).alias("rule"))


def check_forbidden_cut(config: Mapping[str, object]) -> None:
    """A local-position cut must be absent from envelope collection."""
    if config.get("forbid_loc0_cut", True) and config.get("ckf_loc0_max") is not None:
        raise ValueError("ckf_loc0_max is set although the cut is forbidden for this collection")
