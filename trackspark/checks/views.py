"""Operator inputs derived from the given tables.

Each view is one SQL text that Spark and DuckDB read alike: ``{t:name}`` stands for
a given table, ``{arr}`` for the array constructor. Literals with an exponent are
doubles in both engines. Views may build on views listed before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_path

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
#: Views that one other view reads, once, or that are plain columns of a given table: Spark plans them with their reader.
INLINE: set[str] = set()
#: Those of plain columns: never stored, as reading the given table again costs no more.
PLAIN: set[str] = set()
#: Columns that Spark deals a stored view by, for a view that groups within those columns all the way.
DEALT: dict[tuple[str, str], str] = {}
#: Text that Spark reads for a view instead of the common one: the same for every reader of the view, in fewer or smaller rows.
SPARK_TEXT: dict[str, str] = {}
#: Columns of a stored view that follow from its others: not written, computed when it is read. Long rows make slow tasks.
ON_READ: dict[str, str] = {}


def view(name: str, *needs: str, inline: bool = False, plain: bool = False, spark: str | None = None, on_read: str | None = None, **dealt: str):
    def add(text: str) -> None:
        VIEWS[name] = (needs, text)
        if inline or plain:
            INLINE.add(name)
        if plain:
            PLAIN.add(name)
        if spark:
            SPARK_TEXT[name] = spark
        if on_read:
            ON_READ[name] = on_read
        DEALT.update({(name, needed): columns for needed, columns in dealt.items()})

    return add


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def _render(text: str, table, arr: str) -> str:
    import re

    return re.sub(r"\{t:(\w+)\}", lambda m: table(m.group(1)), text).replace("{arr}", arr)


def with_clause(names, table, arr: str) -> str:
    parts = [f"{n} AS ({_render(VIEWS[n][1], table, arr)})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) if parts else ""


def duckdb_sql(names, sql: str) -> str:
    return f"{with_clause(names, lambda t: t, 'list_value')}\n{sql}"


_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Inputs:
    """Views over one folder of tables.

    Operators expect stored tables, so each view is written once per application to
    the shared folder and read from there; plain columns of a given table are read from that.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name in PLAIN:
            return self._derive(name)
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _STORED:
            for needed in self._needs(name)[0]:
                getattr(self, needed)
            path = scratch_path(self.spark, f"view-{name}")
            df = self._derive(name)
            if name in ON_READ:
                computed = self.spark.sql(f"SELECT {ON_READ[name]} FROM {{df}}", df=df).columns
                df.drop(*computed).write.parquet(path)
            else:
                df.write.parquet(path)
            _STORED[key] = (path, df.schema)
        path, schema = _STORED[key]
        if name not in ON_READ:
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.sql(f"SELECT {', '.join(schema.names)} FROM ({self._read(name)}) stored")

    def _read(self, name: str, hint: str = "") -> str:
        path = _STORED[self.spark.sparkContext.applicationId, self.dir, name][0]
        more = f", {ON_READ[name]}" if name in ON_READ else ""
        return f"SELECT {hint}*{more} FROM parquet.`{path}`"

    def _needs(self, name: str) -> tuple[list[str], list[str]]:
        """Views to be stored before ``name``, and those planned with it, in order."""
        stored: list[str] = []
        planned: list[str] = []
        for needed in VIEWS[name][0]:
            if needed in INLINE:
                below = self._needs(needed)
                stored += below[0]
                planned += [*below[1], needed]
            else:
                stored.append(needed)
        return list(dict.fromkeys(stored)), list(dict.fromkeys(planned))

    def _derive(self, name: str) -> DataFrame:
        """The view over the given tables and the stored views it needs."""
        stored, planned = self._needs(name)
        hint = {n: f"/*+ REPARTITION({DEALT[name, n]}) */ " if (name, n) in DEALT else "" for n in stored}
        parts = [f"{n} AS ({self._read(n, hint[n])})" for n in stored]
        parts += [f"{n} AS ({self._text(n)})" for n in planned]
        return self.spark.sql((f"WITH {', '.join(parts)} " if parts else "") + f"SELECT * FROM ({self._text(name)}) v")

    def _text(self, name: str) -> str:
        return _render(SPARK_TEXT.get(name, VIEWS[name][1]), lambda t: f"parquet.`{self.dir}/{t}.parquet`", "array")


# --- candidate rows -----------------------------------------------------------------------
# Branch = supplier and year, step = month, candidate = part. Lines of large quantity and
# those on the passive volume are no candidates; a state left without any is a hole.

# Dealt once, by supplier. Of lines that are no candidates only the state counts, and of the flag whether the least
# is R: without texts the lines merge by hashing, before anything is sorted.
_VOLUME = """CASE (branch_id + step_k) % 10
                 WHEN 0 THEN 16 WHEN 1 THEN 17 WHEN 2 THEN 18 WHEN 3 THEN 20 WHEN 4 THEN 23
                 WHEN 5 THEN 24 WHEN 6 THEN 25 WHEN 7 THEN 28 WHEN 8 THEN 29 ELSE 30 END"""
_MERGED_LINES = f"""
    SELECT event_id, branch_id, step_k, cand_hit_id, {_VOLUME} AS vol, q, d, t, p,
           CASE WHEN flag = 1 THEN 'R' ELSE '' END AS rf, n_window
    FROM (
        SELECT *, count(CASE WHEN cand_hit_id >= 0 THEN 1 END) OVER (PARTITION BY event_id, branch_id, step_k) AS n_window
        FROM (
            SELECT event_id, branch_id, step_k, cand_hit_id, min(q) AS q, min(d) AS d, min(t) AS t, min(p) AS p, min(flag) AS flag
            FROM (
                SELECT /*+ REPARTITION(branch_id) */ event_id, branch_id, step_k, cand_hit_id,
                       CASE WHEN used THEN l_quantity END AS q, CASE WHEN used THEN l_discount END AS d,
                       CASE WHEN used THEN l_tax END AS t, CASE WHEN used THEN l_extendedprice END AS p,
                       CASE WHEN NOT used THEN NULL WHEN l_returnflag < 'R' THEN 0 WHEN l_returnflag = 'R' THEN 1
                            WHEN l_returnflag > 'R' THEN 2 END AS flag
                FROM (
                    SELECT *, coalesce(cand_hit_id >= 0, true) AS used
                    FROM (
                        SELECT *, CASE WHEN l_quantity <= 15 AND {_VOLUME} <> 20 THEN l_partkey ELSE -1 END AS cand_hit_id
                        FROM (
                            SELECT *, CAST(year(l_shipdate) AS BIGINT) AS event_id, l_suppkey AS branch_id,
                                   CAST(month(l_shipdate) - 1 AS BIGINT) AS step_k
                            FROM {{t:lineitem}}
                        ) a
                    ) b
                ) c
            ) g
            GROUP BY 1, 2, 3, 4
        ) h
    ) e
    WHERE cand_hit_id >= 0 OR n_window = 0
    """

view("cand_base", inline=True, spark=_MERGED_LINES)(
    """
    SELECT event_id, branch_id, step_k, cand_hit_id, vol, q, d, t, p, rf, n_window
    FROM (
        SELECT *, count(CASE WHEN cand_hit_id >= 0 THEN 1 END)
                    OVER (PARTITION BY event_id, branch_id, step_k) AS n_window
        FROM (
            SELECT event_id, branch_id, step_k, vol,
                   CASE WHEN l_quantity <= 15 AND vol <> 20 THEN l_partkey ELSE -1 END AS cand_hit_id,
                   min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t,
                   min(l_extendedprice) AS p, min(l_returnflag) AS rf
            FROM (
                SELECT *,
                       CASE (branch_id + step_k) % 10
                            WHEN 0 THEN 16 WHEN 1 THEN 17 WHEN 2 THEN 18 WHEN 3 THEN 20 WHEN 4 THEN 23
                            WHEN 5 THEN 24 WHEN 6 THEN 25 WHEN 7 THEN 28 WHEN 8 THEN 29 ELSE 30 END AS vol
                FROM (
                    SELECT *, CAST(year(l_shipdate) AS BIGINT) AS event_id, l_suppkey AS branch_id,
                           CAST(month(l_shipdate) - 1 AS BIGINT) AS step_k
                    FROM {t:lineitem}
                ) a
            ) b
            GROUP BY 1, 2, 3, 4, 5
        ) c
    ) e
    WHERE cand_hit_id >= 0 OR n_window = 0
    """
)

view("cand_values", "cand_base", inline=True)(
    """
    SELECT event_id, branch_id, step_k, cand_hit_id, n_window, rf, p,
           CAST(vol AS BIGINT) AS volume_id, 2 + 2 * (step_k % 4) AS layer_id, 1 + branch_id % 9 AS module_id,
           vol IN (28, 29, 30) AS flat,
           CASE WHEN cand_hit_id >= 0 THEN (q - 8e0) * (5e-1 + CAST(floor(p) AS BIGINT) % 5) END AS residual_l0,
           CASE WHEN cand_hit_id >= 0 AND vol NOT IN (28, 29, 30) THEN (d - 5e-2) * 4e1 END AS residual_l1,
           CASE WHEN cand_hit_id >= 0 THEN 5e-1 + d * 1e1 END AS s00,
           CASE WHEN cand_hit_id >= 0 AND vol NOT IN (28, 29, 30) THEN (d * 1e1 - 3e-1) * 3e-1 END AS s01,
           CASE WHEN cand_hit_id >= 0 AND vol NOT IN (28, 29, 30) THEN 7e-1 + t * 1e1 END AS s11,
           CASE WHEN rf = 'R' THEN cand_hit_id % 40 ELSE branch_id % 40 END AS pid
    FROM cand_base
    """
)

# Columns of a branch, state or hit number alone: Spark computes them when it reads the stored view.
_OF_BRANCH = """volume_id IN (16, 17, 18) AS is_pixel,
           CASE WHEN branch_id % 17 = 0 THEN -1 ELSE branch_id % 40 END AS branch_majority_pid,
           branch_id % 17 = 0 AS majority_undefined"""
_OF_STATE = """(branch_id * 7 + step_k * 3) % 4 <> 0 AS majority_true_hit_on_surface,
           15e-2 + 28e-1 * ((branch_id * 37 + step_k * 11) % 101) / 101e0 AS state_theta,
           (branch_id % 21 - 10) / 10e0 AS state_qop,
           1e-2 * ((branch_id + step_k * 5) % 7) AS pathInX0_interval,
           step_k AS n_hits, branch_id % 3 AS n_holes, branch_id % 2 AS n_seq_holes,
           1e-1 + 1e-2 * (branch_id % 5) AS cov_00, 2e-1 + 1e-2 * (step_k % 5) AS cov_06,
           n_window + (branch_id + step_k) % 4 AS geometric_density,
           CASE WHEN cand_hit_id >= 0 THEN 0 ELSE 2 END AS action_taken,
           CASE WHEN branch_id % 4 = 0 THEN NULL ELSE (branch_id % 11) / 10e0 END AS vstar_soft,
           1e-1 * (branch_id % 50) AS pred_l0, 1e-1 * (step_k % 7) AS pred_l1,
           CASE WHEN cand_hit_id >= 0 THEN 1e0 + cand_hit_id % 4 END AS clus_s_u,
           CASE WHEN cand_hit_id >= 0 THEN 1e0 + cand_hit_id % 3 END AS clus_s_v"""
_OF_HIT = """CASE WHEN cand_hit_id >= 0 THEN 1e-1 * (cand_hit_id % 6) END AS clus_sigma_uu,
           CASE WHEN cand_hit_id >= 0 THEN 5e-2 * (cand_hit_id % 2) END AS clus_sigma_uv,
           CASE WHEN cand_hit_id >= 0 THEN 1e-1 * (cand_hit_id % 7) END AS clus_sigma_vv,
           1e-1 * (branch_id % 9) - 4e-1 AS alpha_u, 1e-1 * (step_k % 5) - 2e-1 AS alpha_v,
           5e-2 AS pitch_u"""

_CAND = f"""
    SELECT event_id, branch_id AS seed_id, branch_id, step_k, cand_hit_id, n_window, volume_id, layer_id, module_id,
           residual_l0, residual_l1, s00 AS S00, s01 AS S01, s11 AS S11, chi2_inc,
           flat AND cand_hit_id >= 0 AS is_1d, {_OF_BRANCH},
           CASE WHEN cand_hit_id < 0 OR cand_hit_id % 23 = 0 THEN NULL
                WHEN cand_hit_id % 5 = 0 THEN {{arr}}(pid, (pid + 1) % 40)
                ELSE {{arr}}(pid) END AS contrib_pids,
           cand_hit_id >= 0 AND (branch_id + step_k) % 6 <> 0
             AND row_number() OVER (PARTITION BY event_id, branch_id, step_k ORDER BY chi2_inc, cand_hit_id) = 1
             AS is_ckf_selected,
           {_OF_STATE},
           CASE WHEN cand_hit_id >= 0 THEN p / 1e3 END AS clus_q_tot,
           {_OF_HIT}, CASE WHEN flat THEN NULL ELSE 5e-2 + 1e-3 * volume_id END AS pitch_v,
           15e-2 AS thickness
    FROM (
        SELECT *,
               CASE WHEN s00 IS NULL THEN NULL
                    WHEN flat THEN residual_l0 * residual_l0 / s00
                    ELSE (s11 * residual_l0 * residual_l0 - 2e0 * s01 * residual_l0 * residual_l1
                          + s00 * residual_l1 * residual_l1) / (s00 * s11 - s01 * s01) END AS chi2_inc
        FROM cand_values
    ) x
    """

view(
    "cand",
    "cand_values",
    on_read=f"branch_id AS seed_id, {_OF_BRANCH}, {_OF_STATE}, {_OF_HIT}",
)(_CAND)

# Two branches per seed.
view("fork", "cand")(
    """
    SELECT event_id, CAST(floor(branch_id / 2e0) AS BIGINT) AS seed_id, branch_id, step_k, cand_hit_id,
           is_ckf_selected, contrib_pids, branch_majority_pid, majority_undefined, chi2_inc
    FROM cand
    """
)

# --- simhits, particles --------------------------------------------------------------------

view("simhits", plain=True)(
    """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_orderkey AS hit_id, o_custkey % 40 AS particle_id,
           o_custkey % 7 AS geometry_id, o_totalprice / 2e5 AS tpx, CAST(o_custkey % 13 AS DOUBLE) / 2e1 AS tpy,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(month(o_orderdate) AS DOUBLE) END AS tt
    FROM {t:orders}
    """
)

# --- expansion input -------------------------------------------------------------------------

view("states")(
    """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_custkey AS track_nr, o_orderkey AS state_idx,
           o_custkey % 7 AS geometry_id, true AS is_predicted, o_totalprice / 1e4 AS pred_l0,
           1e-1 * (o_custkey % 10) AS pred_l1,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1e-4 * (1 + o_custkey % 5) END AS S00,
           0e0 AS S01, 1e-2 * (1 + o_orderkey % 3) AS S11,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e4 + 1e-2 END AS sel_l0,
           CASE WHEN o_orderkey % 2 = 0 THEN 3e-1 END AS sel_l1
    FROM {t:orders}
    """
)

view("meas")(
    """
    SELECT CAST(year(min(l_shipdate)) AS BIGINT) AS event_id, l_orderkey * 10 + l_linenumber AS measurement_id,
           min(l_suppkey) % 7 AS geometry_id, min(l_extendedprice) / 2e3 AS local0,
           1e-1 * (min(l_partkey) % 12) AS local1, 1e-3 AS var_local0,
           CASE WHEN min(l_partkey) % 4 = 0 THEN 0e0 ELSE 1e-2 END AS var_local1
    FROM {t:lineitem} GROUP BY l_orderkey, l_linenumber
    """
)

view("pcov")(
    """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_custkey AS track_nr, o_orderkey AS state_idx,
           1e-4 * (1 + o_custkey % 5) AS P00, 1e-5 * (o_orderkey % 4) AS P01, 1e-3 * (1 + o_orderkey % 3) AS P11
    FROM {t:orders}
    """
)

# Probabilities are rounded to nine digits: the engines' exp() may differ in the last bit, which
# would make equal scores unequal.
# --- scores ------------------------------------------------------------------------------------

view("scores")(
    """
    SELECT event_id, logit, round(1e0 / (1e0 + exp(-logit)), 9) AS prob, label, n_window, eta, chi2_inc, target, row_part
    FROM (
        SELECT CAST(year(l_shipdate) AS BIGINT) AS event_id,
               (l_discount - 5e-2) * 4e1 + (l_quantity - 25e0) / 12e0 - 7e-1 AS logit,
               CASE WHEN l_returnflag = 'R' OR (l_quantity > 40 AND l_linenumber > 2) THEN 1 ELSE 0 END AS label,
               1 + CAST(l_quantity AS BIGINT) % 9 AS n_window, (l_tax * 1e2 - 4e0) * 9e-1 AS eta,
               l_quantity * l_quantity / 8e1 + l_tax AS chi2_inc, (l_partkey % 11) / 10e0 AS target,
               l_partkey AS row_part
        FROM {t:lineitem}
    ) s
    """
)

# --- tracks ----------------------------------------------------------------------------------------

view("flat")(
    """
    SELECT l_orderkey % 5 AS event_id, l_orderkey AS track_nr, CAST(l_linenumber AS BIGINT) AS state_idx,
           min(l_partkey) % 6 AS pid, min(l_suppkey) % 4 AS volume_id, min(l_partkey) % 3 AS layer_id,
           min(l_suppkey) % 5 AS module_id, min(l_quantity) / 1e1 AS truth_l0, min(l_tax) * 1e1 AS truth_l1,
           min(l_discount) * 2e1 AS pred_l0, 4e-1 AS pred_l1, 1e-2 * (1 + min(l_partkey) % 5) AS S00, 4e-2 AS S11
    FROM {t:lineitem} GROUP BY l_orderkey, l_linenumber
    """
)

view("particles")(
    """
    SELECT c_nationkey % 5 AS event_id, c_custkey AS particle_id, abs(c_acctbal) / 2e3 AS pt,
           CAST(3 + c_custkey % 9 AS BIGINT) AS n_hits
    FROM {t:customer}
    """
)

view("tracks")(
    """
    SELECT c.c_nationkey % 5 AS event_id, o.o_orderkey AS track_nr, o.o_custkey AS majority_pid,
           CASE WHEN o.o_orderstatus = 'F' THEN 1 WHEN o.o_orderstatus = 'O' THEN 2 ELSE 3 END AS track_class,
           o.o_totalprice / 1e5 AS track_pt, CAST(5 + o.o_orderkey % 8 AS BIGINT) AS n_measurements,
           CAST(o.o_orderkey % 2 AS BIGINT) AS n_outliers, CAST(3 + o.o_orderkey % 6 AS BIGINT) AS n_majority_hits
    FROM {t:orders} o JOIN {t:customer} c ON o.o_custkey = c.c_custkey
    """
)

view("seeds")(
    """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS event_id, o_orderkey AS seed_id,
           1e-1 * (o_custkey % 5) AS bX, 2e-1 * (o_custkey % 3) AS bY, 0e0 AS bZ,
           1e0 * (o_custkey % 7) AS mX, 5e-1 * (o_custkey % 2) AS mY, 1e0 AS mZ,
           1e0 * (o_custkey % 11) AS tX, 25e-2 * (o_orderkey % 4) AS tY, 2e0 AS tZ,
           o_totalprice / 1e5 AS pT, o_totalprice AS quality, o_orderpriority
    FROM {t:orders}
    """
)

view("points")(
    """
    SELECT s_suppkey AS run_id, sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) AS efficiency,
           avg(l_tax) AS fake_rate, avg(l_quantity) AS wall_seconds
    FROM {t:supplier} JOIN {t:lineitem} ON l_suppkey = s_suppkey GROUP BY s_suppkey
    """
)
