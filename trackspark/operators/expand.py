"""Build the candidate table: states matched to measurements inside a search window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.expr import col, count_if, finite, true
from ..functions.geometry import half_width, in_box, in_radius
from ..session import cut_lineage
from .nearest import nearest_in_group
from .ordered import CHUNK, CHUNK_WIDTH, in_chunks, passes_chunk, running
from .window_counts import count_in_windows

# Meaning of ``action_taken``.
ACTION_CANDIDATE = 0
ACTION_HOLE_NO_MEASUREMENTS = 1
ACTION_HOLE_WINDOW_FAILURE = 2
WINDOW_N = 10.0
GEOMETRIC_RADIUS = 5.0
SELECTED_TOLERANCE = 1e-4
#: Level of the states that reach everywhere: their strip is the whole surface.
WHOLE = 2000
#: Measurements of a strip, about, and the least and most of a chunk of it.
STRIP, CHUNKS = 1 << 14, (16, 256)
#: A strip is at least this many reaches wide; levels of strips differ by this many powers of two.
ROOM, LADDER = 8, 4
MIN_MATCHED = 0.95

STATE = ("event_id", "track_nr", "state_idx")
SURFACE = ("event_id", "geometry_id")
#: Where states and measurements meet: a strip of one level of a surface.
MEET = (*SURFACE, "_code", "_strip")
#: Tasks for each core in a join of pairs.
TASKS = 4


class WriteRefused(ValueError):
    """A guard failed; nothing has been written."""


@dataclass
class Meeting:
    """How the surfaces of some states and measurements are cut, and the measurements.

    ``levels`` and ``uncertain`` have the widest reach of the states and of the measurements of each level in use; strips of
    level ``k`` are ``2**k`` wide along the first coordinate. A strip's measurements go into chunks of ``chunk``, ``across`` of them
    side by side along the second coordinate. None of these changes the pairs.
    """

    measurements: DataFrame
    n: float
    radius: float
    built: bool
    base: int
    levels: dict[int, float]
    uncertain: dict[int, float]
    chunk: int
    across: int

    def place(self, states: DataFrame) -> DataFrame:
        """States at the strip in which they meet all measurements of their level or less, and at one for each level above."""
        reach = _reach(states, self.n, self.radius, self.built, 0)
        own = _level(reach, self.base)
        lifted = [F.when(own < b, F.lit(b)) for b in self.uncertain if b > min(self.levels)]
        at = states.withColumn("_level", F.explode(F.array_compact(F.array(own, *lifted))) if lifted else own)
        code = F.col("_level") * 2 + (F.col("_level") != own).cast("int") if lifted else F.col("_level") * 2
        return at.withColumns({"_code": code, "_strip": _strip_of(F.col("pred_l0"), F.col("_level"))}).drop("_level")

    def deal(self, extra: DataFrame | None = None) -> DataFrame:
        """The measurements in chunks, which lie close together within a strip, with columns of ``extra`` (by event and ``cand_hit_id``)."""
        m = self.measurements
        if extra is not None:
            m = m.join(extra, ["event_id", "cand_hit_id"], "left")
        hit = [c for c in m.columns if c not in (*SURFACE, "is_1d")]
        reach, own = F.lit(0.0), F.lit(self.base)
        if self.built:
            reach = _spread(F.col("var_local0"), self.n)
            own = _level(reach, self.base)
        copies = []
        for k, widest in self.levels.items():
            copies.append((own <= k, 2 * k, k, widest))
        for k in self.uncertain:
            below = [widest for other, widest in self.levels.items() if other < k]
            if below:
                copies.append((own == k, 2 * k + 1, k, max(below)))
        places = []
        for where, code, k, widest in copies:
            # A hair more than the reaches, so that rounding never loses a strip.
            wide = (reach + widest) * (1 + 1e-9) + F.abs("local0") * 1e-9 + 1e-12
            ends = [_strip_of(F.col("local0") + side * wide, F.lit(k)) for side in (-1, 1)]
            places.append(F.when(where, _coded(F.sequence(*ends), code)))
        spots = places[0] if len(places) == 1 else F.flatten(F.array_compact(F.array(*places)))
        m = m.select(*m.columns, F.inline(spots)).repartition(_tasks(m), *MEET)
        kind = [*MEET, "is_1d"]
        place = F.row_number().over(Window.partitionBy(*kind).orderBy("local0")) - 1
        m = m.withColumn("_chunk", F.floor(place / (self.chunk * self.across)))
        if self.across > 1:
            place = F.row_number().over(Window.partitionBy(*kind, "_chunk").orderBy("local1")) - 1
            m = m.withColumn("_chunk", F.col("_chunk") * self.across + F.floor(place / self.chunk))
        ends = [f(f"local{i}").alias(f"_{name}{i}") for i in (0, 1) for name, f in (("lo", F.min), ("hi", F.max))]
        # A missing variance is in no window.
        least = [F.min(F.coalesce(f"var_local{i}", F.lit(float("-inf")))).alias(f"_least{i}") for i in (0, 1)]
        most = [F.max(f"var_local{i}").alias(f"_most{i}") for i in (0, 1)]
        size = F.count(F.lit(1)).alias("_n")
        return m.groupBy(*kind, "_chunk").agg(*ends, *least, *most, size, F.collect_list(F.struct(*hit)).alias("_hits")).drop("_chunk")

    def met(self, states: DataFrame, extra: DataFrame | None = None, near: list[tuple[Column, float]] | None = None) -> DataFrame:
        """States with the chunks that their window or radius meets; ``_whole`` where the window holds all of the chunk.

        ``near`` has a position and a distance along both coordinates, further than which (where the position is known) no
        measurement counts.
        """
        s = self.place(states)
        s = s.repartition(_tasks(s), *MEET)
        # Merged whatever the sizes: chunks pass by state by state, so that a task holds no more pairs than a state has.
        j = s.join(self.deal(extra).hint("merge"), list(MEET), "inner").drop(*MEET[-2:])
        whole = F.lit(True)
        for i in (0, 1):
            at, lo, hi = F.col(f"pred_l{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
            slack = F.abs(at) * 1e-9 + 1e-12
            reach = _reach(states, self.n, self.radius, self.built, i, F.col(f"_most{i}")) * (1 + 1e-9)
            meets = F.greatest(lo - at, at - hi) <= reach + slack
            if near:
                x, most = near[i]
                meets = meets & F.coalesce(F.greatest(lo - x, x - hi) <= F.abs(x) * 1e-9 + most * (1 + 1e-9), F.lit(True))
            j = j.where(meets if i == 0 else F.col("is_1d") | meets)
            window = half_width(_variance(states, self.built, i, F.col(f"_least{i}")), self.n) * (1 - 1e-9)
            inside = F.coalesce(F.greatest(hi - at, at - lo) <= window - slack, F.lit(False))
            whole = whole & (inside if i == 0 else F.col("is_1d") | inside)
        return j.withColumn("_whole", whole)

    def pairs(self, states: DataFrame, extra: DataFrame | None = None, near: list[tuple[Column, float]] | None = None) -> DataFrame:
        """The pairs of those states and chunks.

        The join is one of states and chunks; pairs come from chunks row by row and are nowhere kept.
        """
        return self.met(states, extra, near).select(*states.columns, "is_1d", "_whole", F.inline("_hits"))

    def counts(self, states: DataFrame) -> DataFrame:
        """``n_window`` and ``geometric_density`` of the states with any; chunks that lie all in the window and out of the radius go unopened."""
        away = F.lit(False)
        for i in (0, 1):
            at = F.col(f"pred_l{i}")
            beyond = F.greatest(F.col(f"_lo{i}") - at, at - F.col(f"_hi{i}")) > self.radius * (1 + 1e-9) + F.abs(at) * 1e-9 + 1e-12
            away = away | (beyond if i == 0 else ~F.col("is_1d") & F.coalesce(beyond, F.lit(True)))
        j = self.met(states).withColumn("_all", F.col("_whole") & away)
        j = j.select(*states.columns, "is_1d", "_n", "_all", F.explode_outer(F.when(~F.col("_all"), F.col("_hits"))).alias("_hit"))
        j = j.select(*j.columns, *[F.col(f"_hit.{c}") for c in ("local0", "local1", "var_local0", "var_local1")])
        j = _flagged(_innovation(j, self.built), self.n, self.radius).where("_all OR _in_window OR _in_radius")
        return j.groupBy(*STATE).agg(
            F.sum(F.when(F.col("_all"), F.col("_n")).otherwise(F.col("_in_window").cast("long"))).alias("n_window"),
            F.sum(F.when(F.col("_all"), F.lit(0)).otherwise(F.col("_in_radius").cast("int"))).alias("geometric_density"),
        )


@dataclass
class Expansion:
    """Usable states with their counts, and where they meet the measurements.

    State-level columns belong on ``states`` before :attr:`candidates` is asked for:
    there is one row per state there, and many per state afterwards. The same holds for ``measurements``: columns by
    event and ``cand_hit_id`` that candidates are to carry (NULL on holes).
    """

    states: DataFrame
    meeting: Meeting | None = None
    n: float = WINDOW_N
    measurements: DataFrame | None = None

    @property
    def candidates(self) -> DataFrame:
        """One row per in-window candidate, and a hole row per state without any."""
        return _candidate_rows(self)


def attach_predicted_covariance(states: DataFrame, predicted: DataFrame) -> DataFrame:
    """States with P00, P01, P11 of the predicted covariance (left join on the state key)."""
    return states.join(predicted.select(*STATE, "P00", "P01", "P11"), list(STATE), "left")


def _usable(states: DataFrame) -> DataFrame:
    keep = true("is_predicted") & F.col("pred_l0").isNotNull()
    if "P00" not in states.columns:
        keep = keep & F.col("S00").isNotNull()
    return states.where(keep)


def _tasks(df: DataFrame) -> int:
    # A task's work is its pairs, of which the sizes of the two sides, by which Spark merges tasks, say nothing.
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)


def _spread(variance: Column, n: float) -> Column:
    return F.coalesce(half_width(variance, n), F.lit(0.0))


def _variance(states: DataFrame, built: bool, i: int, more: Column | None = None) -> Column:
    """A state's variance along a coordinate, with a measurement's if that counts."""
    own = next(F.col(c) for c in ((f"P{i}{i}", f"_P{i}{i}") if built else (f"S{i}{i}", f"_S{i}{i}")) if c in states.columns)
    return more + own if built and more is not None else own


def _reach(states: DataFrame, n: float, radius: float, built: bool, i: int, more: Column | None = None) -> Column:
    """How far a state's window or radius goes along a coordinate."""
    return F.greatest(_spread(_variance(states, built, i, more), n), F.lit(float(radius)))


def _level(reach: Column, base: int) -> Column:
    """The level of strips with room for ``reach``: ``base`` or some rungs above."""
    rungs = F.ceil((F.log2(reach * ROOM) - base) / LADDER)
    least = F.lit(2.0**base / ROOM)
    return F.when(reach <= least, base).when(reach < float("inf"), base + LADDER * F.greatest(rungs, F.lit(1))).otherwise(WHOLE).cast("int")


def _strip_of(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def _coded(strips: Column, code: int) -> Column:
    return F.transform(strips, lambda i: F.struct(F.lit(code).alias("_code"), i.alias("_strip")))


def _covariance(built: bool) -> list[str]:
    return ["P00", "P01", "P11"] if built else ["S00", "S01", "S11"]


def meeting(states: DataFrame, measurements: DataFrame, n: float, radius: float) -> Meeting:
    """Cut the surfaces for these states and measurements.

    A surface may hold a large part of all rows, so it is cut along the first coordinate into strips of about ``STRIP``
    measurements. A state lies in one strip and a measurement in all that a state's reach and its own can
    bring together, of at least ``ROOM`` reaches, so nearly always in one. States of wide windows and uncertain measurements
    meet in strips of higher levels and widen no other's. One pass over each side finds the widths.
    """
    built = "P00" in states.columns
    m = measurements.select(
        *SURFACE, F.col("measurement_id").alias("cand_hit_id"), "local0", "local1", "var_local0", "var_local1",
        F.coalesce(F.col("var_local1") <= 0, F.lit(True)).alias("is_1d"),
    )
    # Those without a position are in no window.
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    m = m.where(known("local0") & (F.col("is_1d") | known("local1")))
    middle = lambda c: F.percentile_approx(c, [0.02, 0.5, 0.98], 100)
    size = m.agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.struct(*SURFACE)).alias("surfaces"),
        middle("local0").alias("at0"),
        middle(F.when(~F.col("is_1d"), F.col("local1"))).alias("at1"),
        *[middle(f"var_local{i}").alias(f"var{i}") for i in (0, 1)],
    ).first()
    var = [F.lit(v[1]) if v else None for v in (size.var0, size.var1)]
    typical = states.agg(*[middle(_reach(states, n, radius, built, i, var[i])).alias(f"r{i}") for i in (0, 1)]).first()
    side = [a[2] - a[0] if a else 0.0 for a in (size.at0, size.at1)]
    wide = [2 * r[1] if r else 0.0 for r in (typical.r0, typical.r1)]
    share = [min(1.0, max(w / s, 1e-9)) if s > 0 else 1.0 for w, s in zip(wide, side, strict=True)]
    each = size.n / max(size.surfaces, 1)
    # An eighth of the measurements in a usual window make a chunk.
    chunk = min(max(int(each * share[0] * share[1] / 8), CHUNKS[0]), CHUNKS[1])
    width = side[0] * min(1.0, STRIP / max(each, 1.0))
    base = math.ceil(math.log2(width)) if 0 < width < float("inf") else 0
    # Tiles as wide as usual windows in both directions; a second coordinate no longer than that is left whole.
    tall = math.sqrt(share[0] / share[1] * min(each, STRIP) / chunk) if share[1] < 0.5 else 1.0
    across = max(1, min(int(tall), int(1 / share[1])))

    def used(rows: DataFrame, reach: Column) -> dict[int, float]:
        found = rows.select(_level(reach, base).alias("level"), reach.alias("reach")).groupBy("level").agg(F.max("reach").alias("most"))
        return {r.level: r.most for r in found.collect()}

    levels = used(states.where(F.col("pred_l0").isNotNull()), _reach(states, n, radius, built, 0)) or {base: 0.0}
    uncertain = used(m, _spread(F.col("var_local0"), n)) if built else {base: 0.0}
    return Meeting(m, n, radius, built, base, levels, uncertain, chunk, across)


def meeting_pairs(states: DataFrame, measurements: DataFrame, n: float, radius: float) -> DataFrame:
    """The pairs of a state and a chunk's measurements: all that :func:`window_pairs` tests."""
    return _meeting_pairs(states, meeting(states, measurements, n, radius))


def _meeting_pairs(states: DataFrame, meet: Meeting, **near) -> DataFrame:
    return meet.pairs(_columns(states, meet), **near)


def _columns(states: DataFrame, meet: Meeting) -> DataFrame:
    return states.select(*STATE, "geometry_id", "pred_l0", "pred_l1", "sel_l0", "sel_l1", *_covariance(meet.built))


def window_pairs(
    states: DataFrame,
    measurements: DataFrame,
    n: float = WINDOW_N,
    radius: float = GEOMETRIC_RADIUS,
) -> DataFrame:
    """All (state, measurement) pairs of a surface inside the window or the radius."""
    p = _innovation(meeting_pairs(states, measurements, n, radius), "P00" in states.columns).drop("_whole")
    return _flagged(p, n, radius).where(F.col("_in_window") | F.col("_in_radius"))


def _innovation(p: DataFrame, built: bool) -> DataFrame:
    """Pairs with the innovation covariance in place of the predicted one."""
    if not built:
        return p
    flat = F.col("is_1d")
    return p.withColumns(
        {
            "S00": F.col("var_local0") + F.col("P00"),
            "S01": F.when(~flat, F.col("P01")),
            "S11": F.when(~flat, F.col("var_local1") + F.col("P11")),
        }
    ).drop("P00", "P01", "P11")


def _in_window(n: float) -> Column:
    r0, r1 = F.col("local0") - F.col("pred_l0"), F.col("local1") - F.col("pred_l1")
    return in_box(r0, r1, "S00", "S11", "is_1d", n)


def _flagged(p: DataFrame, n: float, radius: float) -> DataFrame:
    r0, r1 = F.col("local0") - F.col("pred_l0"), F.col("local1") - F.col("pred_l1")
    return p.withColumns({"_in_window": _in_window(n), "_in_radius": in_radius(r0, r1, "is_1d", radius)})


def _selected_match(tolerance: float) -> Column:
    """Measurement position equals the accepted hit; local1 counts only where both have one."""
    near0 = F.abs(F.col("local0") - F.col("sel_l0")) <= tolerance
    near1 = F.abs(F.col("local1") - F.col("sel_l1")) <= tolerance
    skip1 = F.col("is_1d") | ~finite("sel_l1")
    return finite("sel_l0") & F.coalesce(near0, F.lit(False)) & (skip1 | F.coalesce(near1, F.lit(False)))


def expand_states(
    states: DataFrame,
    measurements: DataFrame,
    n: float = WINDOW_N,
    radius: float = GEOMETRIC_RADIUS,
    tolerance: float = SELECTED_TOLERANCE,
    predicted: DataFrame | None = None,
) -> Expansion:
    """Candidate and hole rows of every usable state.

    The accepted candidate is the closest one, then the one with the lowest id. Pairs grow with the
    states times the measurements of a surface, so they are neither stored nor shuffled: they are made for the counts and for the rows, and
    around accepted positions for the accepted candidates. What is stored grows with the states, of which those below hold
    their covariance under names with an underscore.
    """
    if predicted is not None:
        states = cut_lineage(attach_predicted_covariance(states, predicted), "predicted")
    usable = _usable(states)
    meet = meeting(usable, measurements, n, radius)
    counts = meet.counts(_columns(usable, meet).drop("sel_l0", "sel_l1"))
    # Few pairs match the accepted position; only those go through the struct minimum.
    close = _meeting_pairs(usable.where(finite("sel_l0")), meet, near=[(F.when(finite(c), F.col(c)), tolerance) for c in ("sel_l0", "sel_l1")])
    match = _innovation(close, meet.built).where(_selected_match(tolerance) & (F.col("_whole") | _in_window(n)))
    order = F.struct(F.abs(F.col("local0") - F.col("sel_l0")).alias("d0"), "cand_hit_id")
    winners = match.groupBy(*STATE).agg(F.min(order).getField("cand_hit_id").alias("_sel_id"))
    # Stored, so that its size is known to the join.
    on_surface = cut_lineage(measurements.groupBy(*SURFACE).agg(F.lit(True).alias("_had_meas")), "surfaces")
    held = _covariance(meet.built)
    drop = [c for c in ("S00", "S01", "S11", "P00", "P01", "P11") if c in usable.columns and c not in held]
    per_state = (
        usable.drop(*drop)
        .withColumnsRenamed({c: f"_{c}" for c in held})
        .join(counts, list(STATE), "left")
        .join(winners, list(STATE), "left")
        .join(on_surface, list(SURFACE), "left")
        .withColumns(
            {
                "n_window": F.coalesce("n_window", F.lit(0)).cast("long"),
                "geometric_density": F.coalesce("geometric_density", F.lit(0)).cast("long"),
            }
        )
    )
    per_state = cut_lineage(per_state, "states")
    return Expansion(per_state, meet, n)


def count_states(
    states: DataFrame, measurements: DataFrame, n: float = WINDOW_N, tolerance: float = SELECTED_TOLERANCE
) -> Expansion:
    """Usable states with ``n_window`` and the accepted candidate, as :func:`expand_states` gives them, but no pairs.

    For states with their own covariance. History and guards need no more, and pairs grow with
    the states times the measurements of a surface. Nothing is written: store the states before reading them twice.
    """
    usable = _usable(states)
    found = count_in_windows(usable, measurements, n, tolerance)
    on_surface = measurements.groupBy(*SURFACE).agg(F.lit(True).alias("_had_meas"))
    counted = usable.join(found, list(STATE), "left").withColumn("n_window", F.coalesce("n_window", F.lit(0)).cast("long"))
    return Expansion(counted.join(on_surface, list(SURFACE), "left"))


def _candidate_rows(e: Expansion) -> DataFrame:
    per_state = e.states
    own = [c for c in per_state.columns if not c.startswith("_")]
    extra = [c for c in e.measurements.columns if c not in ("event_id", "cand_hit_id")] if e.measurements is not None else []
    needed = [*own, *[c for c in per_state.columns if c.startswith("_") and c != "_had_meas"]]
    pairs = e.meeting.pairs(per_state.where(F.col("n_window") > 0).select(*needed), e.measurements)
    pairs = pairs.withColumnsRenamed({f"_{c}": c for c in _covariance(e.meeting.built)})
    cand = _innovation(pairs, e.meeting.built).where(F.col("_whole") | _in_window(e.n)).select(
        *own,
        "cand_hit_id",
        (F.col("local0") - F.col("pred_l0")).alias("residual_l0"),
        F.when(~F.col("is_1d"), F.col("local1") - F.col("pred_l1")).alias("residual_l1"),
        F.lit(ACTION_CANDIDATE).alias("action_taken"),
        F.coalesce(F.col("cand_hit_id") == F.col("_sel_id"), F.lit(False)).alias("is_ckf_selected"),
        "S00",
        "S01",
        "S11",
        "var_local0",
        "var_local1",
        "is_1d",
        *extra,
    )
    none = lambda t: F.lit(None).cast(t)
    holes = per_state.where(F.col("n_window") == 0).select(
        *own,
        F.lit(-1).cast("long").alias("cand_hit_id"),
        none("double").alias("residual_l0"),
        none("double").alias("residual_l1"),
        F.when(F.col("_had_meas"), F.lit(ACTION_HOLE_WINDOW_FAILURE))
        .otherwise(F.lit(ACTION_HOLE_NO_MEASUREMENTS))
        .alias("action_taken"),
        F.lit(False).alias("is_ckf_selected"),
        *[none("double").alias(c) for c in ("S00", "S01", "S11", "var_local0", "var_local1")],
        F.lit(False).alias("is_1d"),
    )
    return cand.unionByName(holes, allowMissingColumns=True)


def selection_report(expansion: Expansion) -> DataFrame:
    """Accepted states, matched states and their ratio (accepted states without candidates count)."""
    return expansion.states.agg(
        count_if(finite("sel_l0")).alias("n_accepted"),
        F.count("_sel_id").alias("n_matched"),
    ).withColumn(
        "matched_fraction",
        F.when(F.col("n_accepted") > 0, F.col("n_matched") / F.col("n_accepted")),
    )


def require_selection(expansion: Expansion, minimum: float = MIN_MATCHED) -> None:
    """Raise before anything is written when too few accepted hits were found again."""
    row = selection_report(expansion).first()
    if row.matched_fraction is not None and row.matched_fraction < minimum:
        raise WriteRefused(
            f"only {row.n_matched} of {row.n_accepted} accepted hits matched a candidate "
            f"({row.matched_fraction:.2%}, need {minimum:.0%})"
        )


def branch_history(
    states: DataFrame,
    keys=("event_id", "track_nr"),
    order: str = "state_idx",
    hit: Column | None = None,
    hole: Column | None = None,
    width: int = CHUNK_WIDTH,
) -> DataFrame:
    """``n_hits, n_holes, n_seq_holes`` before each state (one row per state).

    A state with a candidate is a hit, any other a hole; pass ``hole`` (for
    instance restricted to sensors) to leave states out of both counts.
    """
    hit = (F.col("n_window") > 0) if hit is None else hit
    hole = ~hit if hole is None else hole
    s = states.withColumns({"_hit": true(hit).cast("long"), "_hole": true(hole).cast("long")})
    passes = passes_chunk(states, order, width)
    s = in_chunks(s, keys, order, width)
    s = running(
        s,
        keys,
        order,
        sums={"n_hits": "_hit", "n_holes": "_hole"},
        inclusive=False,
        width=width,
        passes=passes,
    )
    # Holes counted up to the last hit; the difference is the current run of holes.
    s = running(
        s,
        keys,
        order,
        lasts={"_at_hit": F.when(F.col("_hit") == 1, F.col("n_holes"))},
        inclusive=False,
        width=width,
        passes=passes,
    )
    return s.withColumn(
        "n_seq_holes", F.col("n_holes") - F.coalesce(F.col("_at_hit"), F.lit(0))
    ).drop("_hit", "_hole", "_at_hit", CHUNK)


def window_counts(rows: DataFrame, keys, flag: Column, out: str) -> DataFrame:
    """Per-state count of a flag put on every row: aggregate, then join back."""
    counts = rows.groupBy(*keys).agg(count_if(flag).alias(out))
    return rows.drop(out).join(counts, list(keys), "left")


def match_selected(
    rows: DataFrame, accepted: DataFrame, keys=("event_id", "seed_id", "step_k"), tolerance: float = SELECTED_TOLERANCE
) -> DataFrame:
    """Flag the candidate whose position equals the accepted hit of its state.

    ``rows`` carry residuals and predictions, ``accepted`` the accepted position.
    """
    j = rows.join(accepted.select(*keys, "sel_l0", "sel_l1"), list(keys), "left")
    d0 = F.abs(F.col("residual_l0") + F.col("pred_l0") - F.col("sel_l0"))
    d1 = F.abs(F.col("residual_l1") + F.col("pred_l1") - F.col("sel_l1"))
    close = F.coalesce(d0 <= tolerance, F.lit(False)) & F.coalesce(d1 <= tolerance, F.lit(True))
    return _flag_winner(j.withColumn("_d", F.when(close, d0)), keys)


def match_selected_by_surface(
    rows: DataFrame, accepted: DataFrame, keys=("event_id", "seed_id", "geometry_id"), tolerance: float = SELECTED_TOLERANCE
) -> DataFrame:
    """Legacy match by residuals on a surface; the lowest candidate id wins.

    A surface can carry several accepted states, so the accepted rows are brought
    to one row per (key, rounded residual cell) lookup through an equi join on the
    tolerance grid rather than paired with every candidate.
    """
    g0 = lambda c: F.floor(col(c) / F.lit(tolerance * 4))
    acc = accepted.select(*keys, "res_l0", "res_l1").where(finite("res_l0") & finite("res_l1"))
    spread = acc.withColumn("_g", F.explode(F.array(*[g0("res_l0") + d for d in (-1, 0, 1)])))
    hit = rows.withColumn("_g", g0("residual_l0")).join(spread, [*keys, "_g"], "inner")
    close = (F.abs(F.col("residual_l0") - F.col("res_l0")) <= tolerance) & (
        F.abs(F.col("residual_l1") - F.col("res_l1")) <= tolerance
    )
    winners = hit.where(close).groupBy(*keys).agg(F.min("cand_hit_id").alias("_win"))
    return (
        rows.join(winners, list(keys), "left")
        .withColumn("is_ckf_selected", F.coalesce(F.col("cand_hit_id") == F.col("_win"), F.lit(False)))
        .drop("_win")
    )


def _flag_winner(j: DataFrame, keys) -> DataFrame:
    winners = (
        j.where(F.col("_d").isNotNull())
        .groupBy(*keys)
        .agg(F.min(F.struct("_d", "cand_hit_id")).alias("_w"))
    )
    return (
        j.join(winners, list(keys), "left")
        .withColumn(
            "is_ckf_selected", F.coalesce(F.col("cand_hit_id") == F.col("_w.cand_hit_id"), F.lit(False))
        )
        .drop("_w", "_d")
    )


def nearest_truth(states: DataFrame, truth: DataFrame, keys=STATE) -> DataFrame:
    """Per state the measurement of its branch particle on its surface that needs the smallest window.

    ``truth`` has one row per (event, geometry, particle, measurement).
    """
    points = truth.withColumnRenamed("particle_id", "branch_majority_pid")
    points = points.withColumn("is_1d", F.coalesce(F.col("var_local1") <= 0, F.lit(True)))
    best = nearest_in_group(states, points, ["event_id", "geometry_id", "branch_majority_pid"], list(keys))
    return best.withColumnRenamed("measurement_id", "true_hit_id").select(*keys, "true_hit_id", "d_max")


# --- clusters and sensors --------------------------------------------------------


def cluster_features(cells: DataFrame, keys=("event_id", "measurement_id")) -> DataFrame:
    """Size, charge and charge-weighted second moments of each measurement's cells.

    Two passes (totals, then centred sums) keep the moments accurate.
    """
    keys = list(keys)
    q = F.col("value")
    first = cells.groupBy(*keys).agg(
        (F.max("channel0") - F.min("channel0") + 1).cast("double").alias("clus_s_u"),
        (F.max("channel1") - F.min("channel1") + 1).cast("double").alias("clus_s_v"),
        F.sum(q).alias("clus_q_tot"),
        F.sum(q * F.col("channel0")).alias("_qu"),
        F.sum(q * F.col("channel1")).alias("_qv"),
    )
    j = cells.join(first, keys, "inner")
    du = F.col("channel0") - F.col("_qu") / F.col("clus_q_tot")
    dv = F.col("channel1") - F.col("_qv") / F.col("clus_q_tot")
    w = q / F.col("clus_q_tot")
    second = j.where(F.col("clus_q_tot") > 0).groupBy(*keys).agg(
        F.sum(w * du * du).alias("clus_sigma_uu"),
        F.sum(w * du * dv).alias("clus_sigma_uv"),
        F.sum(w * dv * dv).alias("clus_sigma_vv"),
    )
    moments = ("clus_sigma_uu", "clus_sigma_uv", "clus_sigma_vv")
    return (
        first.drop("_qu", "_qv")
        .join(second, keys, "left")
        .withColumns({m: F.coalesce(m, F.lit(0.0)) for m in moments})
    )


def cluster_columns(clusters: DataFrame) -> tuple[DataFrame, list[str]]:
    """Cluster columns by event and ``cand_hit_id`` under ``_m_`` names, and their own names."""
    names = [c for c in clusters.columns if c.startswith("clus_")]
    own = [F.col(n).alias(f"_m_{n}") for n in names]
    return clusters.select("event_id", F.col("measurement_id").alias("cand_hit_id"), *own), names


def with_cluster_features(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Candidate rows with cluster columns; state-level values fill what is missing."""
    c, names = cluster_columns(clusters)
    return fill_cluster_features(rows.join(c, ["event_id", "cand_hit_id"], "left"), names)


def fill_cluster_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """The cluster's values, which are under ``_m_`` names, and state-level ones where they are missing."""
    filled = {
        n: F.coalesce(F.col(f"_m_{n}"), F.col(n)) if n in rows.columns else F.col(f"_m_{n}") for n in names
    }
    return rows.withColumns(filled).drop(*[f"_m_{n}" for n in names])


def with_sensor_properties(rows: DataFrame, sensors: DataFrame, barrel=None) -> DataFrame:
    """Pitch and thickness by volume plus the pixel and barrel flags."""
    from ..functions.strata import sensor_flags

    pixel, in_barrel = sensor_flags("volume_id", barrel=barrel)
    props = sensors.select("volume_id", "pitch_u", "pitch_v", "thickness")
    return rows.join(props, ["volume_id"], "left").withColumns({"is_pixel": pixel, "is_barrel": in_barrel})
