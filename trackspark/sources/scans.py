"""Readers for candidate tables, digitisation files, nested track sources and run logs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import nan_to_null
from ..functions.ids import clear_ring, encode_particle
from ..session import cut_lineage
from .schema import require_columns

EVENT_IN_NAME = r"event(\d+)"


def scan_table(spark: SparkSession, paths: str | Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Parquet table with only the needed columns; NaN read as NULL."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return nan_to_null(require_columns(spark.read.parquet(*paths), columns))


def read_branch(df: DataFrame, key: Mapping[str, int]) -> DataFrame:
    """Rows of one branch; the comparison is pushed down to row-group statistics."""
    cond = F.lit(True)
    for name, value in key.items():
        cond = cond & (F.col(name) == F.lit(value))
    return df.where(cond).orderBy("step_k", "cand_hit_id")


def event_of_path(path: Column | None = None) -> Column:
    path = F.col("_metadata.file_path") if path is None else path
    return F.regexp_extract(path, EVENT_IN_NAME, 1).cast("long")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, with their file, block and order in the block.

    Written once: header, position and fields of a line are looked up in the same rows.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    )
    return cut_lineage(lines, "lines")


def _row_numbers(body: DataFrame) -> DataFrame:
    """Add ``row_nr``, the 0-based position among the data lines of the file.

    Files are split for reading. Lines keep their order inside a split, so the
    position is the rank in the split plus the lines of all earlier splits of the file.
    """
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) - 1
    sizes = body.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return body.withColumn("_r", rank).join(offsets, ["file", "block"]).withColumn("row_nr", F.col("_r") + F.col("_o")).drop("_r", "_o")


def csv_rows(spark: SparkSession, path: str, sep: str = ",", numbered: bool = False) -> DataFrame:
    """(file, names, values) of each data line, with the names of the line's own file; ``row_nr`` if asked for.

    The first line of a file that is neither blank nor a comment is its header; files
    read together may order and choose their columns as they like.
    """
    lines = text_lines(spark, path)
    at = F.struct("block", "seq")
    heads = lines.groupBy("file").agg(F.min(at).alias("_first"), F.min_by("line", at).alias("_head"))
    width = heads.agg(F.max(F.size(F.split("_head", re.escape(sep), -1)))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}

    # A generator of one row, so that the text is parsed once and not for every field that is asked for.
    parsed = lambda text: F.explode(F.array(F.from_csv(text, schema, options)))
    cells = lambda row: F.array(*[F.trim(F.col(row)[f"c{i}"]) for i in range(width)])

    # The header itself has no values, so that no cast meets it in whatever order predicates run.
    body = at != F.col("_first")
    heads = heads.select("file", "_first", parsed("_head").alias("_names")).select("file", "_first", cells("_names").alias("names"))
    named = lines.join(heads, "file").withColumn("_values", parsed(F.when(body, F.col("line")))).where(body)
    named = named.withColumn("values", cells("_values")).drop("_values")
    if numbered:
        named = _row_numbers(named)
    return named.select("file", "names", "values", *(["row_nr"] if numbered else []))


def has_field(name: str) -> Column:
    return F.array_contains("names", name)


def csv_field(name: str, kind: str, other: Sequence[str] = ()) -> Column:
    """The value under ``name`` in the line's own header, or under the first of the ``other`` names that is there."""
    out = F.lit(None).cast(kind)
    for n in reversed((name, *other)):
        out = F.when(has_field(n), F.get("values", (F.array_position("names", n) - 1).cast("int")).cast(kind)).otherwise(out)
    return out.alias(name)


def read_csv(
    spark: SparkSession, path: str, fields: Mapping[str, str], sep: str = ",", renames: Mapping[str, str] | None = None
) -> DataFrame:
    """CSV by header name, file by file: comment lines skipped, names trimmed, absent fields NULL.

    ``event_id`` comes from the file name where a file has no such column.
    """
    old = {new: [o for o, n in (renames or {}).items() if n == new] for new in fields}
    cols = [csv_field(n, kind, old[n]) for n, kind in fields.items()]
    if "event_id" not in fields:
        cols.insert(0, _event_id())
    return nan_to_null(csv_rows(spark, path, sep).select(*cols))


def _event_id() -> Column:
    return F.when(has_field("event_id"), csv_field("event_id", "long")).otherwise(event_of_path(F.col("file"))).alias("event_id")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Measurements with ring-free surface ids; in files without an id column the file position is the id."""
    rows = csv_rows(spark, path, numbered=True)
    own = F.when(has_field("measurement_id"), csv_field("measurement_id", "long")).otherwise(F.col("row_nr"))
    floats = ("local0", "local1", "var_local0", "var_local1")
    return nan_to_null(
        rows.select(
            _event_id(),
            own.cast("long").alias("measurement_id"),
            clear_ring(csv_field("geometry_id", "long")).alias("geometry_id"),
            *[csv_field(c, "double") for c in floats],
        )
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    fields = {
        "geometry_id": "long",
        "measurement_id": "long",
        "channel0": "long",
        "channel1": "long",
        "value": "double",
    }
    return read_csv(spark, path, fields).withColumn("geometry_id", clear_ring("geometry_id"))


def read_hit_map(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, {"measurement_id": "long", "hit_id": "long"})


def read_simhits(spark: SparkSession, path: str) -> DataFrame:
    """Simhits whose ``hit_id`` is their position in the file; absent id parts count as 0."""

    def part(name: str) -> Column:
        return F.when(has_field(name), csv_field(name, "long")).otherwise(F.lit(0).cast("long"))

    ids = [part(f"particle_id_{p}") for p in ("pv", "sv", "part", "gen", "subpart")]
    floats = ("tx", "ty", "tz", "tpx", "tpy", "tt")
    return nan_to_null(
        csv_rows(spark, path, numbered=True).select(
            _event_id(),
            F.col("row_nr").cast("long").alias("hit_id"),
            clear_ring(part("geometry_id")).alias("geometry_id"),
            encode_particle(*ids).alias("particle_id"),
            *[csv_field(c, "double") for c in floats],
        )
    )


def read_predicted_covariance(spark: SparkSession, path: str, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predicted covariance in propagation order, and how many rows had no matching track.

    Files count from the outermost state; ``states`` give the number of states per track.
    """
    fields = {"track_nr": "long", "step_k": "long", "P00": "double", "P01": "double", "P11": "double"}
    raw = read_csv(spark, path, fields)
    return reverse_covariance(raw, states)


def reverse_covariance(raw: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = states.groupBy("event_id", "track_nr").agg(F.count(F.lit(1)).alias("_n"))
    j = raw.join(n, ["event_id", "track_nr"], "left")
    ok = F.coalesce(F.col("_n") > F.col("step_k"), F.lit(False))
    report = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~ok, F.lit(1))).alias("n_dropped"))
    kept = j.where(ok).select(
        "event_id", "track_nr", (F.col("_n") - 1 - F.col("step_k")).alias("state_idx"), "P00", "P01", "P11"
    )
    return kept, report


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    """Pitch and thickness per volume from a digitisation configuration; the last entry wins."""
    axis = T.StructType.fromDDL("bins int, min double, max double")
    geo = T.StructType(
        [
            T.StructField("thickness", T.DoubleType()),
            T.StructField("segmentation", T.StructType([T.StructField("binningdata", T.ArrayType(axis))])),
        ]
    )
    entry = T.StructType(
        [
            T.StructField("volume", T.LongType()),
            T.StructField("value", T.StructType([T.StructField("geometric", geo)])),
        ]
    )
    doc = spark.read.schema(T.StructType([T.StructField("entries", T.ArrayType(entry))])).json(path, multiLine=True)
    e = doc.select(F.posexplode("entries").alias("pos", "e")).where(
        F.col("e.volume").isNotNull() & F.col("e.value.geometric").isNotNull()
    )
    bins = F.col("e.value.geometric.segmentation.binningdata")

    def pitch(i: int) -> Column:
        b = F.try_element_at(bins, F.lit(i))
        return F.when(b.bins > 0, (b.max - b.min) / b.bins)

    row = F.struct(pitch(1).alias("pitch_u"), pitch(2).alias("pitch_v"), F.col("e.value.geometric.thickness").alias("thickness"))
    last = e.groupBy(F.col("e.volume").alias("volume_id")).agg(F.max_by(row, "pos").alias("r"))
    return last.select("volume_id", "r.*")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed triplets; the momentum column may be called pt or pT."""
    fields = {"seed_id": "long", "pT": "double", "quality": "double"}
    fields |= {f"{p}{a}": "double" for p in "bmt" for a in "XYZ"}
    return read_csv(spark, path, fields, renames={"pt": "pT"})


def read_rollout_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, {"rollout_id": "long", "step": "long", "geometry_id": "long", "meas_id": "long"})


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    fields = {"rollout_id": "long", "seed_id": "long", "step_k": "long", "geometry_id": "long"}
    fields |= {f"{k}{i}": "double" for k in ("par", "var") for i in range(6)}
    return read_csv(spark, path, fields | {"majority_pid": "long"})


# --- nested track sources ---------------------------------------------------------------


def flat_states(
    tracks: DataFrame, arrays: Sequence[str], carry: Sequence[str] = ("event_id", "track_nr"), order: str = "state_idx"
) -> DataFrame:
    """One row per state from per-track arrays stored outermost first.

    The index is turned into propagation order; fields a source lacks become NULL.
    """
    have = [a for a in arrays if a in tracks.columns]
    size = F.size(have[0])
    t = tracks.select(*carry, size.alias("_n"), F.posexplode(F.arrays_zip(*have)).alias("_pos", "_s"))
    cols = [F.col(f"_s.{a}").alias(a) if a in have else F.lit(None).alias(a) for a in arrays]
    return nan_to_null(t.select(*carry, (F.col("_n") - 1 - F.col("_pos")).cast("long").alias(order), *cols))


def aligned_measurements(
    tracks: DataFrame, mask: str, short: Sequence[str], carry: Sequence[str] = ("event_id", "track_nr"), order: str = "state_idx"
) -> DataFrame:
    """Arrays stored for measurement states only, placed at the states the mask marks."""
    places = F.filter(
        F.transform(mask, lambda m, i: F.when(m, F.size(mask) - 1 - i)), lambda x: x.isNotNull()
    )
    t = tracks.select(*carry, F.explode(F.arrays_zip(places.alias("place"), *[F.col(s) for s in short])).alias("_z"))
    return nan_to_null(t.select(*carry, F.col("_z.place").cast("long").alias(order), *[F.col(f"_z.{s}").alias(s) for s in short]))


def flat_table(nested: DataFrame, arrays: Mapping[str, str], carry: Sequence[str] = ("event_id",)) -> DataFrame:
    """One row per array element of an event-wise nested table, renamed."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    t = nested.select(*carry, F.explode(zipped).alias("_e"))
    return nan_to_null(t.select(*carry, *[F.col(f"_e.{a}").alias(n) for a, n in arrays.items()]))


def hit_keys(states: DataFrame, measured: Column, keys=("event_id", "track_nr")) -> DataFrame:
    """Sorted, ``;``-joined identities of the measured hits of each track."""
    key = F.format_string("%d:%d:%d:%.4f:%.4f", "volume_id", "layer_id", "module_id", "l_x_hit", "l_y_hit")
    s = states.where(measured & F.col("l_x_hit").isNotNull()).select(*keys, key.alias("_k"))
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list("_k")).alias("_ks"))
    return g.select(*keys, F.concat_ws(";", "_ks").alias("hit_keys"), F.size("_ks").alias("n_hit_keys"))


# --- logs, timings and sweeps ------------------------------------------------------------

# Patterns of the metric lines in run logs.
METRIC_LINE = r"(Efficiency|Fake ratio|Duplicate ratio) with (tracks|particles) \([^)]+\) = ([\d.]+)"
TOTALS = {
    "n_events": r"Processed (\d+) events in",
    "total_time_s": r"Processed \d+ events in ([\d.]+) s",
    "total_seeds": r"total seeds: (\d+)",
    "found_tracks": r"found tracks: (\d+)",
    "selected_tracks": r"selected tracks: (\d+)",
}
STAGES = ("ckf", "ckf_finding", "ambi")


def metric_lines(logs: DataFrame, key: str, text: str, pattern: str = METRIC_LINE) -> DataFrame:
    """All metric values of each log text with the stage they belong to.

    The stage advances after the second and the third track efficiency.
    """
    get = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    z = F.arrays_zip(get(1).alias("metric"), get(2).alias("basis"), get(3).alias("value"))
    m = logs.select(key, F.posexplode(z).alias("pos", "m")).select(key, "pos", "m.*")
    mark = ((F.col("metric") == "Efficiency") & (F.col("basis") == "tracks")).cast("long")
    from ..operators.ordered import running

    m = running(m.withColumn("_e", mark), [key], "pos", sums={"_seen": "_e"}, inclusive=False)
    stage = (
        F.when(F.col("_seen") >= 3, F.lit(STAGES[2])).when(F.col("_seen") >= 2, F.lit(STAGES[1])).otherwise(F.lit(STAGES[0]))
    )
    name = F.concat_ws("_", stage, F.lower(F.regexp_replace("metric", " ", "_")), F.col("basis"))
    return m.select(key, "pos", name.alias("name"), F.col("value").cast("double").alias("value"))


def log_totals(logs: DataFrame, key: str, text: str) -> DataFrame:
    """Counts and times a log states once; NULL when absent."""
    found = {n: F.expr(f"try_cast(nullif(regexp_extract({text}, r'{p}', 1), '') as double)") for n, p in TOTALS.items()}
    t = logs.select(key, *[c.alias(n) for n, c in found.items()])
    per = F.when(F.col("n_events") > 0, F.col("total_time_s") / F.col("n_events") * 1000)
    return t.withColumn("time_per_event_ms", per)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Tab when the first line has tabs and no comma, else comma."""
    line = spark.read.text(path).first()
    head = line.value if line else ""
    return "\t" if "\t" in head and "," not in head else ","


def read_stage_times(spark: SparkSession, path: str) -> DataFrame:
    """Seconds per algorithm (per event where given, else in total)."""
    fields = {"identifier": "string", "time_perevent_s": "double", "time_total_s": "double"}
    raw = read_csv(spark, path, fields, sep=sniff_separator(spark, path), renames={"name": "identifier"})
    return stage_times(raw.select("identifier", F.coalesce("time_perevent_s", "time_total_s").alias("time_s")))


def stage_times(raw: DataFrame) -> DataFrame:
    """Names without their prefix; repeated names are summed."""
    short = F.element_at(F.split("identifier", ":"), -1)
    named = raw.withColumn("name", short).where(F.col("name") != "")
    return named.groupBy("name").agg(F.sum("time_s").alias("time_s"))


def stage_sum(times: DataFrame, names: Sequence[str]) -> DataFrame:
    """Total of the named stages; absent ones count as 0."""
    hit = F.col("name").isin(list(names))
    return times.agg(F.coalesce(F.sum(F.when(hit, F.col("time_s"))), F.lit(0.0)).alias("stage_time_s"))


def sweep_points(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Sweep rows with unparsable numbers as NULL (failed runs are kept)."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in numeric})


def point_of_name(name: Column | str, pattern: str, group: int) -> Column:
    """Parameter written into a run name, with ``p`` for the decimal point."""
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), F.lit("p"), F.lit(".")).try_cast("double")


# --- per-event timings ---------------------------------------------------------------------

# Columns of the per-event timing files.
EVENT_TIMES = {
    "event": "long",
    "n_seeds": "long",
    "n_tracks": "long",
    "gate_inference_ns": "double",
    "gate_inference_calls": "long",
    "gate_feature_ns": "double",
    "gate_feature_calls": "long",
    "value_inference_ns": "double",
    "value_inference_calls": "long",
    "meas_selection_ns": "double",
    "meas_selection_calls": "long",
}


def read_event_times(spark: SparkSession, path: str, run_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """One row per run and event from timing files; ``run_id`` is taken from each file's path.

    Absent columns and unparsable values are NULL; lines without any value are left out.
    """
    run = F.regexp_extract(F.col("file"), run_pattern, 1)
    cols = [csv_field(n, "string").try_cast(kind).alias(n) for n, kind in EVENT_TIMES.items()]
    rows = nan_to_null(csv_rows(spark, path, ",").select(run.alias("run_id"), *cols))
    return rows.where(F.coalesce(*EVENT_TIMES).isNotNull())


# --- particles, tracks and their matching ---------------------------------------------------

# The five parts of a particle's barcode, and how each table names them.
BARCODE = ("vertex_primary", "vertex_secondary", "particle", "generation", "sub_particle")
MATCH_PREFIX, MAJORITY_PREFIX = "particle_id_", "majorityParticleId_"


def _barcode(element: str, prefix: str = "") -> Column:
    return encode_particle(*[F.col(f"{element}.{prefix}{part}") if element else F.col(f"{prefix}{part}") for part in BARCODE])


def particle_table(nested: DataFrame) -> DataFrame:
    """event_id, packed ``particle_id`` and pt of the particles of event-wise arrays.

    Of a barcode that an event lists twice the last one counts, as files are read in order.
    """
    arrays = F.arrays_zip(*[F.col(c) for c in (*BARCODE, "pt")])
    t = nested.select(F.col("event_id").cast("long").alias("event_id"), F.posexplode(arrays).alias("_pos", "_e"))
    flat = t.select("event_id", _barcode("_e").alias("particle_id"), F.col("_e.pt").cast("double").alias("pt"), "_pos")
    last = flat.groupBy("event_id", "particle_id").agg(F.max_by(F.struct("pt"), "_pos").alias("_p"))
    return nan_to_null(last.select("event_id", "particle_id", F.col("_p.pt").alias("pt")))


def track_summary(nested: DataFrame) -> DataFrame:
    """event_id, track_class, track_pt, n_majority and packed ``majority_pid`` of the tracks of event-wise arrays; infinite pt is NULL."""
    parts = [f"{MAJORITY_PREFIX}{p}" for p in BARCODE]
    arrays = F.arrays_zip(*[F.col(c) for c in ("trackClassification", "t_pT", "nMajorityHits", *parts)])
    t = nested.select(F.col("event_nr").cast("long").alias("event_id"), F.explode(arrays).alias("_e"))
    pt = F.col("_e.t_pT").cast("double")
    return nan_to_null(
        t.select(
            "event_id",
            F.col("_e.trackClassification").cast("int").alias("track_class"),
            F.when(F.abs(pt) < float("inf"), pt).alias("track_pt"),
            F.col("_e.nMajorityHits").cast("long").alias("n_majority"),
            _barcode("_e", MAJORITY_PREFIX).alias("majority_pid"),
        )
    )


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing is stored at ``path``; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def matching_flags(particles: DataFrame, details: DataFrame | None, tracks: DataFrame) -> DataFrame:
    """``particles`` with ``matched`` and where it comes from.

    ``details`` is the finder's own table of particles (barcode parts and ``matched``), which older runs lack: then a
    particle is matched if a matched or duplicate track has it as majority. A particle that ``details`` does not list is
    not matched; one listed more than once is matched if any row says so.
    """
    from ..operators.matching import matched_from_tracks

    if details is None:
        return matched_from_tracks(particles, tracks).withColumn("origin", F.lit("tracks"))
    key = _barcode("", MATCH_PREFIX)
    flags = details.select(F.col("event_nr").cast("long").alias("event_id"), key.alias("particle_id"), F.col("matched").cast("boolean").alias("_m"))
    flags = flags.groupBy("event_id", "particle_id").agg(F.bool_or("_m").alias("matched"))
    j = particles.join(flags, ["event_id", "particle_id"], "left")
    return j.withColumns({"matched": F.coalesce("matched", F.lit(False)), "origin": F.lit("details")})
