"""Which file holds which event, and which split an event belongs to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if

SPLITS = ("train", "val", "cal", "test")
SEALED = "test"


def resolve_sources(requested: DataFrame, explicit: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Path per requested event: the explicit map first, else the index; with the origin.

    Tables: requested(event_id), explicit(event_id, path), index(event_id, path).
    """
    e = explicit.select("event_id", F.col("path").alias("_e"))
    j = requested.select("event_id").distinct().join(e, ["event_id"], "left")
    if index is None:
        j = j.withColumn("_i", F.lit(None).cast("string"))
    else:
        j = j.join(index.select("event_id", F.col("path").alias("_i")), ["event_id"], "left")
    origin = F.when(F.col("_e").isNotNull(), F.lit("explicit")).when(F.col("_i").isNotNull(), F.lit("index"))
    return j.select("event_id", F.coalesce("_e", "_i").alias("path"), origin.alias("origin"))


def source_problems(resolved: DataFrame) -> DataFrame:
    """Events without a source, with several, or sharing one that was only guessed from the index."""
    missing = resolved.where(F.col("path").isNull()).select("event_id", F.lit("missing").alias("problem"))
    n = resolved.where(F.col("path").isNotNull()).groupBy("event_id").agg(F.count_distinct("path").alias("_n"))
    ambiguous = n.where(F.col("_n") > 1).select("event_id", F.lit("ambiguous").alias("problem"))
    shared = (
        resolved.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.count_distinct("event_id").alias("_n"), count_if(F.col("origin") == "index").alias("_g"))
        .where((F.col("_n") > 1) & (F.col("_g") > 0))
    )
    reused = resolved.join(shared.select("path"), ["path"], "left_semi").select(
        "event_id", F.lit("reused").alias("problem")
    )
    return missing.unionByName(ambiguous).unionByName(reused).distinct()


def require_sources(resolved: DataFrame) -> DataFrame:
    bad = source_problems(resolved).limit(5).collect()
    if bad:
        raise ValueError(f"cannot resolve event sources: {[r.asDict() for r in bad]}")
    return resolved


def assign_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with the split of their event (``splits``: event_id, split)."""
    return rows.join(splits.select("event_id", "split"), ["event_id"], "left")


def require_open(rows: DataFrame, sealed: str = SEALED) -> None:
    """Refuse rows of the sealed split or of no split at all."""
    bad = rows.where(F.col("split").isNull() | (F.col("split") == sealed)).select("event_id", "split").limit(5).collect()
    if bad:
        raise ValueError(f"refusing sealed or unassigned events: {[tuple(r) for r in bad]}")


def requested_events(splits: DataFrame, request: str = "", sealed: str = SEALED) -> DataFrame:
    """(asked, event_id, problem) for each entry of a comma-separated request, met with ``splits`` (event_id, split).

    An empty request asks for every event that is not sealed. ``problem`` is null,
    'not a number', 'unknown' or 'sealed'.
    """
    known = splits.groupBy("event_id").agg(F.max(F.col("split") == sealed).alias("closed"))
    if not request.strip():
        return known.where(~F.col("closed")).select(F.col("event_id").cast("string").alias("asked"), "event_id", F.lit(None).cast("string").alias("problem"))
    entries = splits.sparkSession.createDataFrame([(request,)], "request string").select(F.explode(F.split("request", ",")).alias("asked"))
    asked = entries.select(F.trim("asked").alias("asked")).distinct().withColumn("event_id", F.col("asked").try_cast("long"))
    problem = (
        F.when(F.col("event_id").isNull(), "not a number").when(F.col("closed").isNull(), "unknown").when(F.col("closed"), "sealed")
    )
    return asked.join(known, ["event_id"], "left").select("asked", "event_id", problem.alias("problem"))


def open_events(splits: DataFrame, request: str = "", sealed: str = SEALED) -> DataFrame:
    """The event ids of a request; refused with all its problems if it has any."""
    asked = requested_events(splits, request, sealed)
    bad = asked.where(F.col("problem").isNotNull()).orderBy("problem", "asked").collect()  # entries of the request
    if bad:
        raise ValueError("; ".join(f"{r.asked!r}: {r.problem}" for r in bad))
    return asked.select("event_id").distinct()


def table_health(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows per file and event against the expectation (``event_id, expected_rows``)."""
    have = files.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").alias("n_files"))
    j = expected.join(have, ["event_id"], "full_outer")
    return j.select(
        "event_id",
        "expected_rows",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.col("n_rows").isNotNull().alias("is_present"),
        F.coalesce(F.col("n_rows") == F.col("expected_rows"), F.lit(False)).alias("rows_match"),
    )


def with_file(df: DataFrame) -> DataFrame:
    """The file each row was read from."""
    return df.select("*", F.col("_metadata.file_path").alias("file"))
