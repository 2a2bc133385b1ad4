"""Additive tables kept up to date while per-event files arrive.

Cubes, reliability sums and histograms are sums over events, so a new event only
adds rows. Each micro-batch is reduced to one row per (event, cell) and stored
below its batch number; replaying a batch rewrites the same folder. The stream hands
out every file once, so the batches of an event add up however many files it has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Reduce = Callable[[DataFrame], DataFrame]


def keep_sums(
    spark: SparkSession,
    source: str,
    schema: StructType,
    reduce: Reduce,
    path: str,
    checkpoint: str,
    files_per_batch: int = 8,
) -> StreamingQuery:
    """Start a query that folds arriving candidate files into sums and stops when idle.

    ``reduce`` maps candidate rows to rows of sums. Files may hold any part of any events.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def fold(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rows.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def totals(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Sums over all stored events."""
    d = spark.read.parquet(path)
    counts = [c for c in d.columns if c not in (*by, "event_id", "batch")]
    return d.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
