"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, discard, scratch_path

__all__ = ["bucketed", "cut_lineage", "discard", "drawn", "fresh_name", "keyed", "map_batches", "numbered", "table", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, label: str, **extra) -> tuple[DataFrame, str]:
    """``df`` written once with a row number of its own and the ``extra`` columns.

    The number tells repeated rows and null ids apart. It is read back from the
    written table, so every later use, also after a lost executor, sees the same one.
    """
    uid = fresh_name(df, "uid")
    return cut_lineage(df.withColumns({uid: F.monotonically_increasing_id(), **extra}), label), uid


def keyed(df: DataFrame, from_files: bool, label: str = "documents") -> tuple[DataFrame, str]:
    """``df`` with a key of its own for each row: the file and the row's place in it, or a stored number.

    ``from_files``: ``df`` is a table of Parquet files as Spark reads it. Such a row keeps
    its key however the files are split or read again, and nothing is written.
    """
    if not from_files:
        return numbered(df, label)
    uid = fresh_name(df, "uid")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.withColumn(uid, place), uid


def bucketed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df`` written once in buckets of ``keys``, so that later joins on them leave its rows where they are."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, label)
    name = f"{label}_{path.rpartition('-')[2]}"
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys)
    writer.option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null gives empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def drawn(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About ``most`` rows of ``df``, all if there are no more, drawn by a digest of the columns ``by``.

    Rows are dropped where they are read, so that no task sends on more than its share;
    the limit only holds for rows that share a digest.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(int((1 << 40) * most / n))).limit(most + most // 8)
