"""Whitening of embeddings: scatter and projection as products of distributed block matrices.

Vectors become integers on a grid (``floor(scale * c)``), so that counts, sums and
deviations are exact; the model is fitted on every *distinct* grid vector once. The
centred rows get gapless indices and are laid out in MLlib blocks. A transposed product
gives the scatter matrix, whose size is that of one vector squared; its eigenvectors come
from a local solver, and a second product projects every row.

- Rows whose vector is null or holds a null or non-finite entry are dropped.
- Shorter vectors count as padded with zeros up to the longest.
- Repeated rows all get results; they count once in the fit. Null ids are kept.
- A component whose eigenvalue is zero up to rounding has null ``whitened``; with a
  single distinct vector ``explained`` and ``identity_error`` are null too.
- ``deviation`` is null where it passes 38 digits.
- An empty table, and one of empty vectors only, gives no rows.

The driver holds matrices of one vector squared and, inside ``BlockMatrix.multiply``, two
integers per block of up to ``BLOCK_BYTES``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard, fresh_name, numbered

#: Blocks are this high at least, and grow with the table up to so many bytes.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_COLS = 1024, 4 << 20, 1024
#: Up to so many blocks keep the least height.
FEW_BLOCKS = 4096
#: Blocks of one side that a task of the transposed product holds.
BLOCKS_PER_TASK = 16
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """A fitted model: sums over the ``n`` distinct grid vectors, falling eigenvalues, eigenvectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def usable(self, component: int) -> bool:
        return self.values[component] > RANK * self.values[0]

    def projection(self, components: int) -> np.ndarray:
        """Columns that whiten a centred row; zero for components without variance."""
        return np.stack(
            [self.vectors[:, k] / np.sqrt(self.values[k]) if self.usable(k) else np.zeros(len(self.sums)) for k in range(components)], axis=1
        )

    def explained(self, component: int) -> float | None:
        total = float(self.values.sum())
        return float(self.values[component]) / total if total > 0 else None


def grid(vector: Column, scale: int) -> Column:
    """``floor(scale * c)`` of each entry; null where the vector is null or an entry is null or not finite."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def blocks(rows: DataFrame, index: str, centred: Column, n: int, width: int) -> BlockMatrix:
    """Rows laid out in blocks by their index; indices without a row stand for zeros."""
    height = min(max(BLOCK_ROWS, n // FEW_BLOCKS), max(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(height, min(width, BLOCK_COLS))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed product; the long dimension is split over tasks, each of which sends on one sum."""
    splits = max(1, matrix.numRowBlocks // BLOCKS_PER_TASK)
    other = matrix._java_matrix_wrapper._java_model
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", other, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(sc: SparkContext, matrix: BlockMatrix, columns: np.ndarray) -> DataFrame:
    """``index`` and the projected row ``z`` (array)."""
    high = matrix.colsPerBlock
    parts = [((k // high, 0), Matrices.dense(len(p := columns[k : k + high]), p.shape[1], p.flatten("F").tolist())) for k in range(0, len(columns), high)]
    weights = BlockMatrix(sc.parallelize(parts, len(parts)), high, columns.shape[1], *columns.shape)
    product = matrix.multiply(weights).toIndexedRowMatrix()
    rows = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model), "vector")
    return rows.select("index", vector_to_array("vector").alias("z"))


def _indexed(df: DataFrame, vector: str, scale: int) -> tuple[DataFrame, int, int]:
    """Stored rows: ``kept`` (all columns but the vector), ``x``, gapless ``index``, ``first`` of its grid vector; rows; width."""
    spark = df.sparkSession
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != vector]) if len(df.columns) > 1 else F.struct(F.lit(None).cast("int"))
    slim = df.select(kept.alias("kept"), grid(F.col(f"`{vector}`"), scale).alias("x")).filter("x IS NOT NULL")
    rows, uid = numbered(slim, "grid-vectors")
    # One row for each task that has written rows.
    tasks = rows.groupBy(F.shiftrightunsigned(uid, 33).alias("task")).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).collect()
    width = max((t["width"] for t in tasks), default=0)
    if not width:
        return rows.withColumns({"index": F.col(uid), "first": F.lit(True)}), 0, 0
    offsets, n = [], 0
    for task in sorted(tasks, key=lambda t: t["task"]):
        offsets.append((task["task"], n))
        n += task["n"]
    starts = spark.createDataFrame(offsets, "task long, start long")
    padded = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    first = padded.groupBy("x").agg(F.min(uid).alias(uid)).select(uid, F.lit(True).alias("first"))
    indexed = (
        padded.join(first, uid, "left")
        .withColumn("task", F.shiftrightunsigned(uid, 33))
        .join(F.broadcast(starts), "task")
        .select("kept", "x", (F.col("start") + F.col(uid).bitwiseAND((1 << 33) - 1)).alias("index"), F.coalesce("first", F.lit(False)).alias("first"))
    )
    stored = cut_lineage(indexed, "indexed-vectors")
    discard(rows)
    return stored, n, width


def _fit(rows: DataFrame, n_rows: int, width: int) -> Whitening:
    fit = rows.filter("first")
    entries = fit.select(F.posexplode("x").alias("at", "entry"))
    sums = entries.groupBy("at").agg(F.sum(F.col("entry").cast("decimal(20,0)")).alias("total"), F.count("*").alias("n")).collect()
    n = sums[0]["n"]
    total = {r["at"]: int(r["total"]) for r in sums}
    s = [total[k] for k in range(width)]
    centred = F.zip_with("x", F.lit([v / n for v in s]), lambda x, mean: x.cast("double") - mean)
    covariance = scatter(blocks(fit, "index", centred, n_rows, width)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    vectors = vectors[:, ::-1]
    # One sign for all rows: the entry of largest size is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(width)] < 0, -1.0, 1.0)
    return Whitening(n, s, np.maximum(values[::-1], 0.0), vectors)


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over dimensions of ``(n * x - S)^2``, exact, as decimal(38,0)."""
    wide = "decimal(38,0)"
    s = F.array(*[F.lit(Decimal(v)).cast(wide) for v in sums])
    parts = F.zip_with(x, s, lambda a, b: F.try_subtract(F.try_multiply(a.cast("decimal(20,0)"), F.lit(Decimal(n))).cast(wide), b).cast(wide))
    squares = F.transform(parts, lambda d: F.try_multiply(d, d).cast(wide))
    return F.aggregate(squares, F.lit(Decimal(0)).cast(wide), lambda a, b: F.try_add(a, b).cast(wide))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """The columns of ``df`` but ``vector``, and per row and component: ``component`` (from 1, by falling
    eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    New columns get underscores before them where ``df`` has their name.
    """
    rows, n_rows, width = _indexed(df, vector, scale)
    others = [c for c in df.columns if c != vector]
    names = {}
    for c in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        names[c] = fresh_name(df.select(*[F.col(f"`{o}`") for o in others]), c)
    carried = [F.col("kept").getField(c).alias(c) for c in others]
    if not width:
        return rows.filter("false").select(
            *carried,
            F.lit(0).alias(names["component"]),
            F.lit(0).cast("long").alias(names["n"]),
            F.lit(0).cast("decimal(38,0)").alias(names["deviation"]),
            *[F.lit(0.0).alias(names[c]) for c in ("whitened", "explained", "identity_error")],
        )
    model = _fit(rows, n_rows, width)
    k = min(components, width)
    centred = F.zip_with("x", F.lit(model.mean), lambda x, mean: x.cast("double") - mean)
    projected = project(df.sparkSession.sparkContext, blocks(rows, "index", centred, n_rows, width), model.projection(k))
    done = cut_lineage(
        rows.join(projected, "index", "left").select(
            "kept", "index", "first", F.coalesce("z", F.array_repeat(F.lit(0.0), k)).alias("z"), deviation(F.col("x"), model.n, model.sums).alias("deviation")
        ),
        "whitened",
    )
    discard(rows)
    error = _identity_error(done, n_rows, model, k)
    per = F.array(*[F.struct(F.lit(c + 1).alias("component"), F.lit(model.usable(c)).alias("usable"), F.lit(model.explained(c)).cast("double").alias("explained")) for c in range(k)])
    long = done.select("kept", "deviation", "z", F.explode(per).alias("c"))
    return long.select(
        *carried,
        F.col("c.component").alias(names["component"]),
        F.lit(model.n).cast("long").alias(names["n"]),
        F.col("deviation").alias(names["deviation"]),
        F.when(F.col("c.usable"), F.element_at("z", F.col("c.component"))).alias(names["whitened"]),
        F.col("c.explained").alias(names["explained"]),
        F.lit(error).cast("double").alias(names["identity_error"]),
    )


def _identity_error(done: DataFrame, n_rows: int, model: Whitening, k: int) -> float | None:
    """Largest entry of the covariance of the whitened fit list, less the identity, over components with variance."""
    used = [c for c in range(k) if model.usable(c)]
    if not used:
        return None
    fit = done.filter("first").withColumn("z", F.array(*[F.element_at("z", c + 1) for c in used]))
    mean = fit.agg(*[F.avg(F.element_at("z", i + 1)) for i in range(len(used))]).first()
    centred = F.zip_with("z", F.lit([float(m) for m in mean]), lambda z, m: z - m)
    covariance = scatter(blocks(fit, "index", centred, n_rows, len(used))) / model.n
    return float(np.abs(covariance - np.eye(len(used))).max())
