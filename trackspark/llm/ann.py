"""Largest inner products by multiprobe p-stable hashing.

Vectors are scaled below length one and lifted onto a sphere, where the largest inner
product is the least distance. Each table cuts space by a few random projections into
cells of one width. A query visits the buckets that hold vectors in the order of their
estimated success: the nearer the query lies to the borders that must be crossed, the
sooner. How many are visited is fitted on a bounded sample, up to all of them, and a
query goes on until those it has visited hold enough vectors to fill its answer. The
candidates of all tables are merged and ranked by the exact product. Equal vectors are
searched once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drawn

TABLES, PROJECTIONS = 2, 4
#: Cell width in standard deviations of a projection.
WIDTH = 2.0
#: Cells beyond this distance from the middle count as the last one.
FARTHEST = 4
#: The number of probes is fitted on this many vectors, to this recall.
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 256, 0.94
#: Vectors and queries that meet in one task: those of neighbouring buckets, or a part of a bucket's.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


@dataclass
class Hasher:
    """Projections of all tables for vectors of one dimension."""

    longest: float
    directions: np.ndarray  # tables x projections x (dim + 1)
    shifts: np.ndarray  # tables x projections
    width: float

    @staticmethod
    def make(dim: int, longest: float, seed: int = 17) -> Hasher:
        rng = np.random.default_rng([seed, dim])
        # A unit vector's projection on a standard normal direction has standard deviation one.
        return Hasher(longest or 1.0, rng.standard_normal((TABLES, PROJECTIONS, dim + 1)), rng.uniform(0, WIDTH, (TABLES, PROJECTIONS)), WIDTH)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Points on the unit sphere of one more dimension: vectors by their missing length, queries by their direction."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack((x / np.where(length > 0, length, 1), np.zeros_like(length)))
        x = x / self.longest
        return np.hstack((x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1, keepdims=True)))))

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in cell widths, tables x rows x projections."""
        return (np.einsum("tpd,nd->tnp", self.directions, self.lifted(x, query)) + self.shifts[:, None, :]) / self.width

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        side = 2 * FARTHEST
        digits = np.clip(cells, -FARTHEST, FARTHEST - 1).astype(np.int64) + FARTHEST
        return (digits * side ** np.arange(PROJECTIONS)).sum(axis=-1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.code(np.floor(self.places(x, False)))

    def visits(self, x: np.ndarray, held: Held) -> list[np.ndarray]:
        """For each table, the places in ``held`` of all its buckets in the order they are worth visiting, queries x buckets."""
        out = []
        for at, codes in zip(self.places(x, True), held.codes, strict=True):
            # The square of the way to a bucket; fewer and shorter crossings succeed more often.
            way = np.zeros((len(x), len(codes)))
            for p in range(PROJECTIONS):
                cell = codes // (2 * FARTHEST) ** p % (2 * FARTHEST) - FARTHEST
                # The outermost cells have no outer border.
                low = np.where(cell > -FARTHEST, cell, -np.inf)
                high = np.where(cell < FARTHEST - 1, cell + 1, np.inf)
                way += np.maximum(0, np.maximum(low - at[:, p : p + 1], at[:, p : p + 1] - high)) ** 2
            out.append(np.argsort(way, axis=1, kind="stable"))
        return out


@dataclass
class Held:
    """The buckets that hold vectors, in rising order, and how many each holds; bounded by the number of cells."""

    codes: list[np.ndarray]
    rows: list[np.ndarray]

    @staticmethod
    def of(counted: list[tuple[int, int, int]]) -> Held:
        """From (t, bucket, rows)."""
        tables = [sorted((c, n) for u, c, n in counted if u == t) for t in range(TABLES)]
        return Held([np.array([c for c, _ in x], np.int64) for x in tables], [np.array([n for _, n in x], np.int64) for x in tables])

    def groups(self) -> list[np.ndarray]:
        """For each table, the group of each bucket: neighbours that hold about BLOCK_ROWS vectors together."""
        return [(np.cumsum(n) - n) // BLOCK_ROWS for n in self.rows]


def fit_probes(hasher: Hasher, held: Held, sample: np.ndarray, k: int) -> int:
    """Fewest probes in each table with which the sample's queries find ``TARGET`` of their nearest; all buckets find all."""
    asked = np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))
    queries = sample[asked]
    scores = queries @ sample.T
    if len(sample) > 1:
        scores[np.arange(len(asked)), asked] = -np.inf  # finding itself is no success
    best = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    bucket, visits = hasher.buckets(sample), hasher.visits(queries, held)
    most = max(len(c) for c in held.codes)
    rank = np.full(best.shape, most)
    for t in range(TABLES):
        turn = np.argsort(visits[t], axis=1, kind="stable")  # the turn at which a bucket is visited
        # A vector on a border may fall to the other side here.
        place = np.minimum(np.searchsorted(held.codes[t], bucket[t][best]), len(held.codes[t]) - 1)
        rank = np.minimum(rank, np.take_along_axis(turn, place, axis=1))
    found = np.cumsum(np.bincount(rank.ravel(), minlength=most)) / rank.size
    return int(np.searchsorted(found, TARGET) + 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _hash_rows(hasher: Hasher):
    """(t, bucket, rep, v) rows of vectors."""

    def run(frames):
        for df in frames:
            for t, code in enumerate(hasher.buckets(_matrix(df["v"]))):
                yield pd.DataFrame({"t": t, "bucket": code, "rep": df["rep"], "v": df["v"]})

    return run


def _probe_rows(hasher: Hasher, held: Held, probes: int, need: int):
    """(t, g, rep, v, buckets) rows of queries, one for each group of buckets they visit: ``probes`` buckets in each table, more in one until they hold ``need`` vectors."""
    groups = held.groups()

    def run(frames):
        for df in frames:
            for a in range(0, len(df), 256):
                part = df.iloc[a : a + 256]
                visits = hasher.visits(_matrix(part["v"]), held)
                # A vector is in one bucket of a table, so what the visited buckets of one table hold are as many vectors.
                full = np.stack([(np.cumsum(n[v], axis=1) >= need).argmax(axis=1) + 1 for n, v in zip(held.rows, visits, strict=True)])
                first = full.argmin(axis=0)
                for t, order in enumerate(visits):
                    each = np.where(first == t, np.maximum(probes, full[t]), probes)
                    row, col = np.nonzero(np.arange(order.shape[1]) < each[:, None])
                    bucket = order[row, col]
                    # The vector goes once to each group, with the list of its buckets there.
                    turn = np.lexsort((bucket, groups[t][bucket], row))
                    row, bucket = row[turn], bucket[turn]
                    group = groups[t][bucket]
                    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(group) != 0))))
                    lists = np.split(held.codes[t][bucket], cuts[1:])
                    at = row[cuts]
                    yield pd.DataFrame({"t": t, "g": group[cuts], "rep": part["rep"].to_numpy()[at], "v": part["v"].to_numpy()[at], "buckets": lists})

    return run


def _best_of(x: np.ndarray, rep: np.ndarray, q: np.ndarray, q_rep: np.ndarray, k: int) -> pd.DataFrame:
    """The k + 1 best of vectors for each query, by the exact product."""
    near = q @ x.T
    row, col = np.indices(near.shape)
    if near.shape[1] > k + 1:
        # Products may differ in their last bits by the shape of a block: those level with the last are kept until they are exact.
        least = -np.partition(-near, k, axis=1)[:, k : k + 1]
        row, col = np.nonzero(near >= least - 1e-9 * np.maximum(1.0, np.abs(least)))
    row, col = row.ravel(), col.ravel()
    exact = (q[row] * x[col]).sum(axis=1)
    order = np.lexsort((rep[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) <= k
    return pd.DataFrame({"q": q_rep[row[first]], "rep": rep[col[first]], "score": exact[first]})


def _rank_block(k: int):
    """The k + 1 best vectors of a block for each of its queries, over the buckets that the query visits."""

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "rep": [], "score": []}).astype({"q": "int64", "rep": "int64", "score": "float64"})
        if index.empty or queries.empty:
            return none
        index = index.sort_values(["bucket", "rep"], kind="stable")
        x, rep, code = _matrix(index["v"]), index["rep"].to_numpy(), index["bucket"].to_numpy()
        q, q_rep = _matrix(queries["v"]), queries["rep"].to_numpy()
        asked = np.repeat(np.arange(len(queries)), [len(b) for b in queries["buckets"]])
        bucket = np.concatenate(queries["buckets"].to_list())
        turn = np.argsort(bucket, kind="stable")
        asked, bucket = asked[turn], bucket[turn]
        out = [none]
        for c in np.unique(code):
            a, b = np.searchsorted(code, [c, c + 1])
            m, n = np.searchsorted(bucket, [c, c + 1])
            for s in range(m, n, 256):
                who = asked[s : min(n, s + 256)]
                out.append(_best_of(x[a:b], rep[a:b], q[who], q_rep[who], k))
        found = pd.concat(out)
        # A block sends on no more than its best.
        found = found.sort_values(["q", "score", "rep"], ascending=[True, False, True], kind="stable")
        return found[found.groupby("q").cumcount() <= k]

    return run


def _search(classes: DataFrame, queries: DataFrame, hasher: Hasher, k: int) -> DataFrame:
    """(q, rep, score): the best k + 1 classes found for each query class, and k + 1 are found where there are so many."""
    kind = "t int, bucket long, rep long, v array<double>"
    index = cut_lineage(classes.select("rep", "v").mapInPandas(_hash_rows(hasher), kind), "ann-index")
    # Both are bounded: the buckets by the number of cells, the sample by its size.
    held = Held.of([tuple(r) for r in index.groupBy("t", "bucket").count().collect()])
    sample = drawn(classes, SAMPLE, "v").select("v").collect()
    probes = fit_probes(hasher, held, np.array([s.v for s in sample]), k)
    need = min(k + 1, int(held.rows[0].sum()))
    asked = cut_lineage(queries.select("rep", "v").mapInPandas(_probe_rows(hasher, held, probes, need), "t int, g long, rep long, v array<double>, buckets array<long>"), "ann-probes")
    # A group of more vectors than a block, one large bucket, is cut into blocks, and so are its queries. The groups of
    # buckets are bounded by the number of cells, so they may go everywhere.
    spark, found = classes.sparkSession, []
    for t, (codes, rows, groups) in enumerate(zip(held.codes, held.rows, held.groups(), strict=True)):
        size = np.bincount(groups, rows).astype(np.int64)
        found += [(t, int(c), int(g), int(-(-size[g] // BLOCK_ROWS))) for c, g in zip(codes, groups, strict=True)]
    blocks = spark.createDataFrame(found, "t int, bucket long, g long, n_i int")
    parts = max(1, -(-queries.count() // BLOCK_QUERIES))
    own_i = F.pmod(F.xxhash64("rep"), F.col("n_i")).cast("int")
    own_q = F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")
    left = index.join(F.broadcast(blocks), ["t", "bucket"]).select("t", "g", own_i.alias("bi"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("bq"), "bucket", "rep", "v")
    whole = F.broadcast(blocks.select("t", "g", "n_i").distinct())
    right = asked.join(whole, ["t", "g"]).select("t", "g", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("bi"), own_q.alias("bq"), "rep", "v", "buckets")
    keys = ["t", "g", "bi", "bq"]
    fn = _rank_block(k)
    ranked = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda i, q: fn(i, q), "q long, rep long, score double")
    merged = ranked.distinct()  # the same pair, found in two tables, has the same exact score
    place = F.expr("row_number() OVER (PARTITION BY q ORDER BY score DESC, rep)")
    return merged.withColumn("place", place).filter(F.col("place") <= k + 1).select("q", "rep", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row that ``is_query`` (a column) holds for.

    The nearest have the largest inner product in double precision; ties go to the
    smaller vec_id, and a row does not find itself. Every query gets ``k`` rows, or all
    candidates if there are fewer. Vectors that are null, zero, empty
    or hold null or non-finite components, and rows without an id, take no part. Vectors
    of different lengths never meet. Repeated rows of one id count once if their vectors
    are equal; with different vectors the id is searched and found by each. Other
    columns are not read; an empty table gives no rows.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    # Minus zero and zero are one value.
    usable = rows.filter(good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).distinct()
    stored = cut_lineage(usable, "vectors")
    # Of equal vectors only the k + 1 smallest ids can be among the nearest.
    order = F.expr("row_number() OVER (PARTITION BY v ORDER BY vec_id)")
    members = stored.select("v", "vec_id").withColumn("place", order).filter(F.col("place") <= k + 1)
    classes = cut_lineage(members.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    classes = cut_lineage(classes.select("v", "ids", F.monotonically_increasing_id().alias("rep")), "classes")
    asking = cut_lineage(stored.filter("asks").select("v", "vec_id").join(classes.select("v", "rep"), "v").select("rep", "v", F.col("vec_id").alias("query_id")), "asking")
    spark = vectors.sparkSession
    found = spark.createDataFrame([], "q long, rep long, score double")
    length = F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.sqrt(F.max(length)).alias("longest")).orderBy("dim").collect():  # one row for each dimension
        same = classes.filter(F.size("v") == r.dim)
        hasher = Hasher.make(r.dim, r.longest)
        questions = asking.filter(F.size("v") == r.dim).select("rep", "v").distinct()
        found = found.union(_search(same, questions, hasher, k))
    named = found.join(classes.select("rep", "ids"), "rep").select("q", "score", F.explode("ids").alias("vec_id"))
    best = named.withColumn("place", F.expr("row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)")).filter(F.col("place") <= k + 1)
    answers = best.join(asking.select(F.col("rep").alias("q"), "query_id"), "q").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")
    return answers.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
