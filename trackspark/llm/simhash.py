"""SimHash near-duplicates, linked through a generalised pigeonhole index.

Bits that go together are grouped into parts, each part gets its own threshold by
dynamic programming over estimated candidate counts, and fingerprints meet where a
part lies within its threshold. The pigeonhole holds when the thresholds of ``m``
parts sum to ``radius - m + 1`` (a threshold of -1 leaves a part out), so no pair
within the radius is missed; every meeting is verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard, fresh_name, keyed, map_batches, utf8
from .components import component_roots

BITS = 64
LANES = np.uint64(0x0001000100010001)
LANE_MAX = 65535
#: Bytes of text whose shingle hashes a worker holds together.
TOGETHER = 1 << 21


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words (all words, if fewer; none for no words)."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return [digest(joined, seed)]
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *[e + 1 for e in ends[: n - size]]]
    return [digest(joined[i:j], seed) for i, j in zip(starts, ends[size - 1 :], strict=True)]


def majority_bits(hashes: list[list[int]]) -> np.ndarray:
    """For each list the word whose bit is 1 where over half the hashes have it; 0 for an empty list."""
    out = np.zeros(len(hashes), np.uint64)
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(counts.sum()))
    # Sixteen-bit lanes hold counts up to 65,535: longer lists are summed piece by piece.
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    pieces = [np.arange(s, s + c, LANE_MAX) for s, c in zip(starts, counts[full], strict=True)]
    first = np.cumsum([0, *map(len, pieces)])[:-1]
    cuts = np.concatenate(pieces)
    half = counts[full] // 2
    word = np.zeros(len(full), np.uint64)
    for shift in range(16):
        lanes = np.add.reduceat((flat >> np.uint64(shift)) & LANES, cuts)
        for lane in range(4):
            ones = np.add.reduceat(((lanes >> np.uint64(16 * lane)) & np.uint64(LANE_MAX)).astype(np.int64), first)
            word |= (ones > half).astype(np.uint64) << np.uint64(16 * lane + shift)
    out[full] = word
    return out


def _with_fingerprint(text: str, name: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, bits = utf8(batch.column(text)), [np.zeros(0, np.uint64)]
        at = 0
        while at < len(texts):  # hashes of a whole batch would fill a worker
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
                size += len(texts[stop])
                stop += 1
            bits.append(majority_bits([shingle_hashes(t) for t in texts[at:stop]]))
            at = stop
        bits = np.concatenate(bits)
        keep = [(n, batch.column(n)) for n in batch.schema.names if n != text]
        return pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(bits.view(np.int64))], [*(n for n, _ in keep), name])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the 64-bit fingerprint as a long; the text itself is not carried on."""
    got = docs.select(*keep, text)
    kinds = ", ".join(f"`{n}` {t}" for n, t in got.dtypes if n != text)
    return map_batches(got, _with_fingerprint(text, name), f"{kinds}, `{name}` bigint")


# --- parts and thresholds --------------------------------------------------------------


def _pair_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    bits = ((words[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    both = np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j])], ["i", "j", "n"])


def bit_correlation(words: DataFrame) -> tuple[int, np.ndarray]:
    """Number of words and the absolute correlation of their bits, counted over all of them."""
    n = words.count()
    sums = map_batches(words.select("fp"), _pair_counts, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for r in sums.collect():  # one row for each pair of bits
        both[r.i, r.j] = both[r.j, r.i] = r.n
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return n, np.abs(np.divide(share - np.outer(p, p), spread, out=np.zeros_like(share), where=spread > 0))


def group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits into ``parts`` groups of near equal size, correlated bits together.

    Each group starts with the free bit of the highest total correlation and takes
    the free bits most correlated with it.
    """
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        seed = max(rest, key=lambda b: (correlation[b, rest].sum(), -b))
        group = [seed]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (correlation[b, group].sum(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds, one for each part, that sum to ``total`` at the least cost."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, more in part.items():
                found = (cost + more, (*chosen, t))
                if so_far + t not in step or found < step[so_far + t]:
                    step[so_far + t] = found
        best = step
    return best[total]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _ball(bits: list[int], radius: int) -> list[int]:
    return [_mask(list(c)) for k in range(radius + 1) for c in combinations(bits, k)]


def plan_parts(words: DataFrame, radius: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed.

    Costs count rows sent plus candidates met. The candidates of a part at threshold 0
    are counted over all words (pairs with equal part); a wider threshold multiplies
    them by the number of values in the ball.
    """
    n, correlation = bit_correlation(words)
    layouts = [group_bits(correlation, m) for m in range(2, radius + 2)]
    masks = sorted({_mask(g) for groups in layouts for g in groups})
    part = words.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for m in masks])).alias("p"))
    met = part.groupBy("p.m", "p.v").count().groupBy("m").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("met"))
    same = {r.m: r.met for r in met.collect()}  # one row for each part
    plans = []
    for groups in layouts:
        costs = []
        for g in groups:
            size = [sum(comb(len(g), k) for k in range(t + 1)) for t in range(radius + 1)]
            costs.append({-1: 0.0} | {t: max(n, 1) * (1 + s) + same.get(_mask(g), 0.0) * s for t, s in enumerate(size)})
        cost, chosen = allocate(costs, radius - len(groups) + 1)
        plans.append((cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def near_links(words: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs a > b of distinct words (column fp) at most ``radius`` bits apart.

    A popular part value may gather many words: the join is left to adaptive skew
    handling, and the exact distance is part of the join condition, so that only true
    links leave it.
    """
    plan = plan_parts(words, radius)

    def keys(pick) -> Column:
        made = []
        for k, (bits, t) in enumerate(plan):
            value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
            made += [F.struct(F.lit(k).alias("k"), value.bitwiseXOR(F.lit(x)).alias("v")) for x in pick(bits, t)]
        return F.explode(F.array(*made)).alias("p")

    index = words.select(F.col("fp").alias("a"), keys(lambda bits, t: [0])).select("a", "p.k", "p.v")
    probe = words.select(F.col("fp").alias("b"), keys(_ball)).select("b", "p.k", "p.v")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return index.join(probe, (index.k == probe.k) & (index.v == probe.v) & (F.col("a") > F.col("b")) & near).select("a", "b").distinct()


# --- the operator ----------------------------------------------------------------------


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for each fingerprint with a link; ``prints`` is a stored table."""
    words = cut_lineage(prints.select("fp").distinct(), "fingerprints")
    roots = component_roots(near_links(words, radius)).withColumnRenamed("node", "fp")
    discard(words)
    return roots


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Copies share a fingerprint, so links are sought between distinct fingerprints only.
    A null text counts as empty; texts without words have fingerprint zero and are
    linked like any other. Repeated rows each give a row. A null doc_id stays null and
    joins its component, whose id is null only where no row of it has an id. Other
    columns are not read. An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"]), "prints")
    roots = _roots(prints, radius)
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    placed = lowest.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, from_files: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, of repeated rows the first stored.

    Rows without an id come last in that order. All columns are kept as they are.
    ``from_files``: ``docs`` is a table of Parquet files as Spark reads it, whose rows need no number of their own.
    """
    rows, uid = keyed(docs, from_files)
    plain = rows.select(F.col(uid).alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(fingerprints(plain, ["uid", "doc_id"]), "prints")
    roots = _roots(prints, radius)
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first")
    by_print = prints.groupBy("fp").agg(order).join(roots, "fp", "left")
    first = by_print.groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    kept = cut_lineage(first.select(F.col("first.uid").alias(fresh_name(rows, "kept"))), "kept")
    discard(prints)
    # One plan at every size: ids are matched where the rows are dealt by them.
    return rows.join(kept.hint("merge"), rows[uid] == kept[kept.columns[0]], "left_semi").drop(uid)
