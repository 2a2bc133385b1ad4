"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes marks triggers, which cut every text into
phrases at places that depend on content alone. A string of ``LENGTH`` bytes that starts
at ``p`` is then a suffix of a dictionary phrase (from ``p`` to the first trigger at or
after it) followed by a piece of the parse, and equal strings have the trigger at the
same distance. So strings are ordered by (distance, phrase suffix, parse) - only as deep
as ``LENGTH`` bytes, beyond which order does not matter, and as digests, since only
equality does:

* The starts before a trigger form blocks of ``BLOCK``. What all strings of a block
  share, its core, is digested once; a block whose core occurs nowhere else holds no
  repeat. Few blocks of ordinary text go on.
* Where two blocks of a core are alike in everything their strings cover, all their
  starts repeat.
* In the others, at the ends of repeats, and in one of each kind of the alike ones
  they meet, the block is cut into smaller ones that are treated the same way, down to
  blocks of one start.

Starts without a trigger in reach (a phrase longer than the string) look for one of a
denser kind; where there is none of these either they are blocks of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucketed, cut_lineage, discard, map_batches, numbered, utf8

LENGTH = 400
TRIGGER = 16
#: One place in so many is a trigger; the second, denser kind serves starts that have none of the first in reach.
SPARSITY = (128, 32)
#: Starts in the blocks that an undecided block is cut into, from step to step.
CUTS = (16, 1)
#: Bytes of text that are parsed together.
TOGETHER = 1 << 21
#: Texts with repeats are told apart where they are read if there are no more than so many (two longs each).
MARKED = 500_000
KEY = ["u1", "u2"]
BLOCK_COLUMNS = ["core", "cover", "n", "lo", "hi", "at"]
BLOCK_TYPE = ", ".join(f"{c} bigint" for c in [*BLOCK_COLUMNS, *KEY])


@dataclass(frozen=True)
class Shape:
    """Sizes that follow from the length of a repeated string, in bytes."""

    length: int = LENGTH

    def __post_init__(self):
        if self.length < 4 * TRIGGER:
            raise ValueError(f"strings of {4 * TRIGGER} bytes at least")

    @property
    def reach(self) -> int:
        return self.length - TRIGGER

    @property
    def block(self) -> int:
        return (self.reach + 3) // 3

    @property
    def core(self) -> int:
        return self.length - self.block + 1


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``TRIGGER`` bytes from each place on."""
    if len(data) < TRIGGER:
        return np.zeros(0, np.uint32)
    h, factor, width = data.astype(np.uint32), 0x9E3779B1, 1
    while width < TRIGGER:  # the hash of twice as many bytes, from two that lie side by side
        h = h[:-width] * np.uint32(factor) + h[width:]
        factor, width = factor * factor & 0xFFFFFFFF, 2 * width
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE3D)
    return h


def anchored(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int):
    """Deal ranges of starts (lo to hi) to the first of the triggers ``t`` at or after each start, if it is in reach.

    Gives (range, trigger, first start, last start) arrays, and (range, first, last) of the starts left over.
    """
    a, b = np.searchsorted(t, lo), np.searchsorted(t, hi + reach, "right")
    n = b - a
    of = np.repeat(np.arange(len(lo)), n)
    k = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = t[k]
    after = np.where(k == a[of], lo[of], t[k - 1] + 1)
    first, last = np.maximum(after, at - reach), np.minimum(at, hi[of])
    ok = first <= last
    behind = np.where(n > 0, t[b - 1] + 1, lo) if len(t) else lo
    rest = np.concatenate((of, np.arange(len(lo)))), np.concatenate((after, behind)), np.concatenate((np.minimum(at - reach - 1, hi[of]), hi))
    left = rest[1] <= rest[2]
    return (of[ok], at[ok], first[ok], last[ok]), tuple(r[left] for r in rest)


def parse(texts: list[bytes], shape: Shape = Shape()) -> Iterator[tuple[list[int], list[int], int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the texts in turn: digests of core and cover, times seen, text number, first and last start in it, end of the block.

    Times seen is one, or two where this very call has met the string again; zero marks
    starts known to repeat, whose strings are among the others.
    """
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
            size += len(texts[stop])
            stop += 1
        yield from _parse_joined(texts[at:stop], at, shape)
        at = stop


def _parse_joined(texts: list[bytes], first_text: int, shape: Shape):
    length, reach, block, inner = shape.length, shape.reach, shape.block, shape.core
    data = b"".join(texts)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    hashes = rolling(np.frombuffer(data, np.uint8))
    digest = xxhash.xxh3_64_intdigest
    doc = np.flatnonzero(end - start >= length)
    lo, hi = start[doc], end[doc] - length
    for level, sparsity in enumerate(SPARSITY):
        if not len(lo):
            return
        t = np.flatnonzero(hashes < np.uint32((1 << 32) // sparsity))
        (of, at, first, last), (left, r_lo, r_hi) = anchored(t, lo, hi, reach)
        for j in range(-(-(reach + 1) // block)):
            a = at - block * j
            b_lo, b_hi = np.maximum(first, a - block + 1), np.minimum(last, a)
            ok = b_lo <= b_hi
            a, b_lo, b_hi, d = a[ok], b_lo[ok], b_hi[ok], doc[of[ok]]
            core = [digest(data[x : x + inner], 8 * level + j) for x in a.tolist()]
            cut = ((a - b_lo) * block + (a - b_hi)).tolist()
            cover = [digest(data[x : y + length], s) for x, y, s in zip(b_lo.tolist(), b_hi.tolist(), cut, strict=True)]
            yield core, cover, 1, d + first_text, b_lo - start[d], b_hi - start[d], a - start[d]
        doc, lo, hi = doc[left], r_lo, r_hi
    # What is left is periodic as a rule: its strings recur nearby, and one row for each different string will do.
    for a, b in _slices(hi - lo + 1):
        p = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)])
        d = np.repeat(doc[a:b], hi[a:b] - lo[a:b] + 1)
        # Two halves of one 128-bit digest: nothing but a digest tells these strings apart.
        halves = np.empty(len(p), [("core", np.uint64), ("cover", np.uint64)])
        for k, i in enumerate(p.tolist()):
            both = xxhash.xxh3_128_intdigest(data[i : i + length], 99)
            halves[k] = both >> 64, both & 0xFFFFFFFFFFFFFFFF
        kinds, first, kind, count = np.unique(halves, return_index=True, return_inverse=True, return_counts=True)
        for n in (1, 2):
            some = first[np.minimum(count, 2) == n]
            at = p[some] - start[d[some]]
            yield halves["core"][some], halves["cover"][some], n, d[some] + first_text, at, at, at
        p, d = p[count[kind] > 1], d[count[kind] > 1]
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(d) != 0)))) if len(p) else p
        x, y, d = p[cuts], p[np.concatenate((cuts[1:], [len(p)])) - 1] if len(p) else p, d[cuts]
        none = [0] * len(d)
        yield none, none, 0, d + first_text, x - start[d], y - start[d], y - start[d]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that have up to about ``TOGETHER`` starts together."""
    a, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > a and held + n > TOGETHER:
            yield a, k
            a, held = k, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def _blocks(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k) for k in KEY]
            for core, cover, n, doc, lo, hi, at in parse(utf8(batch.column("text")), shape):
                if len(doc):
                    digests = [np.array(x, np.uint64).view(np.int64) for x in (core, cover)]
                    cols = [*digests, np.full(len(doc), n), *(x.astype(np.int64) for x in (lo, hi, at))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols] + [k.take(pa.array(doc)) for k in keys], [*BLOCK_COLUMNS, *KEY])

    return run


def _smaller(shape: Shape, size: int):
    """Cut undecided blocks (``open``: lo, hi, at) into blocks of ``size`` starts, counted from the block's end."""
    core = shape.length - size + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest = xxhash.xxh3_64_intdigest
        cols: list[list[int]] = [[] for _ in BLOCK_COLUMNS]
        where: list[int] = []
        for i, (text, blocks) in enumerate(zip(utf8(batch.column("text")), batch.column("open").to_pylist(), strict=True)):
            for b in blocks:
                for k in range((b["at"] - b["hi"]) // size, (b["at"] - b["lo"]) // size + 1):
                    at = b["at"] - k * size
                    lo, hi = max(b["lo"], at - size + 1), min(b["hi"], at)
                    cover = digest(text[lo : hi + shape.length], (at - lo) * size + (at - hi))
                    for col, v in zip(cols, (digest(text[at : at + core], 1000 + k), cover, 1, lo, hi, at), strict=True):
                        col.append(v)
                    where.append(i)
        digests = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
        keys = [batch.column(k).take(pa.array(where, pa.int64())) for k in KEY]
        return pa.RecordBatch.from_arrays([*digests, *(pa.array(c, pa.int64()) for c in cols[2:]), *keys], [*BLOCK_COLUMNS, *KEY])

    return run


def _decided(blocks: DataFrame) -> DataFrame:
    """Blocks that may repeat, stored: ``alike`` ones repeat whole, ``open`` ones are to be cut further. ``blocks`` is a stored table, deleted here.

    Of a core with covers of several kinds, the blocks of a kind that is there once are
    open, and of each other kind one block is both, to be met by them.
    """
    real = blocks.filter("n > 0")
    # Copies meet on the way, so that a core of many blocks is a few rows when it is counted. Counts are stored
    # before they are joined: then Spark can deal the blocks of a hot core over several tasks.
    cores = real.groupBy("core").agg(F.sum("n").alias("all"), F.min("cover").alias("a"), F.max("cover").alias("b")).filter("all > 1")
    cores = cut_lineage(cores.select("core", (F.col("a") == F.col("b")).alias("alike")), "cores")
    met = cut_lineage(real.join(cores, "core").select("core", "cover", "lo", "hi", "at", *KEY, "alike"), "met")
    mixed = met.filter("NOT alike").drop("alike")
    one = F.struct(*KEY, "lo")
    kinds = cut_lineage(mixed.groupBy("core", "cover").agg(F.count(F.lit(1)).alias("members"), F.min(one).alias("first")), "kinds")
    sorted_out = mixed.join(kinds, ["core", "cover"]).select(
        "lo", "hi", "at", *KEY, (F.col("members") > 1).alias("alike"), ((F.col("members") == 1) | (F.col("first") == one)).alias("open")
    )
    sure = F.lit(True).alias("alike"), F.lit(False).alias("open")
    rest = met.filter("alike").select("lo", "hi", "at", *KEY, *sure).union(blocks.filter("n = 0").select("lo", "hi", "at", *KEY, *sure))
    decided = cut_lineage(sorted_out.union(rest), "decided")
    for done in (cores, met, kinds, blocks):
        discard(done)
    return decided


def merged(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal (begin, end) runs of bytes covered by strings whose starts lie in the given (first, last) ranges."""
    runs: list[list[int]] = []
    for lo, hi in sorted(starts):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi + length)
        else:
            runs.append([lo, hi + length])
    return [(a, b) for a, b in runs]


def _remains(text: bytes, ranges: list[dict], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged([(r["lo"], r["hi"]) for r in ranges], length)
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), runs


def _resolved(docs: DataFrame, text: str, keep: list[str], from_files: bool, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Rows (``row``: struct of ``keep``, and text) without a repeat, and rows with the ranges of their repeated starts."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    if from_files:
        # A row of a file is known by the file and its place, however the file is split or read again.
        keyed = docs.select(F.xxhash64("_metadata.file_path").alias("u1"), F.col("_metadata.row_index").alias("u2"), row, F.col(text).alias("text"))
    else:
        stored, uid = numbered(docs, "documents")
        keyed = stored.select(F.lit(0).cast("long").alias("u1"), F.col(uid).alias("u2"), row, F.col(text).alias("text"))
    long_enough = keyed.filter(F.octet_length("text") >= shape.length).select(*KEY, "text")
    blocks = cut_lineage(long_enough.mapInArrow(_blocks(shape), BLOCK_TYPE), "blocks")
    steps = [_decided(blocks)]
    # The texts that may hold a repeat are set apart and kept in buckets: all later steps read only them, and in place.
    marks = cut_lineage(steps[0].select(*KEY).distinct(), "marks").withColumn("marked", F.lit(True))
    if marks.count() <= MARKED:
        marks = F.broadcast(marks)
    told = keyed.join(marks, KEY, "left")
    touched = bucketed(told.filter("marked").drop("marked"), KEY, "touched")
    for size in CUTS:
        undecided = steps[-1].filter("open").groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi", "at")).alias("open"))  # of one text
        texts = touched.select(*KEY, "text").join(undecided, KEY)
        steps.append(_decided(cut_lineage(map_batches(texts, _smaller(shape, size), BLOCK_TYPE), "smaller")))
    ranges = reduce(DataFrame.union, [s.filter("alike").select("lo", "hi", *KEY) for s in steps])
    listed = cut_lineage(ranges.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")  # of one text
    for step in steps:
        discard(step)
    found = touched.join(listed, KEY, "left").select("row", "text", F.coalesce("ranges", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("ranges"))
    return told.filter("marked IS NULL").select("row", "text"), found


def _digests(shape: Shape):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, removed, spans, sha = [], [], [], []
        for text, ranges in zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            kept, runs = _remains(text, ranges, shape.length)
            size.append(len(text))
            removed.append(len(text) - len(kept))
            spans.append(len(runs))
            sha.append(hashlib.sha256(kept).hexdigest())
        cols = [batch.column("row"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(sha, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _shortened(shape: Shape):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(utf8(batch.column("text")), batch.column("ranges").to_pylist(), strict=True)
        kept = [_remains(text, ranges, shape.length)[0].decode("utf-8", "ignore") for text, ranges in both]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    return run


def _with_row(df: DataFrame, others: str) -> StructType:
    """A schema of the column ``row`` as it is in ``df``, and ``others``."""
    return StructType([df.schema["row"], *StructType.fromDDL(others)])


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", from_files: bool = False, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, for the bytes covered by a repeated string.

    A null text is empty. Texts under ``length`` bytes hold no such string. Repeated rows of
    at least that many bytes repeat each other and lose everything, as copies do. A very long text needs a few
    times its bytes in one task. Other columns are not read; an empty table gives no rows. ``from_files``: ``docs`` is a
    table of Parquet files as Spark reads it, whose rows need no number of their own.
    """
    shape = Shape(length)
    clean, found = _resolved(docs, text, [doc_id], from_files, shape)
    changed = map_batches(found, _digests(shape), _with_row(found, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
    whole, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    same = clean.select("row", F.octet_length(whole).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(whole, 256).alias("kept_sha256"))
    return changed.unionByName(same).select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text: str = "text", from_files: bool = False, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; all other columns and all rows stay.

    What is left of a character that was cut through goes too, so that the text stays
    valid UTF-8. Unchanged texts, null ones too, are passed on as they are. A very long text
    needs a few times its bytes in one task.
    """
    keep = [c for c in docs.columns if c != text]
    shape = Shape(length)
    same, found = _resolved(docs, text, keep, from_files, shape)
    changed = map_batches(found, _shortened(shape), _with_row(found, "text string"))
    named: dict[str, Column] = {c: F.col("text") if c == text else F.col(f"row.`{c}`") for c in docs.columns}
    return changed.unionByName(same).select(*[v.alias(c) for c, v in named.items()])
