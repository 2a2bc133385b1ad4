"""Shards of equal bytes by histogram sort.

Rows are ordered by (digest of the text, digest of the row's id and place): equal texts are
neighbours. Splitters are found without sorting: each round counts the exact bytes
below evenly spaced probes in the intervals that still hold a splitter, and keeps the
interval around each target, until the splitter is near enough or its interval holds
one text only. Splitters so fall between texts; only inside a large group of equal texts
are they refined once more, by the digest of the row. Then all rows are exchanged once, along the splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard, fresh_name, keyed

LOW, HIGH = -(1 << 63), (1 << 63) - 1
PROBES = 256
#: Bytes by which a splitter may miss its target, as a share of a shard.
TOLERANCE = 1 / 4096
#: A group of equal texts is cut only where leaving it whole would miss by more than this share.
GROUP_TOLERANCE = 1 / 64
#: Most bytes of text in a partition of the exchange; there are as many partitions as the session shuffles to, at least.
PART_BYTES = 64 << 20


def _literal(x: int) -> Column:
    return F.lit(x).cast("long")


def _cells(key: str, spans: list[tuple[int, int]]) -> Column:
    """struct(span, cell) of the key inside one of the disjoint ``spans`` (inclusive), else null."""
    found = F.lit(None).cast("struct<span:int,cell:long>")
    for i, (lo, hi) in enumerate(spans):
        step = max(1, -(-(hi - lo + 1) // PROBES))
        # The difference of two longs may not fit a long; halves do.
        if hi - lo > HIGH:
            cell = F.expr(f"CAST(floor((CAST(`{key}` AS DECIMAL(20,0)) - ({lo})) / {step}) AS LONG)")
        else:
            cell = F.expr(f"(`{key}` - ({lo}L)) DIV {step}L") if lo > LOW else F.expr(f"CAST(floor((CAST(`{key}` AS DECIMAL(20,0)) - ({lo})) / {step}) AS LONG)")
        inside = F.col(key).between(_literal(lo), _literal(hi))
        found = F.when(inside, F.struct(F.lit(i).alias("span"), cell.alias("cell"))).otherwise(found)
    return found


def _refine(rows: DataFrame, key: str, targets: list[float], base: int, slack: float) -> list[tuple[int, int, int, int]]:
    """For each target (bytes below it) the narrowest interval found: (lo, hi, bytes before it, bytes in it).

    ``base`` is what lies before all keys of ``rows``. Keys before ``lo`` make up the
    bytes before. An interval whose edge is within ``slack`` of the target, or of one
    key, is final.
    """
    whole = int(rows.agg(F.sum("bytes")).first()[0] or 0)
    spans = [(LOW, HIGH, base, whole)] * len(targets)

    def final(span: tuple[int, int, int, int], target: float) -> bool:
        lo, hi, before, inside = span
        return lo == hi or not inside or min(target - before, before + inside - target) <= slack

    while any(open_ := [not final(s, t) for s, t in zip(spans, targets, strict=True)]):
        probed = sorted({s[:2] for s, o in zip(spans, open_, strict=True) if o})
        cell = _cells(key, probed)
        counts = rows.select(cell.alias("c"), F.col(key).alias("key"), "bytes").filter("c IS NOT NULL").groupBy("c").agg(F.sum("bytes").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        seen: dict[int, list[tuple[int, int, int]]] = {}
        for r in counts.collect():  # at most PROBES rows for each splitter
            seen.setdefault(r.c.span, []).append((r.lo, r.hi, int(r.bytes)))
        for k, (span, target) in enumerate(zip(spans, targets, strict=True)):
            if not open_[k]:
                continue
            before = span[2]
            for lo, hi, size in sorted(seen[probed.index(span[:2])]):
                if before + size >= target:
                    spans[k] = (lo, hi, before, size)
                    break
                before += size
    return spans


def splitters(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """``shards - 1`` pairs (k1, k2); a row belongs to the shard numbered by the pairs that are not above it.

    ``keys`` has k1, k2 and bytes, one row for each pair at least; it is read in each round.
    """
    total = int(keys.agg(F.sum("bytes")).first()[0] or 0)
    if not total:
        return [(HIGH, HIGH)] * (shards - 1)
    slack = total / shards * TOLERANCE
    targets = [total * (i + 1) / shards for i in range(shards - 1)]
    found: list[tuple[int, int] | None] = [None] * len(targets)
    hot: dict[int, list[int]] = {}
    spans = _refine(keys, "k1", targets, 0, slack)
    for i, ((lo, hi, before, inside), target) in enumerate(zip(spans, targets, strict=True)):
        near_lo, near_hi = target - before, before + inside - target
        if lo == hi and min(near_lo, near_hi) > total / shards * GROUP_TOLERANCE:
            hot.setdefault(lo, []).append(i)
        elif near_lo <= near_hi:
            found[i] = (lo, LOW)
        else:
            found[i] = (hi + 1, LOW) if hi < HIGH else (HIGH, HIGH)
    for k1, members in hot.items():  # at most one group for each splitter
        before = spans[members[0]][2]
        inner = _refine(keys.filter(F.col("k1") == _literal(k1)), "k2", [targets[i] for i in members], before, 0)
        for i, (lo, hi, start, inside) in zip(members, inner, strict=True):
            near_lo, near_hi = targets[i] - start, start + inside - targets[i]
            found[i] = (k1, lo) if near_lo <= near_hi else (k1, hi + 1) if hi < HIGH else (k1 + 1, LOW)
    return sorted(found)


def _shard_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below (k1, k2), as a balanced tree of comparisons."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = cuts[mid]
        reached = (F.col("k1") > _literal(a)) | ((F.col("k1") == _literal(a)) & (F.col("k2") >= _literal(b)))
        return F.when(reached, node(mid + 1, hi)).otherwise(node(lo, mid))

    return node(0, len(cuts))


def shard_rows(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", from_files: bool = False) -> DataFrame:
    """All columns of ``docs`` with shard (0 up) and slot (0 up, without gaps, in each shard).

    The law is equal bytes: a row counts the UTF-8 bytes of its text (null: none) plus
    one. Rows with equal text go to one shard where that leaves shards equal; a larger group is cut
    anywhere, also between repeated rows. A null id is a value like any
    other. Columns of ``docs`` named shard or slot are replaced. An empty table gives
    no rows; with fewer rows than shards some shards stay empty. A row is never cut: a text that is
    longer than a shard's share makes its shard larger. ``from_files``: ``docs`` is a table of Parquet
    files as Spark reads it, whose rows need no number of their own.
    """
    rows, uid = keyed(docs, from_files)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    k1, k2 = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.xxhash64(F.col(doc_id), F.col(uid))
    # From here on a row is a few bytes.
    keys = cut_lineage(rows.select(k1.alias("k1"), k2.alias("k2"), size.alias("bytes")), "shard-keys")
    cuts = splitters(keys, shards)
    total = int(keys.agg(F.sum("bytes")).first()[0] or 0)
    wanted = max(-(-total // PART_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = -(-wanted // shards)
    discard(keys)
    body = rows.drop("shard", "slot")
    row, at, part = (fresh_name(body, n) for n in ("k_row", "k_at", "k_part"))
    keep = F.struct(*[F.col(f"`{c}`") for c in body.columns if c != uid])
    keyed_rows = body.select(keep.alias(row), k1.alias("k1"), k2.alias("k2"))
    placed = keyed_rows.select(row, _shard_of(cuts).alias("shard"), "k1", "k2")
    # The one exchange of the rows, along the splitters: a shard has as many partitions as it has bytes for.
    dealt = placed.repartitionById(shards * parts, (F.col("shard") * parts + F.pmod(F.col("k2"), F.lit(parts))).cast("int"))
    line = F.monotonically_increasing_id()
    stored = cut_lineage(
        dealt.sortWithinPartitions("k1", "k2").select(row, "shard", F.shiftright(line, 33).alias(part), line.bitwiseAND(F.lit((1 << 33) - 1)).alias(at)), "shards"
    )
    # Where each shard goes on in the next partition: one row for each partition and shard in it.
    runs = stored.groupBy("shard", part).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = F.coalesce(F.expr(f"sum(rows) OVER (PARTITION BY shard ORDER BY `{part}` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = runs.select(F.col("shard").alias("s"), F.col(part).alias("p"), (earlier - F.col("first")).alias("shift"))
    # As many rows as there are partitions: they may go everywhere.
    joined = stored.join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col(part) == F.col("p")))
    return joined.select(f"{row}.*", F.col("shard").cast("int").alias("shard"), (F.col(at) + F.col("shift")).cast("long").alias("slot"))
