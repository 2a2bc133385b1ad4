"""Token packing by best-fit decreasing.

A document's ids are cut into full windows, which need no search, and a rest. Rests
are dealt evenly into groups of bounded size; each group is packed longest first,
into the open window with the least room that still fits, found in a segment tree
over the remaining capacities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .tokens import encoder

#: Rests packed together. Of so many, only the last windows stay partly empty.
GROUP = 16_384
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class CapacityTree:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room of at least ``size``."""
        node = size + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child, or the root's right side: nothing further right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.open[room].pop()
        while node and not self.open[room]:
            if node < self.leaves and (self.any[2 * node] or self.any[2 * node + 1]):
                break
            self.any[node] = 0
            node >>= 1
        return room, window


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length, given from long to short."""
    tree, windows, offsets, opened = CapacityTree(capacity), [], [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found = (capacity, opened)
            opened += 1
        room, window = found
        windows.append(window)
        offsets.append(capacity - room)
        if room > n:
            tree.put(room - n, window)
    return windows, offsets


def _pieces(path: str, end: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, found in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                ids = np.append(found.astype("<u4"), np.array([end], "<u4"))
                for at in range(0, len(ids), window):
                    part = ids[at : at + window].tobytes()
                    cols["doc_id"].append(doc)
                    cols["start"].append(at)
                    cols["length"].append(len(part) // 4)
                    cols["ids_crc32"].append(zlib.crc32(part))
                    cols["doc_tokens"].append(len(ids))
                    if with_ids:
                        cols["ids"].append(part)
            arrays = [pa.array(cols[k], pa.int64()) for k in list(cols)[:5]]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols["ids"], pa.binary())] if with_ids else [])], list(cols)[: 5 + with_ids])

    return run


def _pack_group(window: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = group.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        local, offset = best_fit(order["length"].tolist(), window)
        # A group's windows are numbered behind the number of the group; even ids are full windows.
        return pd.DataFrame({"uid": order["uid"].to_numpy(), "sequence_id": order["g"].to_numpy() * (1 << 32) + np.array(local, np.int64) * 2 + 1, "offset": np.array(offset, np.int64)})

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    ``ids`` holds little-endian 32-bit ids. A null text is empty: its document is the
    end id alone. Documents longer than a window are first cut into full windows.
    Repeated rows are packed each on their own, a null doc_id stays null. Sequence ids
    are unique but not gapless; a sequence's offsets are. Other columns are not read;
    an empty table gives no rows.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = source.mapInArrow(_pieces(vocabulary, end, window, with_ids), PIECES + (", ids binary" if with_ids else ""))
    stored = cut_lineage(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest = stored.filter(F.col("length") < window)
    groups = -(-max(1, rest.count()) // GROUP)
    dealt = rest.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g"))
    placed = dealt.groupBy("g").applyInPandas(_pack_group(window), "uid bigint, sequence_id bigint, offset bigint")
    names = [c for c in stored.columns if c != "uid"]
    packed = stored.filter(F.col("length") < window).join(placed, "uid").select(*names, "sequence_id", "offset")
    full = stored.filter(F.col("length") == window).select(*names, (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and length of each sequence of ``pack(..., with_ids=True)``, not padded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
