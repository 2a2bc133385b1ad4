"""Token files: one zstandard frame for each document, behind a dictionary all share.

A file is a folder of two Parquet tables. ``dictionary`` has one row: its SHA-256, its
bytes and the width of an id. ``segments`` has rows of some thousand neighbouring
documents in ascending doc_id order: their ids, the token counts, the offset of each
frame, and the frames. A reader finds a document by the id range of its segment, then
decompresses that one frame. Spark's own writer stores both, so any shared store will do
and a lost executor leaves no half-written part behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, map_batches
from .tokens import encoder

#: The dictionary is fitted on about this many documents of at most this many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 1024, 65_536
DICTIONARY_BYTES = 65_536
LEVEL = 3
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 4 << 20
SEGMENTS = "first_id bigint, last_id bigint, docs bigint, tokens bigint, dictionary string, doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, frames binary"


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of serialized id arrays; empty where there is nothing to learn from."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: their bytes themselves serve as one
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(LEVEL, dict_data=_dictionary(raw), write_checksum=False, write_dict_id=False)


def _segments(path: str, end: int, raw: bytes, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(path), _compressor(raw)
        doc_ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            seen = [d for d in doc_ids if d is not None]
            row = [min(seen, default=None), max(seen, default=None), len(doc_ids), sum(counts), name, doc_ids, counts, offsets, b"".join(frames)]
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            names = [c.split()[0] for c in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                full = np.append(ids, np.uint16(end)).astype("<u2")
                frame = squeeze.compress(full.tobytes())
                if frames and (len(frames) >= SEGMENT_DOCS or held + len(frame) > SEGMENT_BYTES):
                    yield flush()
                    doc_ids, counts, frames, held = [], [], [], 0
                doc_ids.append(doc)
                counts.append(len(full))
                frames.append(frame)
                held += len(frame)
        if frames:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, each document closed by ``end``, in ascending doc_id order.

    A null text is empty. Null ids come first; rows that share an id follow each other,
    ordered by a digest of the text. Other columns are not read. An empty table gives a
    file without segments.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    few = drawn(source.filter(F.octet_length("text").between(1, SAMPLE_BYTES)), SAMPLE_DOCS, "doc_id", "tie")
    texts = pa.array([r.text for r in few.select("text").collect()], pa.string())
    raw = fit_dictionary([ids.astype("<u2").tobytes() for ids in encoder(vocabulary).encode(texts)] if len(texts) else [])
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw), 2)], "dictionary string, bytes binary, width int").write.mode("overwrite").parquet(f"{path}/dictionary")
    ordered = source.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    segments = ordered.mapInArrow(_segments(vocabulary, end, raw, name), SEGMENTS)
    # Partitions are in order, and so are the numbers of their rows.
    numbered = segments.select(F.monotonically_increasing_id().alias("segment"), "*")
    numbered.write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/segments")


def _dictionary_of(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(row.bytes)
    if hashlib.sha256(raw).hexdigest() != row.dictionary:
        raise ValueError(f"damaged dictionary in {path}")
    return row.dictionary, raw


def _documents(raw: bytes, name: str, wanted: frozenset[int] | None):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        cols: tuple[list, ...] = ([], [], [], [])
        for row in batch.to_pylist():
            if row["dictionary"] != name:
                raise ValueError("a segment was written with another dictionary")
            frames, at, start = memoryview(row["frames"]), row["offsets"], row["start"]
            for k, (doc, n) in enumerate(zip(row["doc_ids"], row["counts"], strict=True)):
                if wanted is None or doc in wanted:
                    ids = np.frombuffer(open_.decompress(frames[at[k] : at[k + 1]]), "<u2")
                    for col, v in zip(cols, (doc, start, n, ids.astype("<u4").tobytes()), strict=True):
                        col.append(v)
                start += n
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit), one row for each document.

    With ``doc_ids`` only segments whose id range holds one of them are read, and only
    their frames are decompressed.
    """
    name, raw = _dictionary_of(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    part = F.shiftright("segment", 33)
    # Sums before a segment: inside its partition, and over the partitions before that.
    sums = segments.groupBy(part.alias("part")).agg(F.sum("tokens").alias("all"))
    before = sums.select("part", F.expr("coalesce(sum(all) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base"))
    inner = segments.select("segment", part.alias("part"), F.expr("coalesce(sum(tokens) OVER (PARTITION BY shiftright(segment, 33) ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("inner"))
    starts = inner.join(before, "part").select("segment", (F.col("base") + F.col("inner")).alias("start"))
    if doc_ids is not None:
        ids = sorted(set(doc_ids))
        near = F.lit(False)
        for d in ids:
            near = near | F.lit(d).between(F.col("first_id"), F.col("last_id"))
        segments = segments.filter(near)
    body = segments.select("segment", "dictionary", "doc_ids", "counts", "offsets", "frames").join(starts, "segment")
    wanted = None if doc_ids is None else frozenset(doc_ids)
    return map_batches(body, _documents(raw, name, wanted), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
