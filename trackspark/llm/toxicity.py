"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Only documents have labels. A sentence scores a logistic of its features' weights,
and a document's score is the noisy-or of its sentences: one is enough. Weights are
fitted to the document labels through the noisy-or, so that credit goes to the
sentences that explain a label, which are then the ones located.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut_lineage, discard

#: The fit sees about this many labelled documents of each class, whatever their length ...
SAMPLE = 2500
#: ... fewer, drawn alike from all lengths, where they hold more than this many bytes together ...
SAMPLE_BYTES = 100_000_000
#: ... and keeps at most this many features.
FEATURES = 20_000
#: ... that set the classes apart by so many standard errors.
CLEAR = 3.0
THRESHOLD = 0.7
#: Documents whose scores a worker gathers before it passes them on.
TOGETHER = 500
#: A sentence ends at a mark or line break; one that goes on is cut between words, so that length alone adds up to nothing.
SENTENCE = re.compile(r"[^.!?\n]{0,240}[^.!?\n\s]*[.!?\n]?")
WORD = re.compile(r"[^\W\d_]+|\d+")
PREFIXES = (3, 4, 5, 6)


def word_features(word: str) -> list[str]:
    """A word and its beginnings, so that inflected forms share what they have in common."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, length) of the sentences of a text that hold anything but white space."""
    return [(m.start(), m.end() - m.start()) for m in SENTENCE.finditer(text) if m[0].strip()]


@dataclass
class Model:
    """Log-odds of features of a sentence; a sentence without known features scores ``base``."""

    weights: dict[str, float]
    base: float
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        got = self._words.get(word)
        if got is None:
            if len(self._words) > 300_000:
                self._words.clear()
            got = self._words[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return got

    def quiet(self, sentences_: int) -> float:
        """Log probability that none of so many featureless sentences is toxic."""
        return -sentences_ * np.log1p(np.exp(self.base))

    def sentence(self, text: str) -> float:
        """Log-odds of one sentence: each different word counts once."""
        total = 0.0
        for w in set(WORD.findall(text)):
            total += self.word(w)
        return self.base + total

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score, and (start, length, score) of each sentence at or above one half."""
        lowered = text.lower()
        # Lower-casing may change lengths; then places are those in the lower-cased text.
        spans = sentences(lowered)
        odds = np.array([self.sentence(lowered[a : a + n]) for a, n in spans])
        if not len(odds):
            return 0.0, []
        quiet = -np.logaddexp(0.0, odds)
        p = 1.0 - np.exp(quiet)
        found = [(*spans[i], float(p[i])) for i in np.flatnonzero(odds >= 0)]
        return float(-np.expm1(quiet.sum())), found


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(text: str) -> set[str]:
    """All features of a document."""
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def _bag(text: str, number: dict[str, int]) -> tuple[int, dict[tuple[int, ...], int]]:
    """The number of sentences of a document, and how often each list of feature numbers occurs among them."""
    low = text.lower()
    spans = sentences(low)
    bag: dict[tuple[int, ...], int] = {}
    for a, n in spans:
        got = tuple(sorted(number[f] for w in set(WORD.findall(low[a : a + n])) for f in word_features(w) if f in number))
        if got:
            bag[got] = bag.get(got, 0) + 1
    return len(spans), bag


def _choose(rows: DataFrame, neg: int, pos: int) -> list[str]:
    """The features that set the classes of text and y rows apart, at most FEATURES."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                names = pa.array(sorted(_features(batch.column("text")[at].as_py() or "")), pa.string())
                y = batch.column("y")[at].as_py()
                yield pa.RecordBatch.from_arrays([names, pa.array([y] * len(names), pa.int32())], ["feature", "y"])

    counts = rows.mapInArrow(found, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    neg, pos = max(1, neg), max(1, pos)
    # How far apart the classes are, in standard errors; features of a few documents say little.
    lift = F.abs(F.col("p") / pos - (F.col("n") - F.col("p")) / neg) / F.sqrt((F.col("n") + 1) / (pos + neg) * (1 / pos + 1 / neg))
    return [x.feature for x in counts.withColumn("lift", lift).filter(F.col("lift") >= CLEAR).orderBy(F.desc("lift"), "feature").limit(FEATURES).collect()]


def _bags(rows: DataFrame, names: list[str]) -> list[tuple[int, int, list[list[int]], list[int]]]:
    """(y, number of sentences, lists of feature numbers, how often each occurs) of each document; no texts."""

    number = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                count, bag = _bag(batch.column("text")[at].as_py() or "", number)
                cols = [[batch.column("y")[at].as_py()], [count], [[list(k) for k in bag]], [list(bag.values())]]
                kinds = [pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["y", "sentences", "bag", "times"])

    got = rows.mapInArrow(run, "y int, sentences int, bag array<array<int>>, times array<int>").toArrow()
    return sorted((r["y"], r["sentences"], r["bag"], r["times"]) for r in got.to_pylist())


def fit(names: list[str], bags: list[tuple[int, int, list[list[int]], list[int]]], rounds: int = 600, ridge: float = 2e-3, rate: float = 0.15) -> Model:
    """Fit sentence weights to document labels through the noisy-or, by Adam over the whole sample.

    Classes weigh the same. Without both classes nothing can be learnt: every score is 0.
    """
    y = np.array([b[0] for b in bags], bool)
    if y.all() or not y.any():
        return Model({}, -30.0)
    sizes = [len(s) for b in bags for s in b[2]]
    doc_of = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    feature = np.array([f for b in bags for s in b[2] for f in s], np.int64)
    sent_of = np.repeat(np.arange(len(sizes)), sizes)
    times = np.array([n for b in bags for n in b[3]], np.float64)
    bare = np.array([b[1] for b in bags]) - np.bincount(doc_of, times, len(bags))
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, base = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        odds = base + np.bincount(sent_of, w[feature], len(sizes))
        quiet = -np.logaddexp(0, odds)
        none = np.bincount(doc_of, times * quiet, len(bags)) - bare * np.logaddexp(0, base)
        p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        # d loss / d none: a positive is explained by any sentence, a negative needs all quiet.
        d_none = weight * np.where(y, (1 - p) / p, -1.0)
        d_odds = -d_none[doc_of] * times * np.exp(-np.logaddexp(0, -odds))
        grad = np.append(np.bincount(feature, d_odds[sent_of], len(names)) + ridge * w / max(1, len(names)) ** 0.5, d_odds.sum() - (d_none * bare).sum() / (1 + np.exp(-base)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, base = w - step[:-1], base - float(step[-1])
    keep = {n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 1e-3}
    return Model(keep, base)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """About SAMPLE labelled documents of each class that are not held out, as text and label.

    The ids are drawn by a digest, before the texts are read, and again by their share of SAMPLE_BYTES
    where their texts hold more. Ids labelled both ways are left out; of several texts of an id the
    least counts. So the same rows give the same sample, however they are dealt.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2")
    stored = cut_lineage(once.select("doc_id", "y"), "labels")
    digest = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    counts = {r["y"]: r["n"] for r in stored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1 << 40)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(int((1 << 40) * min(1.0, SAMPLE / n)))).otherwise(share)
    few = stored.filter(digest < share)
    # Few by construction, so they may go everywhere.
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    if total > SAMPLE_BYTES:
        # A second digest, as the first one is below its share for all.
        texts = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < F.lit(int((1 << 40) * SAMPLE_BYTES / total)))
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled documents that are not held out; only features come to the driver."""
    rows = cut_lineage(training_rows(docs, labels, label), "training")
    seen = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        discard(rows)
        return Model({}, -30.0)
    names = _choose(rows, seen[0], seen[1])
    model = fit(names, _bags(rows, names))
    discard(rows)
    return model


def _scored(model: Model, spans: bool, text: str, carried: bool):
    """Scores behind the columns of a batch; ``text`` is one of them, or with ``carried`` a field of the first."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).field(text) if carried else batch.column(text)
        scored = [model.score(t or "") for t in texts.to_pylist()]
        kept = [(n, batch.column(n)) for n in batch.schema.names if carried or n != text]
        cols = [*(c for _, c in kept), pa.array([s for s, _ in scored], pa.float64())]
        names = [*(n for n, _ in kept), "score"]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
            cols.append(pa.array([[dict(zip(("start", "length", "score"), s, strict=True)) for s in f] for _, f in scored], kind))
            names.append("offending")
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield one(batch.slice(at, TOGETHER))

    return run


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """The columns ``keep``, score and, if asked for, the offending sentences (start, length, score) of every whole text.

    A null or empty text has no sentence and scores 0. Repeated rows each give a row.
    """
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("scored_text"))
    kinds = [f"`{n}` {t}" for n, t in source.dtypes[:-1]] + ["score double"]
    if spans:
        kinds.append("offending array<struct<start:int,length:int,score:double>>")
    return source.mapInArrow(_scored(model, spans, "scored_text", False), ", ".join(kinds))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and offending for every document; a null id is not held out.

    Labels only enter the fit; rows of ``labels`` without a document, with null labels or
    ids are ignored. An empty table gives no rows; without labels of both kinds all
    scores are 0.
    """
    scored = score_documents(docs, train(docs, labels), ["doc_id"], spans=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    # A whole row goes to Python and back as one column, with its text once.
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = carried.mapInArrow(_scored(train(docs, labels), False, "text", True), StructType([*carried.schema, StructField("score", DoubleType())]))
    return scored.filter(F.col("score") < THRESHOLD).select("row.*")
