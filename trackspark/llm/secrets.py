"""Secret scan: patterns, and formats learned from what the patterns find.

Three patterns find credentials (``assign``, ``access``, ``hex``). The values they find are
labelled credentials. For each kind, and for plain tokens of the same alphabet, a prefix
tree of sampled values is folded into a probabilistic automaton: states whose ending and
branching frequencies agree within Hoeffding bounds are merged, with all that follows them;
a state that agrees with several joins the one that makes its values likeliest.
Every other token of a text is a candidate; it is added as a secret of the kind whose automaton
accepts it and makes it likeliest, if that beats a plain token by more than the odds of ``PRIOR``:
the automaton of plain tokens, which accepts all, and for words and numbers also a uniform draw of
letters or digits, as the sample need not hold any.

The fit takes at most ``SAMPLE`` distinct values of a kind, those of smallest digest over
all documents, of at most ``VALUE_CHARS`` characters; kinds with fewer than ``LEAST`` values
get no automaton. Each task sends on no more than that sample. The scan itself is one pass
over whole texts, without a shuffle.

Null and empty texts have no spans; repeated rows get equal results; very long texts and
tokens are scanned whole (memory: the text and its spans). An empty table gives no rows.
A column ``spans`` of the input makes the new one ``_spans``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import fresh_name

#: The patterns, and the least length of a finding.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED = 6
KINDS = ("assign", "access", "hex")
PLAIN = "plain"
#: Candidates: runs of the value alphabet that neither begin nor end in punctuation.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
ALPHABET = 67
#: Words and numbers, and the number of symbols each draws from.
UNIFORM = ((re.compile(r"[0-9]+"), 10), (re.compile(r"[A-Z]+|[A-Za-z][a-z]+"), 26))

SAMPLE, VALUE_CHARS, LEAST = 1000, 256, 20
#: Confidence of the merge test, counts added to each symbol, odds that a candidate is a secret.
ALPHA, SMOOTH, PRIOR = 0.05, 0.1, 1e-6
#: Groups of tasks whose samples are merged first.
MERGES = 64


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the patterns' findings by start, then kind."""
    # The first pattern is tried as it stands: a finding that fails still takes up its characters.
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [(m.start(), k, m.end(), m[0]) for k, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text)]
    return [(start, end, KINDS[k], value) for start, k, end, value in sorted(found)]


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the candidates that touch no span of ``base``."""
    spans, at, reach = base, 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start():
            yield m.start(), m.end(), m[0]


@dataclass
class Automaton:
    """Counts of a prefix tree whose compatible states have been merged."""

    arrivals: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])  # symbol: [count, state]

    @classmethod
    def learn(cls, values: list[str], alpha: float = ALPHA) -> Automaton:
        made = cls()
        for value in sorted(values):
            made._insert(value)
        made._merge_all(alpha)
        return made

    def _insert(self, value: str) -> None:
        state = 0
        self.arrivals[0] += 1
        for symbol in value:
            move = self.moves[state].get(symbol)
            if move is None:
                move = self.moves[state][symbol] = [0, len(self.moves)]
                self.arrivals.append(0)
                self.ends.append(0)
                self.moves.append({})
            move[0] += 1
            state = move[1]
            self.arrivals[state] += 1
        self.ends[state] += 1

    def _merge_all(self, alpha: float) -> None:
        """Border states by falling arrivals; each joins the likeliest settled one it agrees with, or settles."""
        settled = [0]
        while border := min(
            ((symbols, p, s) for p in settled for s, (_, q) in self.moves[p].items() if q not in settled for symbols in [(-self.arrivals[q], settled.index(p), s)]),
            default=None,
        ):
            _, parent, symbol = border
            state = self.moves[parent][symbol][1]
            # A state with few arrivals agrees with most, as nothing tells them apart; equals go to the state before it.
            if agreeing := [other for other in settled if self._agree(other, state, alpha)]:
                other = max(agreeing, key=lambda p: (self._fit(p, state), p == parent)) if len(agreeing) > 1 else agreeing[0]
                self.moves[parent][symbol][1] = other
                self._fold(other, state)
            else:
                settled.append(state)
        self._renumber(settled)

    def _agree(self, a: int, b: int, alpha: float) -> bool:
        width = math.sqrt(0.5 * math.log(2 / alpha))
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            n, m = self.arrivals[p], self.arrivals[q]
            if not n or not m:
                continue
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:  # too few to tell, and what follows is rarer still
                continue
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for symbol in self.moves[p].keys() | self.moves[q].keys():
                x, y = self.moves[p].get(symbol), self.moves[q].get(symbol)
                if abs((x[0] if x else 0) / n - (y[0] if y else 0) / m) > bound:
                    return False
                if x and y and x[1] != y[1]:
                    pairs.append((x[1], y[1]))
        return True

    def _fit(self, into: int, tree: int) -> float:
        """Log likelihood of the values below a border state if they began in ``into``; what it has not seen is drawn from the alphabet."""
        total = 0.0
        pairs: list[tuple[int | None, int]] = [(into, tree)]
        while pairs:
            p, q = pairs.pop()
            moves = {} if p is None else self.moves[p]
            if p is None:
                total -= self.arrivals[q] * math.log(ALPHABET + 1)
            else:
                whole = math.log(self.arrivals[p] + SMOOTH * (ALPHABET + 1))
                total += self.ends[q] * (math.log(self.ends[p] + SMOOTH) - whole)
                total += sum(count * (math.log((moves[c][0] if c in moves else 0) + SMOOTH) - whole) for c, (count, _) in self.moves[q].items())
            pairs += [(moves[c][1] if c in moves else None, below) for c, (_, below) in self.moves[q].items()]
        return total

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a border state, which is still the root of a tree, and of all below it."""
        pairs = [(into, tree)]
        while pairs:
            p, q = pairs.pop()
            self.arrivals[p] += self.arrivals[q]
            self.ends[p] += self.ends[q]
            for symbol, (count, below) in self.moves[q].items():
                if (move := self.moves[p].get(symbol)) is None:
                    self.moves[p][symbol] = [count, below]
                else:
                    move[0] += count
                    pairs.append((move[1], below))

    def _renumber(self, settled: list[int]) -> None:
        place = {state: k for k, state in enumerate(settled)}
        self.arrivals = [self.arrivals[s] for s in settled]
        self.ends = [self.ends[s] for s in settled]
        self.moves = [{c: [n, place[q]] for c, (n, q) in self.moves[s].items()} for s in settled]

    def tables(self, strict: bool) -> Tables:
        """Log probabilities. A symbol not seen in a state is impossible if ``strict``, else rare and leads to the first state."""
        steps, others, stops = [], [], []
        for n, e, moves in zip(self.arrivals, self.ends, self.moves, strict=True):
            total = n + SMOOTH * (ALPHABET + 1)
            steps.append({c: (math.log((k + SMOOTH) / total), q) for c, (k, q) in moves.items()})
            others.append((-math.inf if strict else math.log(SMOOTH / total), 0))
            stops.append(math.log((e + SMOOTH) / total))
        return Tables(steps, others, stops)


@dataclass(frozen=True)
class Tables:
    steps: list[dict[str, tuple[float, int]]]
    others: list[tuple[float, int]]
    stops: list[float]

    def log_likelihood(self, token: str) -> float:
        state, total = 0, 0.0
        for symbol in token:
            gain, state = self.steps[state].get(symbol) or self.others[state]
            total += gain
        return total + self.stops[state]


class _Smallest:
    """The ``SAMPLE`` distinct values of smallest digest seen so far."""

    def __init__(self):
        self.held: dict[str, int] = {}
        self.most = 1 << 64

    def add(self, value: str) -> None:
        if len(value) > VALUE_CHARS or value in self.held:
            return
        if (digest := xxhash.xxh64_intdigest(value, seed=0)) < self.most:
            self.held[value] = digest
            if len(self.held) >= 2 * SAMPLE:
                self.cut()

    def cut(self) -> list[tuple[int, str]]:
        kept = sorted((d, v) for v, d in self.held.items())[:SAMPLE]
        self.held = {v: d for d, v in kept}
        if len(kept) == SAMPLE:
            self.most = kept[-1][0]
        return kept


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {kind: _Smallest() for kind in (*KINDS, PLAIN)}
    for batch in batches:
        for text in batch.column(0):
            if text := text.as_py():
                base = base_spans(text)
                for _, _, kind, value in base:
                    found[kind].add(value)
                for _, _, token in candidates(text, base):
                    found[PLAIN].add(token)
    # Digests have 64 bits, halved to fit a signed number; the value breaks ties.
    rows = [(kind, digest >> 1, value) for kind, smallest in found.items() for digest, value in smallest.cut()]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["kind", "digest", "value"])


def labelled_sample(df: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """At most ``SAMPLE`` distinct values per kind found by the patterns, and plain tokens."""
    found = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(_samples, "kind string, digest long, value string")
    rows = found.withColumn("part", F.spark_partition_id() % MERGES)
    for keys in (["kind", "part"], ["kind"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("digest", "value"))
        rows = rows.groupBy(*keys, "digest", "value").count().withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).drop("rank", "count")
    out: dict[str, list[str]] = {kind: [] for kind in (*KINDS, PLAIN)}
    for r in rows.collect():
        out[r["kind"]].append(r["value"])
    return out


def learn_formats(values: dict[str, list[str]]) -> dict[str, Tables]:
    """An automaton for each kind with enough values, and for plain tokens."""
    return {kind: Automaton.learn(v).tables(strict=kind != PLAIN) for kind, v in values.items() if kind == PLAIN or len(v) >= LEAST}


def plain_likelihood(token: str, formats: dict[str, Tables]) -> float:
    """Log likelihood as a plain token: by its automaton, or as a uniform draw if it is a word or a number."""
    learned = formats[PLAIN].log_likelihood(token)
    size = next((n for pattern, n in UNIFORM if pattern.fullmatch(token)), None)
    return max(learned, -(len(token) + 1) * math.log(size + 1)) if size else learned


def best_format(token: str, formats: dict[str, Tables]) -> tuple[float, str | None]:
    """Log odds of the likeliest kind against plain tokens, and the kind if they are in favour."""
    rated = [(formats[kind].log_likelihood(token), kind) for kind in KINDS if kind in formats]
    if not rated:
        return -math.inf, None
    score, kind = max(rated, key=lambda r: r[0])
    odds = score - plain_likelihood(token, formats) + math.log(PRIOR)
    return odds, kind if odds > 0 else None


def find_all(text: str, formats: dict[str, Tables]) -> list[dict]:
    """The spans of a text by start, then kind; ``odds`` only of added ones."""
    base = base_spans(text)
    spans = [{"kind": kind, "start": start, "end": end, "added": False, "odds": None} for start, end, kind, _ in base]
    for start, end, token in candidates(text, base):
        odds, kind = best_format(token, formats)
        if kind:
            spans.append({"kind": kind, "start": start, "end": end, "added": True, "odds": odds})
    return sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_()), ("odds", pa.float64())])
SPANS_TYPE = from_arrow_type(pa.list_(SPAN))


def scan(df: DataFrame, text: str = "text", formats: dict[str, Tables] | None = None) -> DataFrame:
    """The columns of ``df`` but ``text``, and ``spans``: array of (kind, start, end, added, odds), in code points.

    ``formats`` are learned from ``df`` itself if not given.
    """
    formats = learn_formats(labelled_sample(df, text)) if formats is None else formats
    at, name = df.columns.index(text), fresh_name(df, "spans")
    schema = StructType([*(f for f in df.schema if f.name != text), StructField(name, SPANS_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [find_all(t.as_py() or "", formats) for t in batch.column(at)]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(SPAN))], [*names, name])

    return df.mapInArrow(run, schema)
