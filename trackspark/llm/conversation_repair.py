"""Repair of broken conversations by lightest derivations (Knuth's agenda).

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Edits make it so:
Keep a row (0), Rerole it to user or assistant (3), Delete it (4; blank and duplicate rows
must go), Insert an empty user or assistant row (3); a truncated row that stays adds 3.

The deductions, as a weighted hypergraph:

    edit(i, x)   row i becomes the symbol x, or nothing
    rest(i, q)   rows i, i+1, ... can be repaired from state q of the pattern on

    edit(i, x), rest(i + 1, q.x)  =>  rest(i, q)          insert(x), rest(i, q.x)  =>  rest(i, q)

An item weighs (cost, rows consumed, audit), in this order; a deduction adds the first two
and puts the edit's initial before the audit of the rest. Writing to the front keeps the
order of audits, and no result is less than its premises (a free Keep consumes a row), so
these functions are monotone and superior: items leave the agenda in final form, and the
first ``rest(0, start)`` is the lightest repair, ties by the ASCII-least audit.

Rows are ordered by turn (nulls first), role, text. Spark partitions and sorts them and
marks the faults; a task streams its sorted rows. Of a conversation it keeps a byte a row
and the agenda (a few small items a row); its texts wait in a file beyond ``SPOOL`` bytes.

Null roles and texts read as one space; a role without initial s, u or a (also an empty
one) can't be kept. A null conversation id is one conversation; null turns come first and count in no
gap. Repeated rows are duplicates. A table without rows gives none. Columns other than the named ones are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cost of each edit, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols: role initials, and 0 for any other or none.
SYMBOLS = {"s": 1, "u": 2, "a": 3}
USER, ASSISTANT = SYMBOLS["u"], SYMBOLS["a"]
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: ``(s?(ua)+)?``: next state by state and symbol.
START, NEXT, FINAL = 0, ({1: 1, 2: 2}, {2: 2}, {3: 3}, {2: 2}), (0, 3)
#: State and the symbol that leads to the given state.
BACK = {q: [(p, x) for p in range(4) for x, to in NEXT[p].items() if to == q] for q in range(4)}
LEGAL_PAIRS = {(1, 2), (2, 3), (3, 2)}
#: Faults, in the order in which the first one counts.
NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of a conversation's texts kept in memory.
SPOOL = 16 << 20
ROWS_OUT = 2048


class Audit:
    """Initials of edits, first edit first, sharing their tails."""

    __slots__ = ("edit", "symbol", "tail")

    def __init__(self, edit: str, symbol: int, tail: Audit | None):
        self.edit, self.symbol, self.tail = edit, symbol, tail

    def __lt__(self, other: Audit | None) -> bool:
        a, b = self, other
        while a is not b:
            if a is None or b is None:
                return a is None
            if a.edit != b.edit:
                return a.edit < b.edit
            a, b = a.tail, b.tail
        return False


#: The empty audit: less than all others, never unfolded.
END = Audit("", 0, None)


def lightest(codes: bytes) -> tuple[int, list[tuple[str, int]]]:
    """Cost and (edit, symbol) of the lightest repair of rows given as ``4 * symbol + fault``."""
    n = len(codes)
    agenda: list[tuple[int, int, Audit, int, int]] = [(0, 0, END, n, -1 - q) for q in FINAL]
    for i, code in enumerate(codes):
        symbol, fault = divmod(code, 4)
        # Edits carry their symbol in the last field, rests their state as a negative number.
        agenda.append((DELETE, 1, Audit("D", 0, END), i, 0))
        if fault not in (BLANK, DUPLICATE):
            stays = TRUNCATED if fault == CUT else 0
            if symbol:
                agenda.append((KEEP + stays, 1, Audit("K", symbol, END), i, symbol))
            agenda.extend((REROLE + stays, 1, Audit("R", x, END), i, x) for x in NAMES)
    heapq.heapify(agenda)
    edits: list[dict[int, tuple[int, str]]] = [{} for _ in range(n)]
    rests: list[dict[int, tuple[int, int, Audit]]] = [{} for _ in range(n + 1)]
    while True:
        cost, used, audit, i, what = heapq.heappop(agenda)
        if what >= 0:
            if what in edits[i]:
                continue
            edits[i][what] = (cost, audit.edit)
            for q, (c, k, tail) in rests[i + 1].items():
                for p in [q] if what == 0 else [p for p, x in BACK[q] if x == what]:
                    heapq.heappush(agenda, (cost + c, 1 + k, Audit(audit.edit, what, tail), i, -1 - p))
            continue
        q = -1 - what
        if q in rests[i]:
            continue
        rests[i][q] = (cost, used, audit)
        if i == 0 and q == START:
            break
        for p, x in BACK[q]:
            if x in NAMES:
                heapq.heappush(agenda, (cost + INSERT, used, Audit("I", x, audit), i, -1 - p))
        if i:
            for x, (c, edit) in edits[i - 1].items():
                for p in [q] if x == 0 else [p for p, y in BACK[q] if y == x]:
                    heapq.heappush(agenda, (cost + c, used + 1, Audit(edit, x, audit), i - 1, -1 - p))
    path = []
    while audit is not END:
        path.append((audit.edit, audit.symbol))
        audit = audit.tail
    return cost, path


class _Conversation:
    """What a task keeps of the conversation it is reading."""

    def __init__(self, key):
        self.key, self.codes = key, bytearray()
        self.turns = self.low = self.high = None
        self.texts = tempfile.SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.codes.append(4 * SYMBOLS.get(role[:1], 0) + fault)
        if turn is not None:
            if self.low is None:
                self.low, self.turns = turn, 1
            elif turn != self.high:
                self.turns += 1
            self.high = turn
        for part in (role.encode(), text.encode()):
            self.texts.write(struct.pack("<Q", len(part)))
            self.texts.write(part)

    def counts(self) -> dict:
        faults = [0] * 4
        for code in self.codes:
            faults[code % 4] += 1
        symbols = [code // 4 for code in self.codes]
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": faults[BLANK],
            "duplicate": faults[DUPLICATE],
            "truncated": faults[CUT],
            "illegal": sum(pair not in LEGAL_PAIRS for pair in zip(symbols, symbols[1:], strict=False)),
        }

    def repaired(self, path: list[tuple[str, int]]) -> Iterator[tuple[str, bytes, bytes]]:
        """(edit, role, text) of each row of the repaired conversation."""

        def part() -> bytes:
            return self.texts.read(*struct.unpack("<Q", self.texts.read(8)))

        self.texts.seek(0)
        for edit, symbol in path:
            if edit == "I":
                yield edit, NAMES[symbol].encode(), b""
                continue
            role, text = part(), part()
            if edit != "D":
                yield edit, NAMES[symbol].encode() if edit == "R" else role, text


def _prepared(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their first fault, sorted inside partitions that hold whole conversations."""
    named = df.select(
        F.col(conversation).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    same = Window.partitionBy("key", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(body == "", BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT)
        .otherwise(NO_FAULT)
    )
    # The window needs no exchange of its own: equal keys are together already.
    marked = named.withColumn("digest", F.unhex(F.sha2("text", 256))).repartition("key").withColumn("fault", fault).drop("digest")
    # Of equal rows in one turn, which are alike in all else, the first is the one that stays.
    order = [F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "fault_last"]
    return marked.withColumn("fault_last", F.col("fault") == DUPLICATE).sortWithinPartitions(*order).drop("fault_last")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[_Conversation]:
    now = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for key, turn, role, text, fault in zip(*columns, strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now
                    now.texts.close()
                now = _Conversation(key)
            now.add(turn, role, text, fault)
    if now is not None:
        yield now
        now.texts.close()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded rows and text."""

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([] for _ in schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= ROWS_OUT or size > SPOOL:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _mapped(prepared: DataFrame, conversation: str, fields: list[tuple[str, pa.DataType]], ddl: str, rows_of) -> DataFrame:
    kind = prepared.schema["key"].dataType
    name = "`" + conversation.replace("`", "``") + "`"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([(conversation, first.schema.field(0).type), *fields])

        def read():
            yield first
            yield from batches

        yield from _batches((row for c in _conversations(read()) for row in rows_of(c)), schema)

    return prepared.mapInArrow(run, f"{name} {kind.simpleString()}, {ddl}")


def repair_report(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: faults found, ``cost`` and ``audit`` of the lightest repair, digest of its result."""

    def rows_of(c: _Conversation):
        cost, path = lightest(bytes(c.codes))
        digest = hashlib.sha256()
        for k, (_, who, said) in enumerate(c.repaired(path)):
            digest.update(b"\n" * (k > 0) + who + b":")
            digest.update(said)
        yield (c.key, *c.counts().values(), cost, "".join(edit for edit, _ in path), digest.hexdigest())

    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    fields = [*((n, pa.int64()) for n in numbers), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    ddl = ", ".join(f"{n} long" for n in numbers) + ", audit string, repaired_sha256 string"
    return _mapped(_prepared(df, conversation, turn, role, text), conversation, fields, ddl, rows_of)


def repair_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: ``turn`` from 0 without gaps, ``role``, ``text`` and the ``edit`` that made each."""

    def rows_of(c: _Conversation):
        _, path = lightest(bytes(c.codes))
        for k, (edit, who, said) in enumerate(c.repaired(path)):
            yield (c.key, k, who.decode(), said.decode(), edit)

    fields = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
    return _mapped(_prepared(df, conversation, turn, role, text), conversation, fields, "turn long, role string, text string, edit string", rows_of)
