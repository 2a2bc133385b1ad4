"""Lightest repairs against all repairs, and the query on awkward conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from trackspark.llm import conversation_repair as cr
from trackspark.llm import model_queries

LEGAL = re.compile(r"(s?(ua)+)?")
CONV = "conv_id long, turn long, role string, text string"


def all_repairs(rows):
    """(cost, audit, initials) of every edit of ``rows`` (symbol letter, fault) with at most two inserted rows a gap."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    per_row = []
    for letter, fault in rows:
        options = [(4, "D", "")]
        if fault not in (cr.BLANK, cr.DUPLICATE):
            extra = 3 if fault == cr.CUT else 0
            options += [(extra, "K", letter), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        per_row.append(options)
    for inserted in product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserted)) > 3:
            continue
        for edits in product(*per_row):
            initials, audit, cost = inserted[0], "I" * len(inserted[0]), 3 * len(inserted[0])
            for (c, e, x), more in zip(edits, inserted[1:], strict=True):
                initials, audit, cost = initials + x + more, audit + e + "I" * len(more), cost + c + 3 * len(more)
            if LEGAL.fullmatch(initials):
                yield cost, audit, initials


def test_against_all_repairs():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(rng.randrange(4))]
        cost, path = cr.lightest(bytes(4 * cr.SYMBOLS.get(c, 0) + f for c, f in rows))
        audit = "".join(e for e, _ in path)
        initials = "".join(" sua"[x] for _, x in path if x)
        assert (cost, audit, initials) == min(all_repairs(rows)), rows


def forward(rows):
    """Least (cost, audit) by brute dynamic programming over whole strings, from the end."""
    n = len(rows)
    best = [None] * (n + 1)
    for i in range(n, -1, -1):
        found = {q: [] for q in range(4)}
        for q in range(4):
            if i == n and q in cr.FINAL:
                found[q].append((0, ""))
            if i < n:
                letter, fault = rows[i]
                found[q].append((4 + best[i + 1][q][0], "D" + best[i + 1][q][1]))
                if fault not in (cr.BLANK, cr.DUPLICATE):
                    extra = 3 if fault == cr.CUT else 0
                    for c, e, x in [(0, "K", letter), (3, "R", "u"), (3, "R", "a")]:
                        to = cr.NEXT[q].get(cr.SYMBOLS.get(x, 0))
                        if to is not None:
                            found[q].append((c + extra + best[i + 1][to][0], e + best[i + 1][to][1]))
        least = {q: min(v) if v else (10**9, "") for q, v in found.items()}
        for _ in range(3):
            least = {q: min([least[q]] + [(3 + least[to][0], "I" + least[to][1]) for x, to in cr.NEXT[q].items() if x in cr.NAMES]) for q in least}
        best[i] = least
    return best[0][0]


def test_long_conversations():
    rng = random.Random(4)
    for n in (60, 400):
        rows = [(rng.choice("suuuaaax"), rng.choice([0] * 8 + [1, 2, 3, 3])) for _ in range(n)]
        cost, path = cr.lightest(bytes(4 * cr.SYMBOLS.get(c, 0) + f for c, f in rows))
        assert (cost, "".join(e for e, _ in path)) == forward(rows)
    many = bytes(4 * cr.SYMBOLS[c] for c in "ua" * 30_000)
    assert cr.lightest(many)[0] == 0


def brute(rows):
    """The query's columns but audit and hash for one damaged conversation, rows already in order."""
    seen, faults, turns = set(), [], {t for t, _, _ in rows if t is not None}
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count(1),
        "duplicate": faults.count(2),
        "truncated": faults.count(3),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
    }, list(zip(initials, faults, strict=True))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else v
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = ("user" if h == 4 else space(role)), {1: "", 2: re.sub("[.!?]", "", space(text))}.get(h, space(text))
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        turns = rng.randrange(1, 9)
        for t in range(turns):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Yes.", "What is it?", "An end", " \n", None, "Long. " * 50, "ok!\t"])
            rows.append((conv, None if rng.random() < 0.1 else t + rng.randrange(2), role, text))
    rows += rows[:20]  # repeated rows
    rows += [(500, None, None, None), (501, None, "user", "Hi."), (501, None, "assistant", "Hello.")]
    return rows


def test_query_against_brute_force(spark, conversations, tmp_path):
    df = spark.createDataFrame(conversations, CONV)
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in model_queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {c for c, *_ in conversations}
    whole = {}
    for conv, turn, role, text in damage(conversations):
        whole.setdefault(conv, []).append((turn, role, text))
    for conv, row in got.items():
        rows = sorted(whole.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, coded = brute(rows)
        cost, audit = forward(coded)
        assert {k: row[k] for k in counts} == counts, conv
        assert (row["cost"], row["audit"]) == (cost, audit)
        # Replay the audit: the pattern leaves one role for each reroled or inserted row.
        out, state, at = [], "", iter(rows)
        for e in audit:
            if e == "D":
                next(at)
                continue
            due = "assistant" if state == "u" else "user"
            _, role, text = next(at) if e != "I" else (None, due, "")
            out.append((role if e == "K" else due) + ":" + text)
            state = out[-1][0]
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_turns_are_the_digest_and_legal(spark, conversations):
    df = spark.createDataFrame(conversations, CONV).selectExpr("*", "1 AS cost", "2 AS fault")
    report = {r["conv_id"]: r for r in cr.repair_report(df).collect()}
    turns = {}
    for r in cr.repair_turns(df).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, row in report.items():
        rows = sorted(turns.get(conv, []), key=lambda r: r["turn"])
        assert [r["turn"] for r in rows] == list(range(len(rows)))
        assert LEGAL.fullmatch("".join(r["role"][0] for r in rows))
        assert hashlib.sha256("\n".join(r["role"] + ":" + r["text"] for r in rows).encode()).hexdigest() == row["repaired_sha256"]


def test_empty_table_and_a_long_conversation(spark):
    assert cr.repair_report(spark.createDataFrame([], CONV)).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    rows += [(2, 0, "user", "x" * 40_000_000 + "."), (2, 1, "assistant", "Yes.")]
    got = {r["conv_id"]: r for r in cr.repair_report(spark.createDataFrame(rows, CONV)).collect()}
    assert got[1]["audit"] == "K" * 3000 and got[1]["cost"] == 0
    assert got[2]["audit"] == "KK"
