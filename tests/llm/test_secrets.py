"""The secret scan against plain patterns, and the learned automata."""

import hashlib
import random
import re
import string

import pytest
from helpers import docs_of

from trackspark.llm import model_queries, secrets


def brute(text):
    """(kind, start, end) by the patterns as they are written down."""
    out = []
    for k, (kind, pattern, flags, group, least) in enumerate(
        [
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
            ("hex", r"[0-9a-f]+", 0, 0, 24),
        ]
    ):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def key(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    hexes = string.digits + "abcdef"
    words = ["the", "station", "reads", "bedeaf", "tokens:", "secret", "überlang", "straßenbahn", "Token", "=", "http://www.example.com/path/to/page"]
    out = []
    for k in range(300):
        parts = [rng.choice(words) for _ in range(30)]
        parts.insert(rng.randrange(30), rng.choice(['token = "%s"', "API_KEY:%s", "passwd='%s'", "secret=%s"]) % key(rng, hexes, 40))
        parts.insert(rng.randrange(30), "AKIA" + key(rng, string.ascii_uppercase + string.digits, 16))
        parts.insert(rng.randrange(30), "".join(rng.choice(["tion", "heit", "ung", "ment", "que"]) for _ in range(6)))
        out.append(" ".join(parts))
    out[7] += " " + key(rng, hexes, 23)  # one character short for the pattern
    out[8] += " DIESISTEINLANGESWORT 4111111111111111"
    out += ["", None, "token = token = abcdef123", "AKIA" + "B" * 15, "a" * 23, "𝒳 token=ſecret12 AKIA" + "Z" * 20]
    return out


def test_base_matches_the_patterns(texts):
    for text in texts:
        assert [(kind, start, end) for start, end, kind, _ in secrets.base_spans(text or "")] == brute(text)


def test_query_columns_and_added_spans(spark, texts, tmp_path):
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in model_queries.op11_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    added = 0
    for i, text in enumerate(texts):
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert tuple(got[i][f"n_{k}"] for k in secrets.KINDS) == tuple(sum(b[0] == k for b in base) for k in secrets.KINDS)
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(joined.split(",")) - {""} <= set(spans)
        order = [(int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
        added += len(spans) - len(base)
    assert f"{len(texts[7])}" in got[7]["spans"]  # the short key is found by its format
    assert got[8]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in brute(texts[8]))  # a long word and a number are plain
    assert added <= 3


def test_automaton_merges_what_looks_alike():
    rng = random.Random(1)
    values = ["AKIA" + key(rng, string.ascii_uppercase + string.digits, 16) for _ in range(500)]
    made = secrets.Automaton.learn(values)
    assert len(made.moves) < 12 and sum(made.ends) == 500
    tables = made.tables(strict=True)
    assert tables.log_likelihood("AKIA" + key(rng, string.ascii_uppercase + string.digits, 16)) > tables.log_likelihood("AKIA" + "Z" * 40)
    assert tables.log_likelihood("BKIA" + "Z" * 16) == float("-inf")
    # Probabilities of all continuations and of stopping add up to one.
    for n, e, moves in zip(made.arrivals, made.ends, made.moves, strict=True):
        assert n == e + sum(c for c, _ in moves.values())


@pytest.mark.parametrize("n", [60, 300, 1000])
def test_rare_states_do_not_blur_the_format(n):
    for seed in range(5):
        rng = random.Random(seed)
        made = secrets.Automaton.learn(["AKIA" + key(rng, string.ascii_uppercase + string.digits, 16) for _ in range(n)])
        tables = made.tables(strict=True)
        assert made.moves[0].keys() == {"A"}  # values of few arrivals do not begin anew
        assert tables.log_likelihood("ZKIA" + "7Q" * 8) == float("-inf")


def test_words_and_numbers_are_plain_unseen():
    rng = random.Random(3)
    values = {k: [] for k in (*secrets.KINDS, secrets.PLAIN)}
    values["hex"] = [key(rng, string.digits + "abcdef", 40) for _ in range(300)]
    values["assign"] = [key(rng, string.ascii_letters + string.digits, 30) for _ in range(300)]
    for plain in ([], ["".join(rng.choice(["tion", "heit", "ung"]) for _ in range(6)) for _ in range(300)]):
        formats = secrets.learn_formats({**values, secrets.PLAIN: plain})
        for token in ("4111111111111111", "9807915762804490", "DIESISTEINLANGESWORT", "Fahrzeugversicherung", "incomprehensibilities"):
            assert secrets.best_format(token, formats)[1] is None
        assert secrets.best_format(key(rng, string.digits + "abcdef", 23), formats)[1] == "hex"


def test_sample_does_not_depend_on_partitions(spark, texts, monkeypatch):
    monkeypatch.setattr(secrets, "SAMPLE", 50)
    docs = docs_of(spark, texts)
    one, many = (secrets.labelled_sample(docs.repartition(n)) for n in (1, 9))
    assert {k: sorted(v) for k, v in one.items()} == {k: sorted(v) for k, v in many.items()}
    assert all(len(v) <= 50 for v in one.values()) and len(one["hex"]) == 50


def test_awkward_tables(spark, texts):
    clash = docs_of(spark, texts).selectExpr("doc_id as spans", "text", "source as kind")
    assert secrets.scan(clash).columns == ["spans", "kind", "_spans"]
    empty = docs_of(spark, []).select("doc_id", "text")
    assert secrets.scan(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, None), (1, "x" * 200)], "doc_id long, text string")
    assert [len(r["spans"]) for r in secrets.scan(nulls).collect()] == [0, 0, 0]


def test_long_text(spark):
    long = "word " * 4_000_000 + "token = " + "ab" * 20
    got = secrets.scan(docs_of(spark, [long]), formats={}).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in got] == brute(long)
