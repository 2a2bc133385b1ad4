"""SimHash near-dedup and removal of repeated strings against brute force."""

import random

import numpy as np
import pytest
from helpers import DOC, components, docs_of, fingerprint, repeats, stored

from trackspark.llm import simhash, suffix_dedup
from trackspark.llm.components import component_roots


def near_copies(n, seed=1):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(900)}" for _ in range(rnd.randrange(1, 220))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "Ersatz"
        out.append(" ".join(w))
    return [None, "", " \n\t", "one", "One", "one two", "É é", *out, out[0], "x " * 70_000]


def test_simhash_components(spark):
    texts = near_copies(120)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    want = {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, components(prints), strict=True))}
    assert got == want


def test_simhash_long_lists_keep_exact_counts():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 1 << 64, n, np.uint64).tolist() for n in (0, 1, 2, 65_535, 65_536, 140_001)]
    lists.append([5] * 70_000 + [6] * 70_000)
    for bits, one in zip(simhash.majority_bits(lists).tolist(), lists, strict=True):
        a = np.array(one, np.uint64)
        assert bits == sum(1 << k for k in range(64) if 2 * int(((a >> np.uint64(k)) & np.uint64(1)).sum()) > len(one))


def test_links_miss_no_pair(spark):
    rnd = random.Random(5)
    words = {rnd.getrandbits(64) for _ in range(60)}
    for w in list(words):
        words |= {w ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4)}
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    frame = spark.createDataFrame([(w,) for w in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.near_links(frame).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & mask).bit_count() <= 3}


def test_thresholds_fill_the_pigeonhole():
    cost, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 9, 2: 30, 3: 99}, {-1: 0, 0: 1, 1: 40, 2: 90, 3: 99}, {-1: 0, 0: 7, 1: 8, 2: 9, 3: 10}], 1)
    assert sum(chosen) == 1 and cost == min(
        a[x] + b[y] + c[z]
        for a, b, c in [({-1: 0, 0: 5, 1: 9, 2: 30, 3: 99}, {-1: 0, 0: 1, 1: 40, 2: 90, 3: 99}, {-1: 0, 0: 7, 1: 8, 2: 9, 3: 10})]
        for x in a for y in b for z in c if x + y + z == 1
    )


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(2)
    order = list(range(1000, 1060))
    rnd.shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(1, k) for k in range(2, 200)] + [(7000, 7000), (None, 3), (8000, 8001), (8001, 8000)]
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1000 for k in order} | {k: 1 for k in range(1, 200)} | {8000: 8000, 8001: 8000}
    assert component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_drop_near_duplicates_keeps_one_row_and_all_columns(spark):
    text = " ".join(f"t{i}" for i in range(80))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "c"), (None, text, "d"), (None, "alone", "e"), (9, None, "f"), (8, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = simhash.drop_near_duplicates(df)
    kept = {tuple(r) for r in got.collect()}
    assert got.columns == df.columns
    assert len(kept) == 3 and {k[2] for k in kept} & {"b", "c"} and {"e", "g"} <= {k[2] for k in kept}
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def repeated_texts(seed):
    rnd = random.Random(seed)

    def noise(n):
        return "".join(rnd.choice("abcdefghij klmnopqé\n") for _ in range(n))

    passage, boiler = noise(900), noise(390)
    out = [None, "", "short", noise(399), noise(400), noise(3000)]
    for _ in range(12):
        out.append(noise(rnd.randrange(700)) + passage[rnd.randrange(200) : rnd.randrange(600, 900)] + noise(rnd.randrange(700)))
        out.append(noise(rnd.randrange(300)) + boiler + noise(rnd.randrange(300)))
    out += ["a" * 1500, "ab" * 600, "xyz" * 140, "é" * 450, passage + "#" + passage, out[-1], noise(5000) + "q" * 2000]
    return out


@pytest.mark.parametrize("length", [64, 99, 256, 301])
def test_repeats_of_other_lengths(spark, tmp_path, length):
    texts = repeated_texts(length)
    df = stored(spark, docs_of(spark, texts), tmp_path)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_digests(df, from_files=True, length=length).collect()}
    assert got == dict(enumerate(repeats(texts, length)))


def test_a_very_long_text_repeats_inside(spark):
    rnd = random.Random(2)
    body = "".join(rnd.choices("abcdefghijklmnop qrstuvwxyz", k=3_000_000))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_digests(docs_of(spark, [body + body[1000:2500], "short"])).collect()}
    assert got == {0: 3000, 1: 0}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("from_files", [True, False])
def test_repeats_match_brute_force(spark, tmp_path, seed, from_files):
    texts = repeated_texts(seed)
    df = docs_of(spark, texts)
    df = stored(spark, df, tmp_path) if from_files else df
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_digests(df, from_files=from_files).collect()}
    assert got == dict(enumerate(repeats(texts)))


def test_repeats_with_repeated_and_null_ids(spark):
    long = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(700))
    rows = [(1, long, "x"), (1, long, "y"), (None, None, "z"), (None, "short", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.repeat_digests(df).collect())
    assert got == [("1", 700, 700), ("1", 700, 700), ("None", 0, 0), ("None", 5, 0)]
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    assert sorted((r.row, r.text) for r in cut.collect()) == [("w", "short"), ("x", ""), ("y", ""), ("z", None)]
    empty = spark.createDataFrame([], DOC)
    assert suffix_dedup.repeat_digests(empty).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0


def test_cut_characters_do_not_stay(spark):
    piece = "é" * 300
    df = docs_of(spark, ["x" + piece, "yy" + piece + "z"])
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert all(set(t) <= set("xyz") for t in got.values())
