"""Sharding, WARC archives, nearest neighbours and toxicity."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import DOC, docs_of

from trackspark.llm import ann, sharding, toxicity, warc
from pyspark.sql import functions as F

PAGE = "page_id long, url string, html string, shard string"


def shard_sizes(rows, n):
    sizes, slots = [0] * n, [[] for _ in range(n)]
    for r in rows:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_shards_are_equal_and_groups_stay_together(spark):
    rnd = random.Random(1)
    texts = ["x" * rnd.randrange(1500) + f" {i}" for i in range(3000)] + [f"copy {k % 40} " + "y" * 50 for k in range(400)] + [None, ""]
    rows = sharding.shard_rows(docs_of(spark, texts), 7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and all(r.text == texts[r.doc_id] for r in rows)
    sizes = shard_sizes(rows, 7)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 7
    homes = {}
    for r in rows:
        homes.setdefault(r.text, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_hot_text_is_split(spark):
    texts = ["hot " * 30] * 2000 + [f"cold {i} " * 5 for i in range(1500)]
    sizes = shard_sizes(sharding.shard_rows(docs_of(spark, texts), 8).collect(), 8)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8


def test_repeated_rows_are_split(spark):
    """Rows alike in id and text hold a third of all rows, and rows without an id another third."""
    rows = [(7, "same row " * 20, "en", "s", 1)] * 3000 + [(None, "no id " * 20, "en", "s", 1)] * 3000 + [(i, f"cold {i} " * 9, "en", "s", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, DOC)
    sizes = shard_sizes(sharding.shard_rows(df, 16).collect(), 16)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 16


def test_shards_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 2000)
    texts = ["x" * (k % 300) + f" {k}" for k in range(700)] + ["long " * 200_000]
    rows = sharding.shard_rows(docs_of(spark, texts), 4).collect()
    assert len(rows) == len(texts) and sum(shard_sizes(rows, 4)) == sum(len(t) + 1 for t in texts)


def test_shards_of_few_repeated_and_no_rows(spark):
    df = docs_of(spark, {1: "a", None: None}).union(docs_of(spark, {1: "a"})).withColumnRenamed("lang", "slot").withColumnRenamed("source", "k_row")
    rows = sharding.shard_rows(df, 16).collect()
    assert len(rows) == 3 and sum(shard_sizes(rows, 16)) == 5
    assert sharding.shard_rows(spark.createDataFrame([], DOC), 4).count() == 0




def pages_case():
    rnd = random.Random(4)
    big = "<p>" + "é" * 200 + "</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(i, f"http://a/{i}", rnd.choice([big, "small", None, "", "x" * 100, "x" * 99, f"own {i} " * 40])) for i in range(20, 90)]
    return [*rows, (3, None, big), (3, "http://a/\r\n3", big), (None, "u", big), (None, "u", "y" * 300)]


def test_warc_round_trip(spark, tmp_path):
    case = pages_case()
    df = spark.createDataFrame([(*r, "mine") for r in case], PAGE)
    path = str(tmp_path / "warc")
    warc.write_warc(df.repartition(3), path)
    records = warc.read_records(spark, path).cache()
    assert {r.type: r.n for r in records.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}["request"] == len(case)
    caps = warc.captures(records).withColumn("page_id", warc.page_of(F.col("metadata"))).collect()
    page = {c.record_id: c.page_id for c in caps}
    assert len(page) == len(case)
    first = {}
    for p, _, html in case:
        raw = (html or "").encode()
        if len(raw) >= 100:
            first[raw] = min([x for x in (first.get(raw), p) if x is not None], default=None)
    want = []
    for p, _, html in case:
        raw = (html or "").encode()
        again = len(raw) >= 100 and p != first[raw]
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    got = [(c.page_id, c.payload_bytes, c.payload_digest, c.type, page[c.refers_to] if c.refers_to else None) for c in caps]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(len(c.requests) == len(c.metadata) == 1 for c in caps)
    assert all((c.response.block == b"") for c in caps if c.type == "revisit")


def test_warc_of_nothing_and_of_missing_records(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], PAGE), path)
    assert warc.captures(warc.read_records(spark, path)).count() == 0
    lone = "WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <a>\r\nWARC-Refers-To: <gone>\r\nWARC-Payload-Digest: sha256:ab\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    info = "WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "own").mkdir()
    raw = gzip.compress(info.encode()) + gzip.compress(lone.encode())
    (tmp_path / "own" / "x.warc.gz").write_bytes(raw)
    row = warc.captures(warc.read_records(spark, str(tmp_path / "own"))).first()
    assert (row.payload_bytes, row.payload_digest, row.requests) == (None, "ab", None)
    with pytest.raises(ValueError):
        list(warc.parse_records(info.encode()[:-8]))


VEC = "vec_id long, embedding array<float>, rank int"


def exact_nearest(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest_finds_most_and_ranks_exactly(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(16) * rng.choice([0.2, 1, 3])).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]
    rows += [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5020, [None] * 16), (5005, []), (None, [1.0] * 16), (5040, [1.0, 2.0]), (5041, [2.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VEC)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact_nearest(rows, 20)
    assert set(got) == {q for q in want if want[q]}
    found = sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in got) / sum(len(w) for w in want.values())
    assert found >= 0.9
    vec = dict(rows)
    for q, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        scores = [float((np.array(vec[q], np.float64) * np.array(vec[i], np.float64)).sum()) for _, i, _ in hits]
        assert np.allclose(scores, [s for *_, s in hits], rtol=1e-12)
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
    assert got[5040] == [(1, 5041, 3.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def nearest_cases():
    rng = np.random.default_rng(11)
    few = rng.standard_normal((6, 16))
    middle = rng.standard_normal((400, 16))
    longest = rng.standard_normal((3, 16)) * [[1e5], [2e5], [3e5]]
    lonely = 6 * rng.standard_normal((4, 16)).repeat(5, axis=0) + 1e-3 * rng.standard_normal((20, 16))
    return {"few and opposite": np.vstack((few, -few)), "a few far longer": np.vstack((middle, longest)), "small groups apart": np.vstack((lonely, 3 + 0.1 * middle))}


@pytest.mark.parametrize("name", list(nearest_cases()))
def test_every_query_is_filled(spark, name):
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(nearest_cases()[name])]
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], VEC), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact_nearest(rows, 20)
    assert {q: len(h) for q, h in got.items()} == {q: min(20, len(rows) - 1) for q in want}
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(len(w) for w in want.values())


def test_ties_of_equal_vectors_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(100)] + [(200, [1.0, 1.0], 0), (200, [1.0, 1.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, VEC), F.col("vec_id") % 100 == 0, k=5)
    hits = {}
    for r in got.orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append(r.vec_id)
    assert hits == {0: [1, 2, 3, 4, 5], 200: [0, 1, 2, 3, 4]}


def test_long_pages_get_parts_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BATCH_BYTES", 1 << 20)
    sizes = [10, 70_000, 70_000, 1_500_000, 20_000_000, 20_000_001] + [200] * 40
    pages = spark.createDataFrame([(i, f"http://p/{i}", chr(97 + i % 26) * n, "") for i, n in enumerate(sizes)], PAGE).coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 5  # one each of the three lower sizes, two of the highest
    found = warc.captures(warc.read_records(spark, str(tmp_path / "w"))).select("payload_bytes", warc.page_of(F.col("metadata")).alias("page")).collect()
    assert {r.page: r.payload_bytes for r in found} == dict(enumerate(sizes))
    slim = warc.captures(warc.without_payloads(warc.read_records(spark, str(tmp_path / "w"))), with_payload=False)
    assert sorted(r.payload_bytes for r in slim.collect()) == sorted(sizes)


def toxic_case(n=900, seed=2):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(300)]
    texts, labels = {}, []
    for i in range(n):
        bad = i % 4 == 0
        lines = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 12))) + "." for _ in range(rnd.randrange(2, 30))]
        if bad:
            lines[rnd.randrange(len(lines))] += f" you zork{rnd.choice(['s', 'ed', 'ing', ''])} {rnd.choice(['Nasty', 'vile'])} zorker."
        texts[i] = "\n".join(lines)
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity_learns_and_locates(spark):
    texts, labels = toxic_case()
    texts |= {5000: None, 5001: "", 5002: "clean words " * 40_000, None: "no id"}
    lab = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, 1), (5001, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge_documents(docs_of(spark, texts), lab).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in rows if r.held_out and r.doc_id in range(900)]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score == 0 and by[5002].predicted == 0
    for r in rows:
        if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 0 and r.predicted:
            spots = [texts[r.doc_id][s.start : s.start + s.length] for s in r.offending]
            assert any("zork" in s for s in spots)


def test_long_clean_documents_teach_and_stay(spark):
    texts, labels = toxic_case()
    rnd = random.Random(4)
    for i in range(1000, 1090):
        # As long as none of the others, and with words that only toxic ones have among those.
        lines = [texts[1 + 4 * rnd.randrange(200)].splitlines()[0] for _ in range(40)]
        texts[i] = "\n".join([*lines, *["In that chapter a nasty zorker speaks."] * 3, *["quiet words follow here."] * 1400])
        labels.append((i, 1, 0))
    assert min(len(texts[i]) for i in range(1000, 1090)) > 32_768
    schema = "doc_id long, quality int, toxic int"
    rows = toxicity.judge_documents(docs_of(spark, texts), spark.createDataFrame(labels, schema)).collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted for r in held if r.doc_id >= 1000) == 0 and sum(r.doc_id >= 1000 for r in held) > 10
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held if r.doc_id < 1000) / sum(r.doc_id < 1000 for r in held) > 0.97


def test_scores_are_the_noisy_or_of_sentences(spark):
    """Each score against sentences scored one by one with plain Python."""
    texts, labels = toxic_case(300)
    df, known = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, known)
    assert len(model.weights) > 0
    for r in toxicity.score_documents(df, model, ["doc_id"]).collect():
        none = 1.0
        low = (texts[r.doc_id] or "").lower()
        for a, n in toxicity.sentences(low):
            features = [f for w in set(toxicity.WORD.findall(low[a : a + n])) for f in toxicity.word_features(w)]
            none *= 1 - 1 / (1 + np.exp(-model.base - sum(model.weights.get(f, 0.0) for f in features)))
        assert r.score == pytest.approx(1 - none, abs=1e-9)


def test_sample_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    texts, labels = toxic_case(300)
    df = docs_of(spark, texts).union(docs_of(spark, {4: "another text of four", 8: "and of eight"}))
    df = df.union(df)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one, many = (sorted(map(tuple, toxicity.training_rows(df.repartition(n), known).collect())) for n in (1, 11))
    assert one == many and 0 < len(one) <= 80


def test_toxicity_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs_of(spark, ["a", None]).withColumnRenamed("lang", "score").withColumnRenamed("source", "row")
    kept = toxicity.drop_toxic(df, none)
    assert kept.columns == df.columns and kept.count() == 2
    assert toxicity.judge_documents(df.limit(0), none).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark):
    texts, labels = toxic_case(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    df = docs_of(spark, texts)
    a, b = (sorted(map(tuple, toxicity.training_rows(df, spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b and len(a) > 100
