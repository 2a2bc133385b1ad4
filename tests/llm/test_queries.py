"""The registered queries without SQL, over whole given tables, against plain Python."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import components, crc, docs_of, fingerprint, repeats

from trackspark.llm import model_queries, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables not present")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"], strict=True)))


def ids_of(name, texts, end):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path(name)
    tok = tokenizers.Tokenizer.from_file(path)
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts.items()}


def test_op2_sizes_digests_and_slots(spark, texts):
    rows = queries.op2_sharding(spark, DIR).collect()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(b) + 1, zlib.crc32(b)) for i, b in raw.items()}
    assert len(rows) == len(raw) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5_every_id_lies_in_one_piece(spark, texts):
    ids = ids_of("word_bpe_49k.json", texts, 1)
    pieces, sequences = {}, {}
    for r in queries.op5_packing(spark, DIR).collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in [(p, len(ids[i])) for i, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= 2048
    assert set(pieces) == set(ids)
    assert len(sequences) <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_op7_fingerprints_and_components(spark, texts):
    order = list(texts)
    prints = [fingerprint(texts[i]) for i in order]
    want = {(i, f"{p:016x}", order[c]) for i, p, c in zip(order, prints, components(prints), strict=True)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, DIR).collect()} == want


def test_op9_ids_come_back(spark, texts):
    want, start = set(), 0
    for i, doc in ids_of("byte_bpe_50k.json", texts, 0).items():
        want.add((i, start, len(doc), crc(doc)))
        start += len(doc)
    got = queries.op9_token_store(spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_op10_removes_what_repeats(spark, texts):
    got = queries.op10_suffix_dedup(spark, DIR).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == [(i, *r) for i, r in zip(texts, repeats(texts.values()), strict=True)]


@pytest.mark.parametrize("size, removed", [(399, 0), (400, 400)])
def test_op10_counts_bytes_not_words(spark, tmp_path, size, removed):
    passage = " ".join(f"word{k}" for k in range(70))[: size - 1] + "."
    assert len(passage) == size and len(passage.split()) > 50
    docs_of(spark, [f"a{passage}b", f"c{passage}d", "other text " * 3]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(size + 2, removed), (size + 2, removed), (33, 0)]


def test_op13_against_numpy(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    kept = {i: v for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v is not None and None not in v and np.isfinite(v).all()}
    x = np.floor(256 * np.array(list(kept.values()), float)).astype(int)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - total / n) @ vectors[:, :4] / np.sqrt(values[:4])
    place = {i: k for k, i in enumerate(kept)}
    rows = model_queries.op13_whitening(spark, DIR).collect()
    assert len(rows) == 4 * len(kept)
    sign = {r.component: np.sign(r.whitened * white[place[r.vec_id], r.component - 1]) for r in rows if abs(white[place[r.vec_id], r.component - 1]) > 0.5}
    for r in rows:
        k, c = place[r.vec_id], r.component - 1
        assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * x[k] - total)
        assert r.whitened * sign[r.component] == pytest.approx(white[k, c], abs=1e-6)
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-6) and r.identity_error < 1e-4


def test_op3_finds_nine_tenths_with_exact_scores(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    kept = {i: np.array(v, float) for i, v in zip(t["vec_id"], t["embedding"], strict=True) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids, x = np.array(list(kept)), np.array(list(kept.values()))
    found = {}
    for r in queries.op3_nearest(spark, DIR).collect():
        assert r.score == pytest.approx(float(kept[r.query_id] @ kept[r.vec_id]), rel=1e-12, abs=1e-12)
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in kept if i % 20 == 0}
    hits = 0
    for q, answer in found.items():
        answer.sort()
        assert [a[0] for a in answer] == list(range(1, 21)) and len({a[1] for a in answer} - {q}) == 20
        assert [(-a[2], a[1]) for a in answer] == sorted((-a[2], a[1]) for a in answer)
        best = sorted((-s, i) for s, i in zip(x @ kept[q], ids, strict=True) if i != q)[:20]
        hits += len({i for _, i in best} & {a[1] for a in answer})
    assert hits >= 0.9 * 20 * len(found)


def test_op11_base_spans_are_the_patterns(spark, texts):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", assign, 6, 1), ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0), ("hex", re.compile(r"[0-9a-f]+"), 24, 0)]
    want = set()
    for i, text in texts.items():
        spans = []
        for k, (_, pattern, least, group) in enumerate(kinds):
            spans += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        listed = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        want.add((i, *counts, hashlib.sha256(listed.encode()).hexdigest()))
    rows = model_queries.op11_secret_scan(spark, DIR).collect()
    assert {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == want and len(rows) == len(texts)
    for r in rows:
        assert len(r.spans.split(",")) >= r.n_assign + r.n_access + r.n_hex or not r.spans
