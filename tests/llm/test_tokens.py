"""Token ids, packing and token files against the tokenizers library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOC, crc, docs_of

from trackspark.llm import packing, token_store
from trackspark.llm.tokens import Encoder, encoder

P = pytest.importorskip("public_tokenizers")
VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [None, "", " ", "\n", "<|endoftext|> a<|endoftext|>b", "don't, I'll. we'd", "ΣΑΣ. ΟΔΟΣ\nΣ", "\x1c a\x1cb", ". a", ", b", "a\0b", "İ. İx", "é. é x", "日本 語。", "3.14, 2,5", "a  b\n\nc "]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    letters = "ab Zé.,\n'  t1ñ_- ́“İ"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(n)]


def ids_of(name, text, end):
    return encoder(P.path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_pieces_give_the_ids_of_the_whole(name, monkeypatch):
    from trackspark.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    enc = Encoder(P.path(name))
    texts = odd_texts(3000)
    plain = ["Sentence one, two. " * k + "end\nnext" for k in range(60)]
    for part in (texts, plain, [t for t in texts if t and t.isalpha()], [None], [""]):
        got = enc.encode(pa.array(part, pa.string()))
        want = enc.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [g.tolist() for g in got] == [w.ids for w in want]
    assert enc.encode(pa.array([], pa.string())) == []


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(1)
    for _ in range(200):
        capacity = rnd.choice([5, 16, 31, 64])
        lengths = sorted((rnd.randint(1, capacity) for _ in range(rnd.randrange(90))), reverse=True)
        rooms = []
        for n, at in zip(lengths, packing.best_fit(lengths, capacity)[1], strict=True):
            fits = [r for r in rooms if r >= n]
            room = min(fits, default=capacity)
            if fits:
                rooms.remove(room)
            assert at == capacity - room
            if room > n:
                rooms.append(room - n)


def test_pack_places_every_id_once(spark):
    texts = odd_texts(150) + ["word " * 5000, "x"]
    df = docs_of(spark, texts).union(docs_of(spark, {7: texts[7], None: "no id"})).withColumnRenamed("lang", "uid")
    packed = packing.pack(df, P.path("word_bpe_49k.json"), with_ids=True)
    rows = packed.collect()
    assert len([r for r in rows if r.doc_id == 7]) == 2 and any(r.doc_id is None for r in rows)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 2048
    for i, text in enumerate(texts):
        want = ids_of("word_bpe_49k.json", text, 1)
        got = sorted(by_doc[i], key=lambda r: r.start)[:: 2 if i == 7 else 1]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want
        assert all(r.doc_tokens == len(want) for r in got)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(by_seq) and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.pack(spark.createDataFrame([], DOC), P.path("word_bpe_49k.json")).count() == 0


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_DOCS", 16)
    texts = odd_texts(200) + ["long " * 30_000]
    df = docs_of(spark, texts).repartition(5).union(docs_of(spark, {3: "again", None: "no id"}))
    path = str(tmp_path / "tokens")
    token_store.write_tokens(df, path, P.path("byte_bpe_50k.json"))
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted([*range(len(texts)), 3])
    at = 0
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
        if r.doc_id not in (None, 3):
            assert ids == ids_of("byte_bpe_50k.json", texts[r.doc_id], 0)
    few = token_store.read_tokens(spark, path, doc_ids=[5, 3, 10**6]).collect()
    assert sorted(r.doc_id for r in few) == [3, 3, 5] and {r.start for r in few} <= {r.start for r in rows}
    token_store.write_tokens(spark.createDataFrame([], DOC), path, P.path("byte_bpe_50k.json"))
    assert token_store.read_tokens(spark, path).count() == 0
