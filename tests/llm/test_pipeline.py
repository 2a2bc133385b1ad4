"""The corpus pipeline against its stages in plain Python, and the registered queries on a small table."""

import os
import random

import numpy as np
import pytest
from helpers import components, docs_of, fingerprint, leaks, repeats

import __spark_entry__ as entry
from trackspark.session import shared_dir

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(400)]

    def noise(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    item, passage = noise(25), noise(120)
    texts, toxic = {}, {}
    for i in range(240):
        toxic[i] = i % 5 == 0
        texts[i] = ". ".join(noise(rnd.randrange(4, 9)) + (" zorker nasty zork" if toxic[i] and k == 1 else "") for k in range(rnd.randrange(3, 9))) + "."
    for i, extra in enumerate(["", None, noise(40) + " " + item + " " + noise(5), noise(30) + passage + noise(20), noise(10) + passage, noise(3000)]):
        texts[300 + i] = extra
    for i in range(6):
        texts[400 + i] = texts[1 + 2 * i]  # copies, one of them of a toxic document
    return texts, toxic, [(1, item), (2, noise(8))]


def write_tables(spark, folder):
    texts, toxic, items = corpus()
    docs_of(spark, texts).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, items


def test_stages_match_plain_python(spark, tmp_path):
    texts, toxic, items = write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean, bad = seen["toxicity"], {texts[i] for i in toxic if toxic[i]}
    assert sum(toxic.get(i, False) for i in clean) <= 2 and set(clean) >= {i for i in texts if texts[i] not in bad}
    ids = sorted(clean)
    groups = components([fingerprint(clean[i].text) for i in ids])
    kept = seen["near_duplicates"]
    assert sorted(kept) == [ids[i] for i, g in enumerate(groups) if i == g]
    want = repeats([kept[i].text for i in sorted(kept)], pipeline.REPEATED)
    cut = seen["repeats"]
    assert sorted(cut) == sorted(kept)
    for i, (n, removed, _, _) in zip(sorted(kept), want, strict=True):
        assert len((cut[i].text or "").encode()) == n - removed and cut[i].n_chars == (None if cut[i].text is None else len(cut[i].text))
    leaked = leaks([cut[i].text for i in sorted(cut)], items)
    assert sorted(seen["decontamination"]) == [i for i, b in zip(sorted(cut), leaked, strict=True) if not b[4]]
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])
    assert all(np.isfinite(r.sequence_id) and r.length <= 2048 for r in packed)


def test_long_clean_documents_pass_the_first_stage(spark, tmp_path):
    texts, _, _ = write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in pipeline.STAGES[0][1](spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert 305 in kept


def test_run_leaves_only_its_result(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    out = pipeline.run(spark, str(tmp_path))
    left = {d for d in set(os.listdir(folder)) - before if any(f.endswith(".parquet") for _, _, names in os.walk(f"{folder}/{d}") for f in names)}
    assert len(left) == 1 and out.count() > 0


def test_run_takes_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, and columns with names of the operators' own."""
    texts, _, _ = write_tables(spark, str(tmp_path))
    extra = [(None, "free text without an id. " * 3, "x"), (None, None, None), (3, "another text with id three", "y"), (3, "another text with id three", "y")]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "1L AS n_chars")
    folder = f"{tmp_path}/wide"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    wide = docs.union(more).selectExpr("*", "doc_id AS uid", "1 AS row", "2 AS score", "3 AS marked", "4 AS bad", "5 AS kept", "6 AS u1", "'a' AS `a b`")
    wide.write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        out = stage(spark, now, folder)
        assert out.columns == wide.columns
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
    packed = pipeline.run(spark, folder).collect()
    assert None in {r.doc_id for r in packed} and sum(r.doc_id == 3 for r in packed) == 2


def test_stages_take_empty_tables(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/none")
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/none"), str(tmp_path)).count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert {"op1_url_filter", "op6_decontaminate", "op8_warc"} <= set(entry.oracle_sql())
