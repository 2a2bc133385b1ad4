"""Decontamination and URL rules against brute force."""

import random

from helpers import DOC, docs_of, leaks

from trackspark.llm import decontaminate, url_filter

ITEMS = "item_id long, text string"


def leak_case(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "É", "naïve"]

    def noise(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))

    items = [(1, noise(30)), (2, noise(10)), (3, noise(12)), (4, "Rare words"), (5, ""), (6, None), (None, noise(11)), (2, noise(14)), (7, "unique"), (8, "the " * 30)]
    texts = [None, "", "...", "unique", "UNIQUE!", "uniquely", "rare, WORDS; rare-words", "rare", "the " * 12]
    for _ in range(40):
        _, item = rnd.choice([x for x in items if x[1]])
        w = item.split()
        a = rnd.randrange(len(w))
        texts.append(noise(rnd.randrange(30)) + " " + " ".join(w[a : a + rnd.randrange(1, 25)]).upper() + "\n" + noise(rnd.randrange(30)))
    texts.append(noise(30_000) + " " + items[0][1])
    return texts, items


def test_leaks_match_brute_force(spark):
    for seed in (1, 2):
        texts, items = leak_case(seed)
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
        assert got == dict(enumerate(leaks(texts, items)))


def test_many_passes_agree(spark, tmp_path, monkeypatch):
    texts, items = leak_case(3)
    monkeypatch.setattr(decontaminate, "SHINGLES_PER_PASS", 20)
    docs_of(spark, texts).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == dict(enumerate(leaks(texts, items)))


def test_drop_contaminated(spark):
    texts, items = leak_case(4)
    df = docs_of(spark, texts).withColumnRenamed("lang", "uid").withColumnRenamed("source", "h")
    bad = spark.createDataFrame(items, ITEMS)
    got = decontaminate.drop_contaminated(df.union(df), bad)
    clean = [i for i, x in enumerate(leaks(texts, items)) if not x[4]]
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(clean * 2)
    assert decontaminate.drop_contaminated(df, bad.limit(0)).count() == len(texts)
    assert decontaminate.contamination(spark.createDataFrame([], DOC), bad).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("co.uk", "", "block"), ("uk", "/abc", "allow"), ("com", "/", "block")]


def judged(url, rules=RULES):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules[:6] if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_match_brute_force(spark):
    rnd = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com", "http://example.com/en/", "x://WWW.Example.com/en/a?b#c", "http://example.com?/en/", "http://com/", "a://b://c.com/", "http://.com/", "http://com./x", "http://ÉX.com/", "http://a.co.uk", "http://co.uk/abc", "http://uk/abcd", "http://a\nb.com/en/"]
    urls += ["".join(rnd.choice(["http://", "www.", "example", ".com", ".net", "/en/", "/es/", "?", "#", "A", "co.uk", "/abc"]) for _ in range(6)) for _ in range(800)]
    urls.append("http://" + "a." * 3000 + "com/" + "en/" * 3000)
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    got = [tuple(r) for r in url_filter.judge_urls(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got, key=str) == sorted(((i, *judged(u)) for i, u in enumerate(urls) for _ in range(2)), key=str)
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, []).collect()} == {"allow"}


def test_equal_digests_are_told_apart_by_the_string(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(url_filter, "_digests", lambda strings: np.fromiter((len(s) for s in strings), np.uint64))
    path = str(tmp_path / "rules")
    url_filter.compile_rules([("aa", "/x", "block"), ("bb", "/y", "block")], path)
    hosts, paths, rules, verdicts = url_filter.judge(url_filter.open_rules(path), ["h://aa/x", "h://bb/x", "h://cc/y", "h://bb/y"])
    assert rules == ["aa/x", None, None, "bb/y"] and verdicts == ["block", "allow", "allow", "block"]
