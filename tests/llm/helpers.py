"""Brute-force versions of the text operators, and awkward tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import xxhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, schema=DOC):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, schema)


def stored(spark, df, tmp_path, name="t"):
    """The frame as Parquet files, as the queries get it."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/{name}.parquet")


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, radius=3):
    """Smallest index reachable from each."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                covered[p : p + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    import re

    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def leaks(texts, items, window=10):
    """(n_words, n_hit, n_items, items_sha256, contaminated) of each text; items: (id, text)."""
    wanted = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for i in range(len(w) - n + 1):
                if (found := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
