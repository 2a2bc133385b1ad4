"""URL rules behind a sorted array of digests.

The rules are compiled into one file: sorted 64-bit keys of the rule hosts and of the
whole rules, and the stored strings. Each executor maps its copy into memory; a batch
of urls is probed with vectorised binary search, and every hit is confirmed against
the stored string, so that a digest collision changes nothing.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, map_batches

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URL = re.compile(r"(.*?)://([^/?#]*)([^?#]*)", re.S)
DEFAULT = "allow"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    m = URL.match(url) if url else None
    return (m[2].translate(LOWER), m[3]) if m else ("", "")


def _digests(strings: Iterable[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64)


@dataclass
class RuleIndex:
    """Arrays of a compiled file.

    hosts: sorted digests of rule hosts, host_at: where each host's rules begin.
    lengths: path lengths of the rules of a host, without repeats. keys: sorted digests
    of host and path. Strings lie in ``blob`` at ``at``.
    """

    hosts: np.ndarray
    host_at: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray
    blocks: np.ndarray
    at: np.ndarray
    path_at: np.ndarray
    blob: np.ndarray

    FIELDS = ("hosts", "host_at", "lengths", "keys", "blocks", "at", "path_at", "blob")

    def rule(self, i: int) -> tuple[str, str]:
        """(host, path) as stored."""
        a, m, b = int(self.at[i]), int(self.path_at[i]), int(self.at[i + 1])
        return bytes(self.blob[a:m]).decode(), bytes(self.blob[m:b]).decode()

    def matches(self, host: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``digests`` and the positions in ``host`` (sorted, with repeats) that equal them."""
        lo, hi = np.searchsorted(host, digests, "left"), np.searchsorted(host, digests, "right")
        n = hi - lo
        rows = np.repeat(np.arange(len(digests)), n)
        return rows, np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(rows)) if len(rows) else rows


def compile_rules(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Write (host, path, verdict) rules to ``path``; hosts are lower-cased, of repeated rules the first counts."""
    unique: dict[tuple[str, str], bool] = {}
    for host, prefix, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        unique.setdefault((host.translate(LOWER), prefix), verdict == "block")
    names = list(unique)
    keys = _digests(h + p for h, p in names)
    order = np.argsort(keys, kind="stable")
    names = [names[i] for i in order]
    raw = [(h.encode(), p.encode()) for h, p in names]
    ends = np.cumsum([0, *[len(h) + len(p) for h, p in raw]])
    by_host: dict[str, set[int]] = {}
    for h, p in names:
        by_host.setdefault(h, set()).add(len(p))
    hosts = sorted(by_host, key=lambda h: int(_digests([h])[0]))
    arrays = {
        "hosts": _digests(hosts),
        "host_at": np.cumsum([0, *[len(by_host[h]) for h in hosts]]).astype(np.int64),
        "lengths": np.array([n for h in hosts for n in sorted(by_host[h])], np.int64),
        "keys": keys[order],
        "blocks": np.array([unique[n] for n in names], np.uint8),
        "at": ends.astype(np.int64),
        "path_at": (ends[:-1] + [len(h) for h, _ in raw]).astype(np.int64),
        "blob": np.frombuffer(b"".join(h + p for h, p in raw), np.uint8),
    }
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8))
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))


_OPEN: dict[str, RuleIndex] = {}


def open_rules(path: str) -> RuleIndex:
    """The compiled file, mapped into memory once in a process."""
    if path not in _OPEN:
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        start = 8 + n + -n % 8
        arrays = {}
        for name, (kind, count, at) in head.items():
            arrays[name] = np.memmap(path, kind, "r", start + at, (count,)) if count else np.zeros(0, kind)
        _OPEN[path] = RuleIndex(**arrays)
    return _OPEN[path]


def judge(index: RuleIndex, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str]]:
    """Hosts, paths, rules (or None) and verdicts of a batch of urls."""
    parts = [split_url(u) for u in urls]
    # First the hosts: a url and each of its host's suffixes at a dot.
    row, suffix = [], []
    for i, (host, _) in enumerate(parts):
        at = 0
        while 0 <= at < len(host):
            row.append(i)
            suffix.append(host[at:])
            at = host.find(".", at) + 1 or -1
    asked, found = index.matches(index.hosts, _digests(suffix))
    # Then the rules: each path prefix of a length that the host has.
    row2, key2 = [], []
    for a, f in zip(asked.tolist(), found.tolist(), strict=True):
        i, host = row[a], suffix[a]
        path = parts[i][1]
        for n in index.lengths[index.host_at[f] : index.host_at[f + 1]].tolist():
            if n <= len(path):
                row2.append(i)
                key2.append((host, path[:n]))
    asked, found = index.matches(index.keys, _digests(h + p for h, p in key2))
    best: dict[int, tuple[int, int, int]] = {}
    for a, f in zip(asked.tolist(), found.tolist(), strict=True):
        if index.rule(f) == key2[a]:  # the stored string, not only its digest
            host, path = key2[a]
            rank = (len(host) + len(path), len(host), f)
            best[row2[a]] = max(best.get(row2[a], rank), rank)
    rules = ["".join(index.rule(best[i][2])) if i in best else None for i in range(len(urls))]
    verdicts = [("block" if index.blocks[best[i][2]] else "allow") if i in best else DEFAULT for i in range(len(urls))]
    return [h for h, _ in parts], [p for _, p in parts], rules, verdicts


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Compile the rules and have Spark copy the file to every executor, also to later ones; gives its name.

    The file is made where the driver runs and sent by Spark, as executors do not see
    the driver's folders.
    """
    name = f"rules-{uuid.uuid4().hex}"
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), name)
    compile_rules(rules, path)
    spark.sparkContext.addFile(path)
    return name


def judge_urls(urls: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """All columns of ``urls`` with host, path, rule and verdict; columns of these names are replaced.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule string wins, of equally long ones that with the longer host. Without a
    rule the verdict is allow: the array lists what is known, and nothing else is
    held back. Null urls and such without ``://`` have empty host and path and fit no
    rule; a rule with an empty host fits nothing. No shuffle; repeated rows each give
    a row, an empty table none.
    """
    name = ship_rules(urls.sparkSession, rules)
    body = urls.drop("host", "path", "rule", "verdict")
    asked = fresh_name(body, "asked_url")
    # Only the url goes to Python and back: the other columns are carried beside it.
    source = body.withColumn(asked, F.col(url))
    kinds = ", ".join(f"`{n}` {t}" for n, t in body.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = open_rules(SparkFiles.get(name))
        got = judge(index, batch.column(batch.num_columns - 1).to_pylist())
        kept = batch.columns[:-1]
        return pa.RecordBatch.from_arrays(
            [*kept, *(pa.array(c, pa.string()) for c in got)], [*batch.schema.names[:-1], "host", "path", "rule", "verdict"]
        )

    return map_batches(source, run, (kinds + ", " if kinds else "") + "host string, path string, rule string, verdict string")
