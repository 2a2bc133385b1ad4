"""Benchmark decontamination by a prefix-filtered join of word windows.

An item's windows are sets of shingles. A window occurs only where all its shingles
do, so of its shingles ordered by rarity in the corpus a prefix of one is enough to
find it: the rarest. One pass over the documents finds every place of every
benchmark shingle; these places give the corpus counts, then the places of the rarest
shingles meet their windows, within bounds on length and position, and the words of
the whole window are compared. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, discard, fresh_name, keyed

#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW, SHINGLE = 10, 5
#: Benchmark shingles sent to every executor at once (a long and two ints each); more are met in further passes.
SHINGLES_PER_PASS = 1_000_000
#: Stands for the document itself behind its last shingle.
WHOLE = 0


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def _shingles(words: Column, size: int) -> Column:
    """Digests of the runs of ``size`` words, in order."""
    last = F.size(words) - size
    made = F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(words, i, size))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(w, words, len, k) of each distinct window, and (w, item) of the items that have it; both stored."""
    split = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - length))
    cut = split.select("item", "words", length.alias("len"), at.alias("at")).select("item", F.slice("words", F.col("at") + 1, F.col("len")).alias("words"))
    found = cut.distinct()
    ids = cut_lineage(found.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    owners = cut_lineage(found.join(ids, "words").select("w", "item"), "window-items")
    return ids.select("w", "words", F.size("words").alias("len"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k")), owners


def _places(docs: DataFrame, uid: str, keep: list[str], text: str, shingles: DataFrame, sizes: list[int], window: int, with_whole: bool) -> DataFrame:
    """A row for each place of a benchmark shingle, and, if asked for, one row with h null for each document.

    ``near`` holds the words around the place, enough for any window over it, and
    ``base`` the position of the first of them.
    """
    whole = F.array(F.lit(WHOLE).cast("long")) if with_whole else F.array().cast("array<bigint>")

    def split(w: Column) -> Column:
        return F.struct(w.alias("words"), F.size(w).alias("n_words"), F.concat(*[_shingles(w, k) for k in sizes], whole).alias("hashes"))

    # As the variable of a lambda the words are split off once, not anew for each shingle.
    hashed = docs.select(uid, *keep, F.inline(F.transform(F.array(words_of(F.col(text))), split)))
    each = hashed.select(uid, *keep, "words", "n_words", F.posexplode("hashes").alias("at", "digest"))
    # The lists lie one behind the other: where each of them begins follows from the number of words.
    begins, start = {}, F.lit(0)
    for k in sizes:
        begins[k] = start
        start = start + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    end = start
    spark = docs.sparkSession
    wanted = shingles.select("h", "k")
    if with_whole:
        wanted = wanted.union(spark.range(1).select(F.lit(WHOLE).cast("long"), F.lit(0)))
    met = each.join(F.broadcast(wanted), F.col("digest") == F.col("h"))
    pos = reduce(lambda acc, k: F.when(F.col("k") == k, F.col("at") - begins[k]).otherwise(acc), sizes, F.lit(0))
    is_whole = (F.col("k") == 0) & (F.col("at") == end)
    placed = met.select(uid, *keep, "n_words", "words", "k", pos.alias("pos"), F.when(~is_whole, F.col("h")).alias("h"))
    placed = placed.filter("h IS NULL OR k > 0").withColumn("base", F.greatest(F.col("pos") - (window - F.col("k")), F.lit(0)))
    near = F.slice("words", F.col("base") + 1, F.lit(2 * window) - F.col("k"))
    return placed.select(uid, *keep, "n_words", "h", "k", "pos", "base", F.when(F.col("h").isNotNull(), near).alias("near"))


def window_hits(docs: DataFrame, items: DataFrame, uid: str, keep: list[str], text: str, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, keep..., n_words) of all documents, (uid, start, len, w) of all occurrences, and (w, item).

    ``uid`` must tell rows apart and be the same each time ``docs`` is read, once for each million benchmark shingles.
    """
    windows, owners = item_windows(items, item_id, item_text, window)
    # A row for each shingle of each window.
    inside = windows.select("w", "words", "len", "k", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("offset"))
    sizes = list(range(1, SHINGLE + 1))
    digest = reduce(lambda acc, k: F.when(F.col("k") == k, _shingle(F.col("words"), F.col("offset"), k)).otherwise(acc), sizes, F.lit(None).cast("long"))
    tokens = cut_lineage(inside.select("w", "k", "offset", digest.alias("h")), "window-shingles")
    shingles = tokens.select("h", "k").distinct()
    n = shingles.count()
    used = [r.k for r in tokens.select("k").distinct().orderBy("k").collect()]  # at most SHINGLE rows
    parts = max(1, -(-n // SHINGLES_PER_PASS))
    passes = [
        _places(docs, uid, keep, text, shingles.filter(F.pmod("h", F.lit(parts)) == p), used, window, p == 0) for p in range(parts)
    ]
    places = cut_lineage(reduce(DataFrame.union, passes), "places")
    all_docs = places.filter("h IS NULL").select(uid, *keep, "n_words")
    real = places.filter("h IS NOT NULL")
    # Rarity over the whole corpus; a window with a shingle that occurs nowhere occurs nowhere.
    counts = real.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(counts, "h", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("rarest"))
    prefix = ranked.filter("rarest.n > 0").select("w", F.col("rarest.h").alias("p_h"), F.col("rarest.offset").alias("offset"))
    probes = cut_lineage(prefix.join(windows.select("w", "words", "len"), "w"), "prefixes")
    begin = F.col("pos") - F.col("offset")
    bounds = (begin >= 0) & (begin + F.col("len") <= F.col("n_words"))
    same = F.slice("near", begin - F.col("base") + 1, F.col("len")) == F.col("words")
    hits = real.join(probes, (F.col("h") == F.col("p_h")) & bounds & same).select(uid, begin.alias("start"), "len", "w")
    return all_docs, hits, owners


def _covered(hits: DataFrame, uid: str) -> DataFrame:
    """(uid, n_hit): words inside any occurrence."""
    earlier = f"max(start + len) OVER (PARTITION BY `{uid}` ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest(F.col("start"), F.coalesce("earlier", F.lit(0))))
    return hits.withColumn("earlier", F.expr(earlier)).groupBy(uid).agg(F.sum(fresh).cast("long").alias("n_hit"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    from_files: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. Null texts have no words: such documents are clean, such items
    match nothing. Items of one id count once, a null id as an item with an empty name.
    Repeated rows each give a row; other columns are not read; an empty table gives no
    rows, an empty benchmark leaves all clean. A text needs a few times its bytes in a task.
    ``from_files``: ``docs`` is a table of Parquet files as Spark reads it, whose rows need no number of their own.
    """
    rows, uid = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), from_files)
    stored = rows.withColumnRenamed(uid, "uid")
    all_docs, hits, owners = window_hits(stored, items, "uid", ["doc_id"], "text", item_id, item_text, window)
    hits = cut_lineage(hits, "hits")
    named = hits.select("uid", "w").distinct().join(owners, "w").select("uid", "item").distinct()
    listed = named.groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    full = all_docs.join(_covered(hits, "uid"), "uid", "left").join(listed, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return full.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, from_files: bool = False
) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns.

    ``from_files``: ``docs`` is a table of Parquet files as Spark reads it, whose rows need no number of their own.
    """
    rows, uid = keyed(docs, from_files)
    plain = rows.select(F.col(uid).alias("uid"), F.col(text).alias("text"))
    all_docs, hits, _ = window_hits(plain, items, "uid", [], "text", item_id, item_text, window)
    bad = fresh_name(rows, "bad")
    hit = cut_lineage(hits.select(F.col("uid").alias(bad)).distinct(), "leaks")
    discard(all_docs)
    return rows.join(hit, rows[uid] == hit[bad], "left_anti").drop(uid)
