"""The text operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ann, decontaminate, model_queries, packing, sharding, simhash, suffix_dedup, token_store, toxicity, url_filter, warc
from .common import cut_lineage, discard, table

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHARDS = 16
WINDOW = 2048


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _op1_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
    cut AS (
        SELECT page_id,
               CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ),
    named AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut
    ),
    ranked AS (
        SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
               row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
        FROM named LEFT JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE k = 1
    """


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS, from_files=True)
    return placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), WINDOW, end=1)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), from_files=True)


def _words_sql(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({lowered}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _op6_sql() -> str:
    return f"""
    WITH docs AS (SELECT doc_id, {_words_sql("text")} AS words FROM documents),
    items AS (SELECT item_id, {_words_sql("text")} AS words FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS piece
        FROM (
            SELECT item_id, words, least(10, len(words)) AS size,
                   unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS pos
            FROM items WHERE len(words) > 0
        ) cut
    ),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (
        SELECT doc_id, size, pos, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS piece
        FROM (
            SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS pos
            FROM docs, sizes WHERE len(words) >= size
        ) cut
    ),
    hits AS (SELECT doc_id, p.size, pos, item_id FROM places p JOIN windows w ON p.size = w.size AND p.piece = w.piece),
    covered AS (
        SELECT doc_id, count(DISTINCT word) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS word FROM (SELECT DISTINCT doc_id, size, pos FROM hits) h) w
        GROUP BY doc_id
    ),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) h GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.without_payloads(warc.read_records(spark, path))
    found = warc.captures(records, with_payload=False)
    rows = found.select("record_id", warc.page_of(F.col("metadata")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
    stored = cut_lineage(rows, "captures")
    discard(records)
    first = stored.filter("record_type = 'response'").select(F.col("record_id").alias("r_id"), F.col("page_id").alias("r_page"))
    linked = stored.join(first, F.col("refers_to") == F.col("r_id"), "left")
    return linked.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("r_page").alias("refers_to"))


OP8_SQL = """
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM (
    SELECT page_id, html, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first_id
    FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) filled
) grouped
"""


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, _vocabulary("byte_bpe_50k.json"), end=0)
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"), from_files=True)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_nearest": op3_nearest,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_token_store": op9_token_store,
    "op10_suffix_dedup": op10_suffix_dedup,
    **model_queries.QUERIES,
}

ORACLES = {"op1_url_filter": _op1_sql(), "op6_decontaminate": _op6_sql(), "op8_warc": OP8_SQL, **model_queries.ORACLES}
