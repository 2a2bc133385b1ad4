"""Queries of the secret scan, the conversation repair and the whitening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, secrets, whitening
from .common import table

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: ~s["added"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in secrets.KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the checksum of conversation and turn: 0 drops a row, 1 empties its text,
    2 removes its sentence ends, 3 repeats it, 4 gives it to the user; nulls read as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hit = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit")).filter("hit <> 0")
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = conversation_repair.repair_report(damaged(conversations)).withColumnRenamed("conv_id", "id")
    every = conversations.select("conv_id").distinct()
    return every.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _op12_sql() -> str:
    said, gone, u, ua, a = "[role || ':' || text]", "CAST([] AS VARCHAR[])", "['user:']", "['user:', 'assistant:']", "['assistant:']"
    stays = "(CASE WHEN fault = 't' THEN 3 ELSE 0 END)"

    def put(cost: str, edits: str, rows: str, rest: str) -> str:
        return "{'c': " + f"{rest}.c + {cost}, 'a': '{edits}' || {rest}.a, 'o': {rows} || {rest}.o" + "}"

    def ended(cost: int, edits: str, rows: str) -> str:
        return "{'c': " + f"CAST({cost} AS BIGINT), 'a': '{edits}', 'o': {rows}" + "}"

    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def deleted(rest: str) -> str:
        return put("4", "D", gone, rest)

    def kept(initial: str, rest: str) -> str:
        return f"CASE WHEN fault IN ('', 't') AND c = '{initial}' THEN {put(stays, 'K', said, rest)} END"

    def given(role: str, rest: str) -> str:
        return f"CASE WHEN fault IN ('', 't') THEN {put('3 + ' + stays, 'R', f'''['{role}:' || text]''', rest)} END"

    return f"""
    WITH RECURSIVE tab AS (
        SELECT list(v ORDER BY b) AS steps
        FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR k IN range(8)]),
                     lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS v FROM range(256) r(b)) t
    ),
    keyed AS (
        SELECT *, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                 lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
        FROM conversations
    ),
    hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS h
        FROM keyed, tab
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE h <> 0
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
               left(role, 1) AS c, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
        FROM damaged
    ),
    faulty AS (
        SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
               lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM ordered
    ),
    found AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM faulty GROUP BY conv_id
    ),
    repaired AS (
        SELECT conv_id, n AS i, {ended(0, "", gone)} AS s0, {ended(6, "II", ua)} AS s1, {ended(3, "I", a)} AS s2, {ended(0, "", gone)} AS s3
        FROM found
        UNION ALL
        SELECT conv_id, i - 1, {best("t0", put("3", "I", u, "t2"), put("6", "II", ua, "t3"))}, {best("t1", put("3", "I", u, "t2"), put("6", "II", ua, "t3"))},
               {best("t2", put("3", "I", a, "t3"))}, {best("t3", put("3", "I", u, "t2"))}
        FROM (
            SELECT p.conv_id, p.i,
                   {best(deleted("s0"), kept("s", "s1"), kept("u", "s2"), given("user", "s2"))} AS t0,
                   {best(deleted("s1"), kept("u", "s2"), given("user", "s2"))} AS t1,
                   {best(deleted("s2"), kept("a", "s3"), given("assistant", "s3"))} AS t2,
                   {best(deleted("s3"), kept("u", "s2"), given("user", "s2"))} AS t3
            FROM repaired p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i
        ) step
    )
    SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit,
           sha256(coalesce(array_to_string(s0.o, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k
    LEFT JOIN found f ON k.conv_id IS NOT DISTINCT FROM f.conv_id
    LEFT JOIN repaired r ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = 0
    """


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, scale=256)
    # The exact sum is a decimal; beyond 64 bits the column is null.
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {"op11_secret_scan": op11_secret_scan, "op12_conversation_repair": op12_conversation_repair, "op13_whitening": op13_whitening}
ORACLES = {"op12_conversation_repair": _op12_sql()}
