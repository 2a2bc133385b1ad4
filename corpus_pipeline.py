"""From raw documents to packed token sequences.

Each stage reads the Parquet files that the one before it has written, so a lost executor
costs no more than the stage at hand. ``run`` deletes a stage's scratch tables when its
result is written, and that result when the next one is.

Every stage takes null and repeated ids, null, empty and very long texts, empty tables and further
columns: null ids are ids like any other, null texts count as empty and pass on as they are, and a text is held
whole (a few times its bytes) by one task at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from trackspark.llm.common import discard, table
from trackspark.session import scratch_path, scratch_scope

WINDOW = 2048
#: Bytes of a string that counts as repeated: shorter than passages of fifty words, longer than stock phrases.
REPEATED = 256


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; labels train the model."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs, from_files=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of long strings that occur more than once; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs, from_files=True, length=REPEATED)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), from_files=True)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), WINDOW, end=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("decontamination", reject_leaks),
    ("packing", pack_tokens),
]

#: Models, fingerprints and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``."""
    docs, made = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if made is not None:
            discard(made)
        docs = made = spark.read.schema(out.schema).parquet(path)
    return docs
