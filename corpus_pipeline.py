"""From raw documents to token ids: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import decontamination, language_id, near_dedup, sentencepiece_codec, substring_dedup
from notewright.llm.common import dropped, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents of none (no letter, no text) go."""
    model = language_id.learned(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identified(docs.select(COLUMNS), model)
    if model is not None:
        found = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.when(F.col("lang_pred") == language_id.UNKNOWN, F.col("lang")).otherwise(F.col("lang_pred"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id, once. Rows without a doc_id or that share one are judged by their texts."""
    return near_dedup.survivors(docs.select(COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go from the texts that have some; a document of which nothing is left goes."""
    cut = substring_dedup.deduplicated(docs.select(COLUMNS), whole=True)
    out = cut.filter("n_words > n_removed or n_words = 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs.select(COLUMNS), bench)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids, ids."""
    rows = sentencepiece_codec.encoded(docs.select("doc_id", "lang", "source", "text"), sentencepiece_codec.model_bytes())
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
            if before is not None:
                dropped(before)
            before = docs
    return docs
