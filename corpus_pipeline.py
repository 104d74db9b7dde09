"""From raw documents to packed sequences: language ID, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.language import identify
from wayfold.llm.lines import drop_recurring
from wayfold.llm.minhash import near_duplicates
from wayfold.llm.mixing import mix_sources
from wayfold.llm.packing import pack
from wayfold.llm.scratch import Scratch, with_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which replaces the given one; null and letterless texts go."""
    found = identify(docs.select(*COLUMNS), list(COLUMNS)).where("lang_pred != 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur over classes of near copies; no document goes."""
    docs = docs.select(*COLUMNS)
    changed = drop_recurring(docs, keep=("lang", "source", "n_chars"))
    same = with_ids(docs, changed, keep=False)
    cut = changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return same.unionByName(cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", "n_chars")).select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    docs = docs.select(*COLUMNS)
    out = Scratch(spark, "stage").save(near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id"), "out")
    return with_ids(docs, out, keep=False).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample drawn by calibrated probabilities."""
    docs = docs.select(*COLUMNS)
    out = Scratch(spark, "stage").save(mix_sources(docs).where("not selected").select("doc_id"), "out")
    return with_ids(docs, out, keep=False).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens at most."""
    return pack(docs)


STAGES = [
    ("language", languages),
    ("lines", lines),
    ("near_duplicates", near_duplicates_out),
    ("mixture", mixture),
    ("packing", packed),
]

#: Hashed signatures, machines and tokenisers are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
