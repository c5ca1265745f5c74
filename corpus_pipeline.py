"""A training corpus from documents: language, near duplicates, benchmark passages, mix, token ids."""

from __future__ import annotations

from leafmill.llm import common, decontaminate, language_id, mixing, simhash_dedup, token_output
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of words' ids that a worker remembers: other stages' workers stand beside it.
CACHE_BYTES = 96 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier names and does not reject; it learns from the labelled ones."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return language_id.identify(rows, language_id.fit(docs)).where("not lang_rejected").select("row.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links join, the one with the smallest id, null last, then the smallest digest of its text.

    Rows are told apart by their whole content: distinct texts under one id, or under none, each stay unless a link
    joins them; of rows that repeat every column, one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), F.xxhash64(*docs.columns).alias("rest"))
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    classes = simhash_dedup.near_duplicates(rows.select("key", "row.text"), "key")
    stay = classes.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("stays")).distinct()
    once = rows.dropDuplicates(["key"])
    return once.join(stay, once["key"].eqNullSafe(stay["stays"]), "left_semi").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: none, once or twice."""
    return mixing.mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the token files, read back from them."""
    path = common.new_path(spark, "tokens")
    token_output.write_tokens(docs, path, cache_bytes=CACHE_BYTES)
    return token_output.documents_of(spark, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_class),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("token_output", token_ids),
]

#: Models, sketches and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.write_out(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
