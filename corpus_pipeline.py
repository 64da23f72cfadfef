"""From raw documents to packed training windows, in four stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import common, packing, quality_classifier, quality_rules, simhash, tokens


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learnt from the labels, doesn't reject."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.filter_documents(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return quality_rules.filter_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of their five-word shingles alike): that of the least doc_id."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in windows of 1024 tokens."""
    return packing.pack_documents(docs, tokens.public_path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("simhash_dedup", deduplicate), ("packing", pack)]

#: SQL can't express the classifier, min-hashes or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs, name)
    return docs
