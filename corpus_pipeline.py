"""A training-corpus pipeline: each stage takes what its predecessor kept, written as Parquet and read
again, and all but the last return the columns of `documents`.

A row without text or without a letter is rejected by the first stage. Of documents whose SimHash
fingerprints are linked the first stays. Paragraphs, and passages of 50 words or more inside lines or
across them, that repeat one of another document are cut out; the document stays, also if nothing of it is left. Documents that hold a benchmark item go. The last
stage encodes what is left and decodes it again. Empty tables pass through all stages.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import language, latent_leaks, paragraph_bands, simhash, transducer
from tapeloom.llm.common import documents
from tapeloom.session import stage

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paragraph_bands.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent_leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = transducer.round_trip(docs, public_tokenizers.path(TOKENIZER))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "text")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]

#: Classifiers, components and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
