"""The corpus pipeline: stages over `documents`, each written and read again as the next one's input.

Language identification learns from the documents' own labels and drops those it rejects; near-duplicate
detection keeps the document with the smallest doc_id of each group; repeated passages are cut from the
rest; documents that hold a benchmark passage go; what remains is encoded to token ids and decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontam, language_id, line_dedup, minhash_forest
from sluice.llm._shared import materialise, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their labels teach; the rejected ones go."""
    model = language_id.train(docs.select("text", "lang"))
    return docs.where(~language_id.language(F.col("text"), model)["rejected"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five words a shingle and a similarity of 0.8."""
    return minhash_forest.without_near_duplicates(docs, n=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of MIN_WORDS words or more that an earlier document holds; n_chars follows the text."""
    return line_dedup.deduplicated(docs, line_dedup.MIN_WORDS).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL cannot express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; their scratch tables go, the last stage's stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep_last:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                docs = keep(materialise(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        keep_last(docs)
    return docs
