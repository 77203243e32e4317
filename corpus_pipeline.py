"""Corpus pipeline: five stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of ``documents``; the last returns the places of the tokenised pieces.  The
stages call the operators of ``quasirisk.llm``, which state how NULL, empty and repeated rows
are treated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quasirisk.llm.decontaminate import drop_leaks
from quasirisk.llm.packing import pack_documents
from quasirisk.llm.quality_rules import keep_good
from quasirisk.llm.secrets import redact_secrets
from quasirisk.llm.simhash import keep_one_of_each
from quasirisk.llm.store import Store

PACK_TOKENIZER = "word_bpe_49k.json"
SCAN_RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each(docs, shingle=4, radius=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact_secrets(docs, public_tokenizers.path(SCAN_RANKS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with their sequence and offset."""
    return pack_documents(docs, public_tokenizers.path(PACK_TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Fingerprints, edits and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = store.keep(docs, name)
            if number:
                store.drop(STAGES[number - 1][0])
    return docs
