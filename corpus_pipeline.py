"""The corpus pipeline: stages over documents, each on what its predecessor kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shardkit.llm import language, line_runs, order_minhash, packing, secret_ledger
from shardkit.llm.common import scratch, scratch_removed
from shardkit.session import scratch_path
from shardkit.sources.commits import delete

# Texts of which a smaller part is in their language are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from docs with a lang; texts without letters, and those mixed half and half, go."""
    return language.keep_known(docs, language.learn(docs), LEAST_LANGUAGE_SCORE)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents stay in the last of them only."""
    return line_runs.deduped(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return order_minhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    ledger = secret_ledger.SecretLedger(spark, scratch(spark, "secret-ledger"))
    ledger.update(docs)
    return ledger.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("line dedup", fresh_lines),
    ("near duplicates", one_of_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Language models, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and what it was made of is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"stage-{number}")
        with scratch_removed(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
