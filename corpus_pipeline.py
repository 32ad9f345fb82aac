"""A corpus pipeline: toxicity, quality, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and gives a DataFrame; ``run`` writes each stage as Parquet to the shared folder
and rereads it as the next one's docs. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import minhash, packing, quality, secrets, toxicity
from lexforge.llm.common import drop_stored, stored, table
from lexforge.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the smallest id."""
    return minhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, at any depth of encoding, are replaced in the texts."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.packing(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The stages learn models and tokenise: no SQL; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if k:
            drop_stored(spark, before)
    return docs
