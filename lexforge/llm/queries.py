"""The queries opN_<name> of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .oracles import ORACLES as ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal

    return personal(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packing

    return packing(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_secrets that SQL can express."""
    return op2_secrets(spark, sf_dir).drop("spans")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_pii that SQL can express."""
    return op5_pii(spark, sf_dir).drop("spans")


def imatch_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_imatch that SQL can express."""
    return op4_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_embeddings, op2_secrets, op3_bpe, op4_imatch, op5_pii, op6_html, op7_quality, op8_toxicity, op9_packing, op10_minhash, secrets_base, pii_base, imatch_edited)
}
