"""A training-data pipeline over ``documents``: quality, exact and near duplicates, mixing, tokens.

In every stage a null text counts as an empty one, rows with a null id are rows like any other, very long
texts count as a whole, and an empty table gives an empty result; further columns pass through all stages
but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonflow.llm import bpe, exact_dedup, mixing, ngram_join, quality
from codonflow.llm.common import read, stored

#: The stages cannot be said in SQL (learnt model, hash-random mix, tokens); each is tested against a brute-force form.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model does not reject. Repeated rows and equal texts are judged alike."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id; of rows with equal id and text any one."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more: the smallest id.

    Documents without words are linked with nothing and stay; rows that repeat the id that stays, stay with it.
    """
    return ngram_join.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for. A null source is one of its own; ties go by a hash of the row."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes; repeated rows each get theirs."""
    import public_tokenizers
    from pyspark.sql import functions as F

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(docs, ranks_path, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(decoded, keep=("ids",)).select("doc_id", "n_tokens", F.col("ids"), "ids_sha256", "decoded_sha256")


STAGES = [("quality", keep_quality), ("exact dedup", drop_exact), ("near duplicates", drop_near), ("mix", mix_sources), ("tokens", encode_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
