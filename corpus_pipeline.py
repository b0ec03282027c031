"""A corpus from raw documents to packed token sequences, in five stages.

Each stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verbena.llm import near_copies, packing, pii, quality, suffixes
from verbena.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their bad lines."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id.

    They meet by the fingerprints and anchors of op1, and by min-hashes and prefixes where those differ in more
    bits. Near are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    return near_copies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that stand elsewhere first."""
    return suffixes.cut_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, by the session's key.

    The test tables hold invented people; without a key that all may know serves them.
    """
    return pii.anonymised(docs, key=spark.conf.get(pii.KEY_SETTING, "test tables"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document's pieces and their places in sequences of 1,024 tokens."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.piece_rows(docs, tokenizer, with_ids=True))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]

#: SQL can't hash with XXH64 or run the tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
