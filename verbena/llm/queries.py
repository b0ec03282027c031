"""The registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.llm import (
    bpe_chunks,
    chat_tree,
    filter_audit,
    licenses,
    nn_descent,
    packing,
    phrases,
    pii,
    quality,
    secrets,
    simhash,
    suffixes,
    toxicity,
)

#: The test tables hold invented people: a key that all may know makes each run give the same rows.
TABLES_KEY = "test tables"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_quality_rules", quality.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of every document, and the verdict of the line rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality_rules(docs)
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in quality.COLUMNS])


@query("op10_best_two_fit")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1,024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.piece_rows(docs, public_tokenizers.path("byte_bpe_50k.json")))


@query("op1_simhash_anchors")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.near_groups(docs)
    return groups.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query("op2_credential_links", secrets.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked secret spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.find_secrets(docs))


@query("op5_chunk_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe_chunks.encode_documents(docs, path, digests)


@query("op3_toxicity_cnn")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by a classifier trained on the labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


@query("op7_nn_descent")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nn_descent.nearest_neighbours(rows, lambda i: i % 20 == 0)


@query("op8_sparse_suffixes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in the documents more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = suffixes.repeated_spans(docs)
    cut = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["end"] - c["start"])
    return spans.select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        cut.alias("cut_words"),
    )


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data, and how many there are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.replace_entities(docs, key=TABLES_KEY)
    places = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"]))
    return done.select(
        "doc_id",
        "text",
        F.size("entities").cast("long").alias("n_entities"),
        F.array_join(places, ",").alias("entities"),
    )


@query("op6_license_tfidf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or that of the nearest directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return licenses.scan_licenses(licenses.document_paths(docs), licenses.templates_of(spark))


@query("op13_filter_audit", filter_audit.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in all 120 orders."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audit_filters(docs, labels)


@query("op11_son_phrases", phrases.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return phrases.collocations(docs)


@query("op12_chat_tree", chat_tree.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns and loss texts, read back from the prefix trees."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(chat_tree.HARD_ID, k, r, chat_tree.HARD_TEXT) for k, r in enumerate(["user", "assistant"])]
    added = rows.unionByName(
        spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    )
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return chat_tree.read_back(chat_tree.prefix_trees(added, tokenizer), tokenizer)
