"""A training-corpus pipeline over the documents table, made of the operators in lodestone.llm.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. Stages but the last return the columns of
documents; the last returns the encoded corpus. Null and empty texts go with language ID, which finds no letter in them; very
long texts pass whole; rows that repeat a doc_id or lack one are rows like others, unless a stage says so; an empty table
gives an empty one, and columns beyond those of documents are left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, langid, near_copies, substring_dedup
from lodestone.llm.common import Tables, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the models of the languages learned here accept; a missing lang is filled in.

    Texts that are null or have no letter go, and texts beyond the calibrated limit of their nearest language.
    """
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs)).where("accepted")
    return _documents(found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id, and one row of it.

    Documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked. Rows that share a doc_id
    are different documents if their texts are; rows without one stay only where no row with one has such a text.
    """
    return _documents(near_copies.one_of_each(docs.select(*COLUMNS), width=5, percent=80))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier in the corpus; documents left without a word go.

    The white space between the other words stays.
    """
    cleaned = substring_dedup.remove_repeats(docs.select(*COLUMNS), layout=True)
    return _documents(cleaned.where(F.col("n_removed") < F.col("n_words")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of a benchmark item occurs."""
    found = decontamination.exact_matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return _documents(found.where(F.size("matches") == 0))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, lang, source, tokens, n_tokens, and digests of the ids and of what they decode to."""
    both = bpe.round_trip(docs, VOCABULARY, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return both.select(
        "doc_id", "lang", "source", "tokens", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_removal", substring_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Models, fingerprints and merges are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    tables = Tables(spark)
    for _, stage in STAGES[:-1]:
        docs = tables.last(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
