"""A training-data pipeline over documents: toxicity, near-duplicates, benchmark decontamination, mixing, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents (the last: a row per document of the token files). Between stages documents are written as Parquet and read
again; the mixed order is the order of rows in the files, by file name and row number.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any name, as its
operator's module states; what each does with them is in its docstring. All columns of documents pass through the first four.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm import decontaminate, mixing, near_dedup, queries, tokens, toxicity
from cairnlake.llm.common import table, written

#: Near-duplicates: at least this percentage of common 5-word shingles.
NEAR_PERCENT = 80
END_ID = 1


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels outside its held-out fold.

    Null and empty texts stay; rows that repeat a text share its fate; without labels of both kinds all stay."""
    return toxicity.without_toxic(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id.

    One row stays of rows equal in id and text, the first by its other columns; of several texts with the smallest id, the one with the
    least hash. Rows without an id or without words are in no group and stay."""
    return near_dedup.near_dedup(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark.

    Items with null text or without words hit nothing, items with null id hit; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources are interleaved.

    A null source is a source; null ids come first in theirs; rows that repeat an id take the first of its positions, in any order."""
    return mixing.in_mixed_order(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document read back from the token files, which hold them in the order of the rows of docs: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is its end id alone; a null id stays null."""
    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, ids=False, order="rows").select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token ids", tokens_stage),
]
#: SQL can't express the classifier and the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs

