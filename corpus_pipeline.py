"""From raw documents to packed training sequences.

Each stage works on what its predecessor kept, written as Parquet and read again, and returns the
columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import language_id, line_dedup, ngram_join, packing
from corvane.llm.common import table, tokenizer_path, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier learnt from those not held out.

    Texts that are null or hold no letter go, and those that it flags as ambiguous: two codewords are about
    as near, as for a text of one or two letters or of two languages at once.
    """
    return language_id.keep_told(docs, language_id.learn_from(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least three share, but in the one of the largest doc_id."""
    return line_dedup.dedup_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near copies, and those without a doc_id."""
    return ngram_join.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, placed in as few sequences as best fit finds."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Learnt languages and packing can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of documents; what is between two stages is in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
