"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, fingerprint, language_id, line_dedup, nearest, ngram_join, token_counts
from .common import table, tokenizer_path
from .packing import pack_documents
from .token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, tokenizer_path("word_bpe_49k.json"), end_id=1))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"), F.sha2("__kept_text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn_from(docs)
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.digest(chat_format.format_conversations(turns))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_best_fit_packing, op4_line_dedup, op5_language_id, op6_chat_format, op7_bpe, op8_token_counts, op9_nearest, op10_ngram_join, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.SQL, "op6_chat_format": chat_format.SQL}
