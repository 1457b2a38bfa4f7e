"""Retrieval quality: hits, recall, deltas to a baseline, latency percentiles, precision and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(cases: DataFrame) -> DataFrame:
    """Cases (question, relevant_doc_ids, matched_doc_ids in order, hop_doc_ids) with top1_hit, top3_hit, all_hops_hit and recall.

    A case without relevant documents hits nothing; hops are hit when each group has a match, or
    without groups, when all relevant documents are matched.
    """
    want, got = F.array_distinct("relevant_doc_ids"), F.array_distinct(F.filter("matched_doc_ids", lambda d: d != ""))
    rows = cases.withColumn("__w", want).withColumn("__g", got)
    overlap = F.size(F.array_intersect("__w", "__g"))
    hops = F.when(F.size(F.coalesce("hop_doc_ids", F.array().cast("array<array<string>>"))) > 0, F.forall("hop_doc_ids", lambda h: F.arrays_overlap(h, F.col("__g")))).otherwise((F.size("__w") > 0) & (overlap == F.size("__w")))
    return rows.select(
        "question", F.coalesce(F.array_contains("__w", F.try_element_at("__g", F.lit(1))), F.lit(False)).alias("top1_hit"),
        (F.size(F.array_intersect(F.slice("__g", 1, 3), "__w")) > 0).alias("top3_hit"), F.coalesce(hops, F.lit(False)).alias("all_hops_hit"),
        F.when(F.size("__w") == 0, 0.0).otherwise(F.round(overlap / F.size("__w"), 4)).alias("recall"),
    )


def summarize(results: DataFrame) -> DataFrame:
    rate = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("double")), 4), F.lit(0.0))
    return results.agg(F.count(F.lit(1)).alias("total_cases"), rate("top1_hit").alias("top1_hit_rate"), rate("top3_hit").alias("top3_hit_rate"), rate("all_hops_hit").alias("all_hops_hit_rate"), rate("recall").alias("average_recall"))


def compare(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of the rates over the questions that both have."""
    c, b = current.alias("c"), baseline.alias("b")
    j = c.join(b, "question")
    delta = lambda n: F.round(F.round(F.avg(F.col(f"c.{n}").cast("double")), 4) - F.round(F.avg(F.col(f"b.{n}").cast("double")), 4), 4)
    return j.agg(F.count(F.lit(1)).alias("shared_case_count"), *[delta(n).alias(f"{n}_delta") for n in ("top1_hit", "top3_hit", "all_hops_hit", "recall")])


def latencies(samples: DataFrame, value: str = "ms") -> DataFrame:
    return samples.agg(F.avg(value).alias("average"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def ranking_quality(ranked: DataFrame, k: int = 10) -> DataFrame:
    """key, precision_at_k and reciprocal_rank of ranked rows (key, rank, relevant)."""
    first = F.min(F.when(F.col("relevant"), F.col("rank")))
    hits = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1).otherwise(0))
    return ranked.groupBy("key").agg((hits / k).alias("precision_at_k"), F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"))
