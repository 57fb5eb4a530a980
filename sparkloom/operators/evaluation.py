"""Offline relevance evaluation: recall, reciprocal rank and nDCG at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(relevant: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """For each query of relevant(query_id, source_id): recall, rr and ndcg of results(query_id,
    source_id, rank). Recall counts distinct sources; gain counts a source as often as it is ranked."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = results.where(F.col("rank") <= k).join(relevant, ["query_id", "source_id"], "left_semi")
    hits = hits.groupBy("query_id").agg(F.countDistinct("source_id").alias("found"), F.min("rank").alias("best"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return n.join(hits, "query_id", "left").select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("n_rel")).alias("recall"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg")
    )


def macro(scores: DataFrame, k: int) -> DataFrame:
    return scores.agg(
        F.count("*").alias("n_answerable"), F.round(F.avg("recall"), 6).alias(f"recall_at_{k}"), F.round(F.avg("rr"), 6).alias(f"mrr_at_{k}"), F.round(F.avg("ndcg"), 6).alias(f"ndcg_at_{k}")
    )
