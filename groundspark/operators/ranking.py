"""Ranking, rank fusion and reranking of scored rows. Scores are rounded before they are ranked, so that ties are ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def rank_by_score(scored: DataFrame, query: str, score: str, tie: str, depth: int | None = None) -> DataFrame:
    """Adds rank (1 first): score rounded to DIGITS descending, tie ascending; cut at depth if given."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie).asc())
    ranked = scored.withColumn(score, F.round(F.col(score), DIGITS)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= depth) if depth else ranked


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return 1.0 / (F.lit(k) + rank)


def fuse(lists: dict[str, DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, item, rank): fusion_score, its rank, and each list's rank or null.

    A union and one aggregation instead of full outer joins; an item that a list lacks adds nothing.
    """
    each = [df.select(query, item, "rank", F.lit(name).alias("_list")) for name, df in lists.items()]
    union = each[0]
    for other in each[1:]:
        union = union.unionByName(other)
    ranks = [F.max(F.when(F.col("_list") == name, F.col("rank"))).alias(f"{name}_rank") for name in lists]
    fused = union.groupBy(query, item).agg(F.sum(reciprocal_rank(F.col("rank"), k)).alias("fusion_score"), *ranks)
    return rank_by_score(fused, query, "fusion_score", item)


def rerank(fused: DataFrame, scores: DataFrame, query: str, item: str, candidates: int = 30, top: float = 3.0) -> DataFrame:
    """Orders the first `candidates` fused rows by a judge's score (query, item, score), divided by `top`.

    A candidate without a score counts as 0; equal scores keep their fused order.
    """
    cut = fused.where(F.col("rank") <= candidates).withColumnRenamed("rank", "fused_rank")
    joined = cut.join(scores.select(query, item, F.col("score").alias("_s")), [query, item], "left")
    scored = joined.withColumn("rerank_score", F.coalesce(F.col("_s"), F.lit(0)) / F.lit(top)).drop("_s")
    order = Window.partitionBy(query).orderBy(F.col("rerank_score").desc(), F.col("fused_rank").asc())
    return scored.withColumn("rank", F.row_number().over(order))
