"""Retrieval quality of ranked results against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, judged: DataFrame, k: int = 10, relevant: int = 1) -> DataFrame:
    """query_id, recall, mrr, ndcg, duplicate_rate.

    ranked: query_id, rank, source, text_key. judged: query_id, source, grade. A source counts at its
    first rank; ranks are then closed up. Gains are 2^grade - 1, discounts log2(i + 1). Recall and the
    reciprocal rank are of sources graded ``relevant`` at least.
    """
    first = ranked.groupBy("query_id", "source").agg(F.min("rank").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "source"))
    top = first.withColumn("i", place).where(F.col("i") <= k).join(judged, ["query_id", "source"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1)
    own = top.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.min(F.when(F.col("grade") >= relevant, F.col("i"))).alias("first"), F.sum((F.col("grade") >= relevant).cast("int")).alias("hits"))
    best = judged.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "source")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain)).alias("ideal"), F.sum((F.col("grade") >= relevant).cast("int")).alias("wanted"))
    same = ranked.where(F.col("rank") <= k).groupBy("query_id").agg((1 - F.countDistinct("text_key") / F.count("*")).alias("duplicate_rate"))
    out = ideal.join(own, "query_id", "left").join(same, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", zero(F.col("hits") / F.col("wanted")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"), zero(F.col("duplicate_rate")).alias("duplicate_rate"))


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """The nearest-rank percentile: the value at ceil(share * n) of the sorted ones."""
    return values.agg(F.expr(f"percentile_disc({share}) within group (order by {column})").alias("value"))
