"""Quality of rankings, and percentiles of times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def ranking_metrics(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """recall, MRR and nDCG at k. results: doc_id, rank; grades: doc_id, grade (0: not relevant)."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    relevant = grades.where("grade > 0")
    top = relevant.orderBy(F.desc("grade"), "doc_id").limit(k)
    top = top.withColumn("r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("grade"), "doc_id")))
    ideal = top.agg(F.coalesce(F.sum(gain(F.col("grade"), F.col("r"))), F.lit(0.0)).alias("ideal")).crossJoin(relevant.agg(F.count("*").alias("relevant")))
    rows = results.where(F.col("rank") <= k).join(grades, "doc_id", "left").withColumn("g", F.coalesce("grade", F.lit(0)))
    per = rows.agg(F.count_if(F.col("g") > 0).alias("found"), F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first"), F.sum(gain(F.col("g"), F.col("rank"))).alias("dcg"))
    return per.crossJoin(ideal).select(
        F.round(F.col("found") / F.col("relevant"), 6).alias(f"recall_at_{k}"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias(f"mrr_at_{k}"), F.round(F.col("dcg") / F.col("ideal"), 6).alias(f"ndcg_at_{k}")
    )


def nearest_rank(df: DataFrame, column: str, shares: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by nearest rank: the value at ceil(p n) in order."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(name) for name, p in shares.items()])
