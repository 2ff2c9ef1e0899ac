"""Recall, duplicate and latency evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of each query's k true neighbours that were found."""
    hits = truth.filter(F.col("rank") <= k).select("query_id", "vec_id").join(found.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> float:
    return float(recall(found, truth, k).agg(F.avg("recall")).first()[0] or 0.0)


def duplicate_results(found: DataFrame) -> DataFrame:
    """(query_id, vec_id, n) that a result holds more than once."""
    return found.groupBy("query_id", "vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def trimmed_latency(samples: DataFrame, column: str) -> DataFrame:
    """n, mean_value, min_value, max_value of the samples within 1.5 interquartile ranges of the quartiles."""
    q = samples.agg(F.expr(f"percentile_disc(0.25) WITHIN GROUP (ORDER BY {column})").alias("q1"), F.expr(f"percentile_disc(0.75) WITHIN GROUP (ORDER BY {column})").alias("q3"))
    spread = F.col("q3") - F.col("q1")
    kept = samples.join(F.broadcast(q)).filter(F.col(column).between(F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean_value"), F.min(column).alias("min_value"), F.max(column).alias("max_value"))
