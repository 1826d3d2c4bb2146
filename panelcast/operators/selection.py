"""Ranking, leaderboards and stability over small score tables.

Score tables are long: ``(model, fold, value)`` with an optional
``model_order`` (declaration order), which breaks ties the way a stable
sort keeps declared order.  They are folds x candidates in size, so the
unpartitioned windows below run over a handful of rows, never over data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_models(scores: DataFrame, value: str = "r2", order: str = "model_order") -> DataFrame:
    """Rank models inside each fold, best first (ties keep declared order)."""
    w = Window.partitionBy("fold").orderBy(F.col(value).desc_nulls_last(), F.col(order))
    return scores.withColumn("rank", F.row_number().over(w))


def leaderboard(scores: DataFrame, value: str = "r2", order: str = "model_order") -> DataFrame:
    """Models by mean score over folds, descending, with population std."""
    g = scores.groupBy("model", order).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    w = Window.orderBy(F.col("mean").desc_nulls_last(), F.col(order))
    return g.withColumn("position", F.row_number().over(w))


def top(board: DataFrame, n: int = 2) -> DataFrame:
    return board.where(F.col("position") <= n)


def stability(board: DataFrame, limit: float = 0.05, n: int | None = 2) -> DataFrame:
    """``OK`` when the std over folds is under ``limit``, else ``CHECK``;
    for the first ``n`` models of the board (all if ``None``)."""
    b = top(board, n) if n else board
    return b.withColumn("status", F.when(F.col("std") < F.lit(limit), "OK").otherwise("CHECK"))


def best_candidate(scores: DataFrame, value: str = "score", order: str = "candidate") -> DataFrame:
    """Best mean score over folds; the first candidate wins a tie."""
    g = scores.groupBy(order).agg(F.avg(value).alias("mean_score"), F.stddev_pop(value).alias("std_score"))
    return g.orderBy(F.col("mean_score").desc_nulls_last(), F.col(order)).limit(1)


def best_family(a_name: str, a_score: float, b_name: str, b_score: float) -> str:
    """The first family wins only if strictly better."""
    return a_name if a_score > b_score else b_name


def sort_importance(t: DataFrame, value: str = "importance") -> DataFrame:
    w = Window.orderBy(F.col(value).desc(), F.col("feature"))
    return t.withColumn("position", F.row_number().over(w))


def sort_coefs(t: DataFrame, value: str = "coef", nonzero_only: bool = True) -> DataFrame:
    """Coefficients by absolute value, descending; zeros dropped first."""
    if nonzero_only:
        t = t.where(F.col(value) != 0)
    w = Window.orderBy(F.abs(F.col(value)).desc(), F.col("term"))
    return t.withColumn("position", F.row_number().over(w))
