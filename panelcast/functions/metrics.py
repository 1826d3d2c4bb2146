"""Regression metrics as one aggregation (per group if asked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(pred: DataFrame, label: str = "y", prediction: str = "prediction",
            by: list[str] | tuple | str = ()) -> DataFrame:
    """MAE, MSE, RMSE and R2 (NULL when the truth is constant) in one
    ``groupBy().agg`` pass; partial on the map side."""
    by = [by] if isinstance(by, str) else list(by)
    e = F.col(label).cast("double") - F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e * e).alias("mse"),
            F.sum(e * e).alias("_sse"),
            # a constant truth has no spread, whatever rounding leaves of it
            F.when(F.min(label) < F.max(label), F.var_pop(F.col(label).cast("double")) * F.count(F.lit(1))).alias("_sst")]
    g = pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)
    return (g.withColumn("rmse", F.sqrt("mse"))
             .withColumn("r2", F.lit(1.0) - F.try_divide(F.col("_sse"), F.when(F.col("_sst") > 0, F.col("_sst"))))
             .drop("_sse", "_sst"))


def search_metric(name: str, r2: Column, rmse: Column) -> Column:
    """Score where larger is better: ``r2`` or ``neg_rmse``."""
    if name == "r2":
        return r2
    if name == "neg_rmse":
        return -rmse
    raise ValueError("metric must be 'r2' or 'neg_rmse'")


def summarise(scores: DataFrame, by: list[str] | str = "model", value: str = "r2") -> DataFrame:
    """Mean and population std over folds."""
    by = [by] if isinstance(by, str) else list(by)
    return scores.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"),
                                   F.stddev_pop(value).alias(f"std_{value}"),
                                   F.count(F.lit(1)).alias("folds"))
