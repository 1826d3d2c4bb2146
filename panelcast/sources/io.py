"""Reading daily tables and persisting models and study results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The reference's daily table (one sheet per city), with an explicit series key.
REFERENCE_SCHEMA = T.StructType(
    [T.StructField("series", T.StringType()), T.StructField("FECHA", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ["PM25", "PM10", "SO2", "O3", "NO", "NO2", "C6H6", "NOx", "CO", "temperatura", "humedad"]]
    + [T.StructField("ingresos", T.LongType()), T.StructField("exitus", T.LongType())])


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", required: list[str] | None = None,
               keys: tuple = (), options: dict | None = None) -> DataFrame:
    """Read a daily table with a fixed schema: Parquet, CSV, JSON or a folder of
    workbooks (``fmt="workbook"``, see ``sources.workbook`` for its ``options``).

    ``keys``: columns that must tell rows apart, such as ``("series",
    "day")``; lags and exact folds rest on it.  One aggregation checks it,
    and a repeated key raises.

    CSV is read ``FAILFAST`` with a header, so a malformed record stops the
    job instead of turning into nulls.  ``required`` lists columns that must
    be present (the plan is fixed on read and checked here, not later).
    """
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", "true").option("mode", "FAILFAST").csv(path)
    elif fmt == "json":
        df = r.option("mode", "FAILFAST").json(path)
    elif fmt == "workbook":
        from .workbook import register_workbooks
        register_workbooks(spark)
        df = r.format(fmt).options(**(options or {})).load(path)
    else:
        df = r.format(fmt).options(**(options or {})).load(path)
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {path}")
    if keys:
        check_keys(df, keys)
    return df


def check_keys(df: DataFrame, keys=("series", "day")) -> DataFrame:
    """``df`` itself if no two rows have the same ``keys``, else an error."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {tuple(twice[0])[:-1]} in {tuple(keys)}")
    return df


def drop_columns(df: DataFrame, cols: list[str] | str, strict: bool = True) -> DataFrame:
    """Drop columns.  ``strict`` raises on an absent name (Spark's own
    ``drop`` ignores it); ``strict=False`` drops only those present."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    absent = [c for c in cols if c not in df.columns]
    if absent and strict:
        raise ValueError(f"cannot drop absent columns {absent}")
    return df.drop(*[c for c in cols if c in df.columns])


def save_model(model, path: str) -> str:
    """Persist a fitted model together with its preprocessing stages.

    A network is written as its weights (one Parquet row) beside its
    preprocessing pipeline.  Every other model is a
    ``pyspark.ml.PipelineModel`` whose stages are built-in (SQL transformers,
    assemblers, tree ensembles), so the directory is readable by plain Spark.
    """
    from ..operators.mlp import NetworkModel
    if isinstance(model, NetworkModel):
        return model.save(SparkSession.getActiveSession(), path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel

    from ..operators.mlp import NetworkModel
    from ..session import path_exists
    spark = SparkSession.getActiveSession()
    if path_exists(spark, f"{path}/network"):
        return NetworkModel.load(spark, path)
    return PipelineModel.load(path)


def score_batch(df: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """Score new daily records with a saved model (``prediction`` column)."""
    out = load_model(path).transform(df)
    return out.select(*(keep or df.columns), "prediction") if keep is not None else out


def save_study(results: DataFrame, path: str, params: dict | None = None,
               mode: str = "overwrite") -> str:
    """Persist a study's result table as parquet, with its parameters
    (best candidate, settings) as one JSON row beside it."""
    results.write.mode(mode).parquet(f"{path}/results")
    if params is not None:
        spark = results.sparkSession
        spark.createDataFrame([(json.dumps(params, sort_keys=True, default=str),)], "params string") \
             .coalesce(1).write.mode(mode).json(f"{path}/params")
    return path


def load_study(spark: SparkSession, path: str) -> tuple[DataFrame, dict | None]:
    res = spark.read.parquet(f"{path}/results")
    try:
        row = spark.read.json(f"{path}/params").first()
        params = json.loads(row["params"]) if row else None
    except Exception:  # no params written
        params = None
    return res, params
