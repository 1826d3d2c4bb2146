"""Tree, forest and boosting regressors on Spark ML, with the reference's
parameter names mapped onto Spark's, and importances.

Spark's tree learners are distributed (per-partition histograms of binned
features, aggregated per node), so fitting scales with the rows.  Options
with no Spark equal fail loudly unless ``strict=False``, in which case
the nearest setting is used and recorded in ``notes``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_MAX_DEPTH = 30   # Spark's cap; "no limit" maps here
MAX_BINS = 64          # candidate thresholds per feature, plus one; ``max_bins`` sets another
LOCAL_TASK_MB = 32


def _task_mb() -> int:
    """Budget of a task for node statistics: ``spark.panelcast.treeTaskMemoryMB``
    if set, else Spark's 256, or less in a local session, where all tasks share
    one heap (smaller: more passes over the data per level)."""
    s = SparkSession.getActiveSession()
    v = s.conf.get("spark.panelcast.treeTaskMemoryMB", None) if s is not None else None
    if v:
        return int(v)
    return LOCAL_TASK_MB if s is not None and s.sparkContext.master.startswith("local") else 256


def _depth(d, strict: bool, notes: list) -> int:
    if d is not None and int(d) > SPARK_MAX_DEPTH:
        if strict:
            raise Unsupported(f"max_depth={d} is above Spark's {SPARK_MAX_DEPTH}; pass strict=False to cut it")
        notes.append(f"max_depth={d} -> {SPARK_MAX_DEPTH}")
    return SPARK_MAX_DEPTH if d is None else min(int(d), SPARK_MAX_DEPTH)


def _common(params: dict, notes: list) -> dict:
    """Settings that all learners share; ``max_bins`` is recorded."""
    bins = int(params.get("max_bins") or MAX_BINS)
    notes.append(f"max_bins={bins}: at most {bins - 1} thresholds per feature")
    return {"maxBins": bins, "checkpointInterval": 10, "maxMemoryInMB": _task_mb()}


def _feature_share(v) -> str:
    if v is None:
        return "all"
    if isinstance(v, str):
        if v in ("sqrt", "log2", "all", "onethird", "auto"):
            return v
        raise ValueError(f"unknown feature share {v!r}")
    if isinstance(v, float) and 0 < v <= 1:
        return "all" if v == 1.0 else repr(float(v))
    if isinstance(v, int) and v >= 1:
        return str(v)
    raise ValueError(f"unknown feature share {v!r}")


class Unsupported(ValueError):
    pass


def tree(params: dict, seed: int = 42, strict: bool = True, features: str = "features",
         label: str = "label", prediction: str = "prediction"):
    from pyspark.ml.regression import DecisionTreeRegressor
    notes = []
    known = {"max_depth", "min_samples_leaf", "max_bins"}
    _check(params, known, strict, notes)
    est = DecisionTreeRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, seed=seed,
                                maxDepth=_depth(params.get("max_depth"), strict, notes),
                                minInstancesPerNode=int(params.get("min_samples_leaf") or 1),
                                **_common(params, notes))
    return est, notes


def forest(params: dict, seed: int = 42, strict: bool = True, features: str = "features",
           label: str = "label", prediction: str = "prediction"):
    from pyspark.ml.regression import RandomForestRegressor
    notes = []
    leaf = int(params.get("min_samples_leaf") or 1)
    if params.get("min_samples_split") not in (None, 2):
        if strict:
            raise Unsupported("min_samples_split has no Spark equal; pass strict=False to bound it "
                              "by minInstancesPerNode = max(leaf, ceil(split / 2))")
        leaf = max(leaf, math.ceil(int(params["min_samples_split"]) / 2))
        notes.append(f"min_samples_split={params['min_samples_split']} -> minInstancesPerNode={leaf}")
    _check(params, {"n_estimators", "max_depth", "min_samples_leaf", "min_samples_split", "max_features",
                    "bootstrap", "max_bins"},
           strict, notes)
    est = RandomForestRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, seed=seed,
                                numTrees=int(params.get("n_estimators", 100)),
                                maxDepth=_depth(params.get("max_depth"), strict, notes),
                                minInstancesPerNode=leaf,
                                featureSubsetStrategy=_feature_share(params.get("max_features", 1.0)),
                                bootstrap=bool(params.get("bootstrap", True)),
                                **_common(params, notes))
    return est, notes


def boost(params: dict, seed: int = 42, strict: bool = True, features: str = "features",
          label: str = "label", prediction: str = "prediction"):
    """Squared-error gradient boosting, depth-wise.  ``colsample_bytree``
    becomes a per-node feature share; ``num_leaves`` (leaf-wise growth)
    becomes the depth whose full tree has that many leaves.  The bootstrap of
    forests and the row sample of boosting are Spark's: they depend on how rows
    are partitioned (``bootstrap=False`` and ``subsample=1.0`` do not)."""
    from pyspark.ml.regression import GBTRegressor
    notes = []
    for k in ("reg_alpha", "reg_lambda"):
        if params.get(k) not in (None, 0, 0.0):
            if strict:
                raise Unsupported(f"{k} (leaf penalty) has no Spark equal; pass strict=False to ignore it")
            notes.append(f"{k}={params[k]} ignored")
    depth = params.get("max_depth")
    if depth == -1:
        depth = None
    if params.get("num_leaves") is not None:
        d_leaves = max(1, math.ceil(math.log2(int(params["num_leaves"]))))
        depth = d_leaves if depth is None else min(int(depth), d_leaves)
        notes.append(f"num_leaves={params['num_leaves']} (leaf-wise) -> maxDepth={depth}")
    _check(params, {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree",
                    "reg_alpha", "reg_lambda", "num_leaves", "min_samples_leaf", "max_bins"}, strict, notes)
    est = GBTRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, seed=seed,
                       lossType="squared",
                       maxIter=int(params.get("n_estimators", 100)),
                       maxDepth=_depth(depth if depth is not None else 6, strict, notes),
                       minInstancesPerNode=int(params.get("min_samples_leaf") or 1),
                       stepSize=float(params.get("learning_rate", 0.1)),
                       subsamplingRate=float(params.get("subsample", 1.0)),
                       featureSubsetStrategy=_feature_share(params.get("colsample_bytree", 1.0)),
                       **_common(params, notes))
    return est, notes


def _check(params, known, strict, notes):
    extra = set(params) - known
    if extra:
        if strict:
            raise Unsupported(f"unsupported parameters {sorted(extra)}")
        notes.append(f"ignored {sorted(extra)}")


BUILDERS = {"tree": tree, "forest": forest, "boost": boost}


def effective(kind: str, params: dict, strict: bool = True, seed: int = 42) -> str:
    """What Spark is told for ``params``: equal for settings that come to the
    same model, so that each is fitted once."""
    est, _ = BUILDERS[kind](params, seed=seed, strict=strict)
    return repr(sorted((p.name, str(v)) for p, v in est.extractParamMap().items()))


# ------------------------------------------------------------ importances
def impurity_importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Impurity importance (sums to 1) of a tree model or ensemble."""
    v = model.featureImportances.toArray()
    return [(n, float(x)) for n, x in zip(names, v)]


def node_table(spark: SparkSession, model, path: str) -> DataFrame:
    """Internal nodes of a saved tree model: ``(tree, feature_index, gain)``."""
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    return data.where(F.col("split.featureIndex") >= 0) \
               .select("tree", F.col("split.featureIndex").alias("feature_index"), "gain")


def split_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Times each feature is used to split (features never used count 0)."""
    spark = nodes.sparkSession
    idx = spark.createDataFrame(list(enumerate(names)), "feature_index int, feature string")
    cnt = nodes.groupBy("feature_index").agg(F.count(F.lit(1)).alias("importance"))
    return idx.join(cnt, "feature_index", "left").select(
        "feature", F.coalesce("importance", F.lit(0)).cast("double").alias("importance"))


def gain_importance(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Mean gain of the splits on each feature (0 if never used)."""
    spark = nodes.sparkSession
    idx = spark.createDataFrame(list(enumerate(names)), "feature_index int, feature string")
    g = nodes.groupBy("feature_index").agg(F.avg("gain").alias("importance"))
    return idx.join(g, "feature_index", "left").select(
        "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
