"""End-to-end studies, one per reference script, as Spark plans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import metrics
from ..operators import presets, splits
from ..operators.fitting import ModelSpec, cross_validate
from .common import F_COMPARE, prep


# the presets with fewer trees, for panels of test size
BOOST_SMALL = {**presets.COMPARE_BOOST, "n_estimators": 20, "learning_rate": 0.1}
FOREST_SMALL = {**presets.COMPARE_FOREST, "n_estimators": 20}
BOOST_LEAFWISE_SMALL = {**presets.COMPARE_BOOST_LEAFWISE, "n_estimators": 20}


def flagship(spark: SparkSession, sf: str, k: int = 5, seed: int = 42) -> DataFrame:
    d = splits.kfold(prep(spark, sf, F_COMPARE + ["y"]), k, seed, "hash")
    spec = ModelSpec("ols_degree2", "ols", F_COMPARE, degree=2)
    pred = cross_validate(spec, d)
    return metrics(pred, "y", "prediction", ["fold"]).orderBy("fold")


def comparison_study(spark: SparkSession, sf: str, boost: dict | None = None, forest: dict | None = None,
                     boost2: dict | None = None, k: int = 5, seed: int = 42) -> dict[str, DataFrame]:
    """Least squares on the degree-2 expansion, boosting and a vote of
    boosting, forest and a second boosting, on the same folds; fold scores,
    ranking per fold, leaderboard, stability of the top two, box and line
    tables.  Defaults are small settings; pass the reference's for full size."""
    from ..operators import charts, selection
    from ..operators.fitting import compare_scores
    boost, forest, boost2 = boost or BOOST_SMALL, forest or FOREST_SMALL, boost2 or BOOST_LEAFWISE_SMALL
    d = splits.kfold(prep(spark, sf, F_COMPARE + ["y"]), k, seed, "hash").persist()
    specs = [ModelSpec("least_squares", "ols", F_COMPARE, degree=2),
             ModelSpec("boosting", "boost", F_COMPARE, boost, strict=False),
             ModelSpec("voting", "voting", F_COMPARE, members=[("boost", boost), ("forest", forest), ("boost", boost2)],
                       strict=False)]
    scores = compare_scores(specs, d, parallelism=3)
    d.unpersist()
    board = selection.leaderboard(scores)
    return {"scores": scores, "ranks": selection.rank_models(scores), "leaderboard": board,
            "stability": selection.stability(board, 0.05, 2), "box": charts.box_summary(scores, exact=True),
            "lines": charts.fold_lines(scores)}


def linear_study(spark: SparkSession, sf: str, k: int = presets.FOLDS, seed: int = 42) -> dict[str, DataFrame]:
    """Scale on all rows, products of distinct inputs up to degree 3 with a
    constant (26 terms), 30% holdout; Ridge and Lasso each searched over ten
    penalties on ``k`` folds of the training rows (one Gram pass), Ridge kept
    only if strictly better; refit, holdout metrics, nonzero coefficients by
    size; then a nested search over the winning family on all rows (inner folds
    are chronological blocks), with all metrics of each outer fold."""
    from ..functions.expand import Standardizer, poly, poly_names, poly_terms
    from ..operators import linear, selection
    from .common import F_LINEAR
    d = prep(spark, sf, F_LINEAR + ["y_prev", "y"])
    z = Standardizer(F_LINEAR).fit(d).transform(d)
    x = poly(z, F_LINEAR, presets.LINEAR_DEGREE, interaction_only=True, bias=True, prefix="t")
    names = poly_names(F_LINEAR, presets.LINEAR_DEGREE, True, True)
    terms = [f"t{i}" for i in range(len(names))]
    expansion = {"base": F_LINEAR, "monomials": poly_terms(len(F_LINEAR), presets.LINEAR_DEGREE, True, True)}
    x = splits.kfold(splits.holdout(x, presets.HOLDOUT, seed, "hash"), k, seed, "hash", salt="|cv").persist()
    gs = linear.GramSet(x.where(~F.col("is_test")), terms, "y", by=["fold"], **expansion)
    best = {}
    for kind in ("ridge", "lasso"):
        cands = linear.linear_candidates(kind)
        ci, score = linear.best_of(linear.cv_scores(gs, cands), len(cands))
        best[kind] = (cands[ci]["alpha"], score)
    family = selection.best_family("ridge", best["ridge"][1], "lasso", best["lasso"][1])
    model = gs.fit(family, best[family][0])
    nested = linear.nested_cv_blocks(x, terms, "y", family, k_inner=k)
    return {"best": spark.createDataFrame([(family, *map(float, best[family]))], "family string, alpha double, score double"),
            "metrics": metrics(model.transform(x.where("is_test")), "y", "prediction"),
            "coefs": selection.sort_coefs(spark.createDataFrame(model.coef_rows(names), "term string, coef double")),
            "nested": linear.nested_metrics(x, nested)}


def two_series(spark: SparkSession, sf: str, names: tuple | None = None) -> DataFrame:
    """Series prepared apart, stacked (``names``: all unless given), lagged, and
    only then freed of rows with nulls: the lag is the previous day on record,
    not the previous complete one."""
    from ..functions.features import calendar_parts, cyclical, drop_nulls, lag_feature
    from ..sources.fixture import fixture_panel
    p = fixture_panel(spark, sf).drop("y_drop")
    if names is not None:
        p = p.where(F.col("series").isin(*names))       # one panel build, then the series asked for
    p = cyclical(calendar_parts(p, "day", ("month",)), "month", 12, ("sin", "cos"))
    return drop_nulls(lag_feature(p, "y"))


def two_series_study(spark: SparkSession, sf: str, names=("EUROPE", "ASIA"), seed: int = 42) -> dict[str, DataFrame]:
    """The series ``names`` together: scaled and expanded, 30% held out, vote
    of boosting and forest."""
    from ..operators import charts
    from ..operators.fitting import fit
    from .common import F_NETWORK
    d = splits.holdout(two_series(spark, sf, names), presets.HOLDOUT, seed, "hash")
    spec = ModelSpec("voting", "voting", F_NETWORK, degree=2, strict=False,
                     members=[("boost", BOOST_SMALL), ("forest", FOREST_SMALL)])
    m = fit(spec, d.where(~F.col("is_test")))
    pred = m.transform(d.where("is_test"))
    return {"metrics": metrics(pred, "y", "prediction"), "scatter": charts.actual_vs_predicted(pred)}


def boost_log_study(spark: SparkSession, sf: str, model_path: str, grid: dict | None = None,
                    seed: int = 42, parallelism: int = 4, progress: str | None = None) -> dict[str, DataFrame]:
    """Log target, scale fitted on each fit's training rows (trees don't depend
    on it), 30% holdout, grid search on training folds (negative RMSE in log
    space), refit, metrics after expm1, split counts, saved model, and the
    winner's scores on five unshuffled blocks of all rows."""
    from ..operators import trees as tr
    from ..operators.fitting import compare_scores, fit
    from ..sources import io
    from ..session import scratch_path
    from .common import F_TREE
    grid = grid or {**presets.BOOST_LOG_GRID, "n_estimators": [10, 20], "learning_rate": [0.1], "max_depth": [3, 5],
                    "subsample": [1.0], "colsample_bytree": [1.0]}
    d = splits.holdout(prep(spark, sf, F_TREE + ["y"]), presets.HOLDOUT, seed, "hash")
    train = splits.kfold(d.where(~F.col("is_test")), presets.FOLDS, seed, "hash", salt="|cv").persist()
    cands = splits.grid_candidates(grid)
    specs = [ModelSpec(f"c{i}", "boost", F_TREE, c, log_target=True, strict=False) for i, c in enumerate(cands)]
    scores = compare_scores(specs, train, parallelism=parallelism, progress=progress, log=True)
    sc = scores.groupBy("model_order").agg(F.avg(-F.col("rmse")).alias("score"))
    best = sc.orderBy(F.col("score").desc(), "model_order").first()["model_order"]
    m = fit(specs[best], train)
    io.save_model(m.model, model_path)
    nodes = tr.node_table(spark, m.members[0], scratch_path(spark, f"boost_log_nodes-{uuid.uuid4().hex}"))
    blocks = splits.kfold(d, presets.FOLDS, seed, "blocks").persist()
    out = {"search": sc, "metrics": metrics(m.transform(d.where("is_test")), "y", "prediction"),
           "split_importance": tr.split_importance(nodes, F_TREE),
           "block_scores": compare_scores([specs[best]], blocks, parallelism=parallelism)}
    train.unpersist()
    blocks.unpersist()
    return out


def pca_study(spark: SparkSession, sf: str, names: dict | None = None) -> dict[str, DataFrame]:
    """Standardise, all components, loadings, explained and cumulative
    variance with percent labels."""
    from ..operators import charts
    from ..operators.pca import pca
    from ..sources.fixture import fixture_panel
    from .common import DISPLAY, F_PCA
    d = fixture_panel(spark, sf).drop("y_drop").dropna(subset=F_PCA).persist()
    m = pca(d, F_PCA)
    ev = charts.variance_labels(charts.cumulative(m.explained(spark)))
    return {"scores": m.transform(d), "loadings": m.loadings(spark, names or DISPLAY), "variance": ev}


def network_data(spark: SparkSession, sf: str, seed: int = 42):
    """Panel with holdout, validation share and row key, the preprocessing
    (scale and degree-2 expansion, fitted on the training rows) and its terms."""
    from ..operators.fitting import _prep_stages
    from ..operators.mlp import row_key
    from pyspark.ml import PipelineModel
    from .common import F_NETWORK
    d = splits.validation(splits.holdout(prep(spark, sf, F_NETWORK + ["y"]), presets.HOLDOUT, seed, "hash"),
                          presets.NETWORK_VALIDATION, seed)
    spec = ModelSpec("network", "ols", F_NETWORK, degree=2)
    stages, terms = _prep_stages(spec, d.where(~F.col("is_test")), None)
    return row_key(d), PipelineModel(stages), terms, terms + [c + "__z" for c in F_NETWORK]


def network_study(spark: SparkSession, sf: str, trials: int = 3, epochs: int = 30, seed: int = 42,
                  model_path: str | None = None, configs: list | None = None) -> dict[str, DataFrame]:
    """Random search over the network space (validation share for early
    stopping), the best trial's weights kept: trials, best parameters, test
    metrics; saved with its preprocessing if ``model_path`` is given."""
    from dataclasses import asdict

    from ..operators.mlp import NetworkModel, fit_mlp, sample_configs
    from ..sources import io
    d, pre, terms, drop = network_data(spark, sf, seed)
    train = pre.transform(d.where(~F.col("is_test"))).persist()
    fits = [fit_mlp(train, terms, "y", c) for c in configs or sample_configs(trials, seed, epochs)]
    train.unpersist()
    best = min(range(len(fits)), key=lambda i: min(h["val_loss"] for h in fits[i].history))
    rows = [(i, "-".join(map(str, f.config.hidden)), f.config.learning_rate,
             float(min(h["val_loss"] for h in f.history)), len(f.history)) for i, f in enumerate(fits)]
    model = NetworkModel(fits[best], pre, drop)
    if model_path:
        io.save_model(model, model_path)
    return {"trials": spark.createDataFrame(rows, "trial int, layers string, learning_rate double, val_loss double, epochs int"),
            "best": spark.createDataFrame([(best, json.dumps(asdict(fits[best].config)))], "trial int, params string"),
            "metrics": metrics(model.transform(d.where("is_test")), "y", "prediction")}


def network_search(spark: SparkSession, sf: str, trials: int = presets.NETWORK_TRIALS, epochs: int = presets.NETWORK_EPOCHS,
                   first: int = 15, seed: int = 42, model_path: str | None = None, progress: str | None = None) -> dict[str, DataFrame]:
    """Successive halving over ``trials`` random networks of at most ``epochs``
    epochs (defaults: the reference's search), on rows that are dealt once and
    with all live networks in one pass: trials, best parameters, test metrics.
    ``progress`` (shared folder) keeps finished rungs, so that a rerun resumes."""
    from dataclasses import asdict

    from ..operators.mlp import NetworkModel, halving_search, sample_configs
    from ..sources import io
    d, pre, terms, drop = network_data(spark, sf, seed)
    train = pre.transform(d.where(~F.col("is_test")))
    found = halving_search(train, terms, "y", sample_configs(trials, seed, epochs), first, progress=progress)
    rows = [(i, "-".join(map(str, f.config.hidden)), f.config.learning_rate, float(min(h["val_loss"] for h in f.history)),
             len(f.history), r) for i, (f, r) in enumerate(zip(found.fits, found.rungs))]
    best = found.best
    model = NetworkModel(found.fits[best], pre, drop)
    if model_path:
        io.save_model(model, model_path)
    return {"trials": spark.createDataFrame(rows, "trial int, layers string, learning_rate double, val_loss double, epochs int, rung int"),
            "best": spark.createDataFrame([(best, json.dumps(asdict(found.fits[best].config)))], "trial int, params string"),
            "metrics": metrics(model.transform(d.where("is_test")), "y", "prediction")}


def tree_study(spark: SparkSession, sf: str, kind: str = "tree", grid: dict | None = None,
               strict: bool = False, seed: int = 42, parallelism: int = 4,
               progress: str | None = None) -> dict[str, DataFrame]:
    """Grid search of a tree (``kind='tree'``) or forest (``'forest'``) on
    five folds of the 70% training rows (R2), refit of the best candidate on
    all training rows, holdout metrics and impurity importances, sorted.
    ``grid`` defaults to the reference grid (presets); ``progress`` (shared
    folder) keeps finished (candidate, fold) predictions so a long search
    resumes after a failure."""
    from ..operators import selection
    from ..operators import trees as tr
    from ..operators.fitting import compare_scores, fit
    from .common import F_TREE
    grid = grid or (presets.TREE_GRID if kind == "tree" else presets.FOREST_GRID)
    d = splits.holdout(prep(spark, sf, F_TREE + ["y"]), presets.HOLDOUT, seed, "hash")
    train = splits.kfold(d.where(~F.col("is_test")), presets.FOLDS, seed, "hash", salt="|cv").persist()
    cands = splits.grid_candidates(grid)
    specs = [ModelSpec(f"c{i}", kind, F_TREE, c, scale=(kind == "forest"), strict=strict)
             for i, c in enumerate(cands)]
    sc = compare_scores(specs, train, parallelism=parallelism, progress=progress)
    board = sc.groupBy("model_order").agg(F.avg("r2").alias("mean_r2")).orderBy(F.col("mean_r2").desc(), "model_order")
    best = board.first()["model_order"]
    m = fit(specs[best], train)
    imp = spark.createDataFrame(tr.impurity_importance(m.members[0], F_TREE), "feature string, importance double")
    return {"search": board, "best": spark.createDataFrame([(best, str(cands[best]))], "candidate int, params string"),
            "metrics": metrics(m.transform(d.where("is_test")), "y", "prediction"),
            "importance": selection.sort_importance(imp)}


def boost_search_study(spark: SparkSession, sf: str, space: dict | None = None, draws: int | None = None,
                       seed: int = 42, parallelism: int = 4, progress: str | None = None) -> dict[str, DataFrame]:
    """Random search of boosting over ``draws`` candidates (R2, five folds
    of the training rows) on the scaled degree-2 expansion, refit, holdout
    metrics, gain importance, then five-fold scores of the winner on all
    rows with their mean, population std and stability flag."""
    from ..functions.expand import poly_names
    from ..operators import selection
    from ..operators import trees as tr
    from ..operators.fitting import compare_scores, fit
    from ..session import scratch_path
    from .common import F_NETWORK
    space = space or presets.BOOST_SPACE
    draws = draws or presets.BOOST_DRAWS
    grid = splits.param_grid(spark, space)
    picked = splits.param_sample(grid, draws, seed).orderBy("draw").collect()   # draws rows (small)
    d = splits.holdout(prep(spark, sf, F_NETWORK + ["y"]), presets.HOLDOUT, seed, "hash")
    train = splits.kfold(d.where(~F.col("is_test")), presets.FOLDS, seed, "hash", salt="|cv").persist()
    specs = [ModelSpec(f"draw{r['draw']}", "boost", F_NETWORK, {k: r[k] for k in space}, degree=2,
                       strict=False) for r in picked]
    sc = compare_scores(specs, train, parallelism=parallelism, progress=progress)
    board = sc.groupBy("model_order").agg(F.avg("r2").alias("mean_r2")).orderBy(F.col("mean_r2").desc(), "model_order")
    best = board.first()["model_order"]
    m = fit(specs[best], train)
    nodes = tr.node_table(spark, m.members[0], scratch_path(spark, f"boost_search_nodes-{uuid.uuid4().hex}"))
    names = poly_names(F_NETWORK, 2)
    allf = splits.kfold(d, presets.FOLDS, seed, "hash").persist()
    cv = compare_scores([specs[best]], allf).select("fold", "r2")
    train.unpersist()
    allf.unpersist()
    summ = cv.agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2")) \
             .withColumn("status", F.when(F.col("std_r2") < presets.STABILITY_LIMIT, "OK").otherwise("CHECK"))
    return {"search": board, "metrics": metrics(m.transform(d.where("is_test")), "y", "prediction"),
            "gain_importance": tr.gain_importance(nodes, names), "fold_r2": cv, "stability": summ}
