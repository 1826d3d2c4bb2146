"""Model specs, fitted pipelines, cross-validation, searches and comparisons.

A ``ModelSpec`` declares preprocessing (scale, polynomial expansion, log
target) and an estimator.  ``fit`` returns a ``Fitted`` whose ``model`` is
a ``PipelineModel`` of built-in stages only: SQL transformers carry the
fitted scaler, the expansion and (for linear models) the coefficients;
Spark ML carries trees.  So a saved model is read back by stock Spark and
scores batches and streams alike.

Linear models fit from one Gram pass.  Cross-validating a linear model
with scaling fitted on all rows (or plain OLS, whose predictions do not
change under any per-fold affine rescaling of its inputs when the
expansion keeps all lower-order terms) takes a single Gram pass for all
folds and candidates; fold-scoped scaling for penalised models takes one
pass per fold.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expand import Standardizer, StandardizerModel, poly_names, poly_sql, poly_terms, qi, spread
from ..session import ensure_checkpoint_dir, path_exists
from . import trees as tr
from .linear import GramSet, LinearFit
from .mlp import identity

LINEAR = ("ols", "ridge", "lasso")
ROWS_PER_TASK = 20_000      # training rows of a learner that passes over them many times
CHAIN_ROUNDS = 100          # rounds of boosting above which a checkpoint folder is asked for


@dataclass
class ModelSpec:
    name: str
    kind: str
    features: list[str]
    params: dict = field(default_factory=dict)
    degree: int = 1
    interaction_only: bool = False
    bias: bool = False
    scale: bool = True
    log_target: bool = False
    members: list = field(default_factory=list)   # voting: list of (kind, params)
    strict: bool = True
    seed: int = 42

    def term_names(self) -> list[str]:
        return poly_names(self.features, self.degree, self.interaction_only, self.bias)

    def n_terms(self) -> int:
        return len(poly_terms(len(self.features), self.degree, self.interaction_only, self.bias))


@dataclass
class Fitted:
    spec: ModelSpec
    model: PipelineModel
    notes: list = field(default_factory=list)
    linear: LinearFit | None = None
    members: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def _prep_stages(spec: ModelSpec, train: DataFrame, scaler: StandardizerModel | None):
    stages = []
    src = list(spec.features)
    if spec.scale and spec.features:
        sc = scaler or Standardizer(spec.features, suffix="__z").fit(train)
        if sc.suffix != "__z":
            sc = StandardizerModel(sc.cols, sc.means, sc.stds, "__z")
        stages.append(sc.stage())
        src = [c + "__z" for c in spec.features]
    items = poly_sql(src, spec.degree, spec.interaction_only, spec.bias, prefix="__f") if src else []
    if items:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__"))
    terms = [f"__f{i}" for i in range(spec.n_terms())] if spec.features else []
    return stages, terms


def _drop_internal(terms: list[str], spec: ModelSpec, extra: list[str] = ()) -> SQLTransformer:
    """Final stage: drop helper columns, keep ``prediction``."""
    drop = list(terms) + ([c + "__z" for c in spec.features] if spec.scale else []) + list(extra)
    if not drop:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(qi(c) for c in drop)}) FROM __THIS__")


def _moments(spec: ModelSpec, df: DataFrame, target: str, scaler: StandardizerModel | None):
    """One aggregation for everything a fit needs before its Gram pass: the
    scaler (unless given), the target mean and raw feature means.  Returns
    the scaler and the shift of ``[terms..., label]`` (degree-1 terms of
    unscaled inputs shift by their mean; scaled terms are O(1) already)."""
    feats = list(spec.features)
    need_scaler = spec.scale and feats and scaler is None
    aggs = [F.avg(_label(spec, target)).alias("__my")]
    for i, c in enumerate(feats):
        aggs.append(F.avg(c).alias(f"__m{i}"))
        if need_scaler:
            aggs.append(spread(c).alias(f"__s{i}"))
    row = df.agg(*aggs).first()
    if need_scaler:
        scaler = StandardizerModel(feats, [row[f"__m{i}"] for i in range(len(feats))],
                                   [row[f"__s{i}"] for i in range(len(feats))], "__z")
    shift = []
    if feats:
        for t in poly_terms(len(feats), spec.degree, spec.interaction_only, spec.bias):
            shift.append(float(row[f"__m{t[0]}"] or 0.0) if (len(t) == 1 and not spec.scale) else 0.0)
    shift.append(float(row["__my"] or 0.0))
    return scaler, shift


def _expansion(spec: ModelSpec) -> dict:
    """The columns that a model's terms are products of, and the products."""
    if spec.degree < 2 or not spec.features:
        return {}
    return {"base": [c + "__z" for c in spec.features] if spec.scale else list(spec.features),
            "monomials": poly_terms(len(spec.features), spec.degree, spec.interaction_only, spec.bias)}


def _label(spec: ModelSpec, target: str):
    y = F.col(target).cast("double")
    return F.log1p(y) if spec.log_target else y


def _learners(spec: ModelSpec) -> list[tuple]:
    return spec.members if spec.kind == "voting" else [(spec.kind, spec.params)]


def member_keys(spec: ModelSpec) -> list[str]:
    """Of each learner of a model, all that its fit on given rows depends on;
    equal keys of two models are one fit."""
    before = [spec.features, spec.degree, spec.interaction_only, spec.bias, spec.scale, spec.log_target]
    return [json.dumps([tr.effective(k, p, spec.strict, spec.seed), *before], sort_keys=True, default=str)
            for k, p in _learners(spec) if k in tr.BUILDERS]


class Members:
    """Fitted learners that several models share, each fitted by the first
    thread that asks for it while others wait."""

    def __init__(self, specs: dict[str, ModelSpec]):
        """``specs``: models by name; keys are taken here, in the caller's thread."""
        from collections import Counter
        from threading import Lock
        self.keys = {name: member_keys(s) for name, s in specs.items()}
        count = Counter(k for keys in self.keys.values() for k in keys)
        self.shared = {k for k, n in count.items() if n > 1}        # others are not held
        self.lock, self.done = Lock(), {}

    def get(self, name: str, i: int, rows, make):
        """Learner ``i`` of the model ``name`` on the given rows."""
        key = self.keys[name][i]
        if key not in self.shared:
            return make()
        with self.lock:
            mine = (key, rows) not in self.done
            found = self.done.setdefault((key, rows), Future())
        if mine:
            try:
                found.set_result(make())
            except BaseException as e:
                found.set_exception(e)
        return found.result()


def _fit_member(est, rows: DataFrame):
    return est.fit(rows)


def deal(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows, over as many tasks as their counted number asks for.  A tree
    learner runs several jobs per level and round, each with a task for every
    partition, however few rows it has; a panel comes out of its joins in
    ``spark.sql.shuffle.partitions`` of them.  Tasks and the order inside them
    follow from the key (without one, from ``columns``), not from the plan."""
    keys = [c for c in ("series", "day") if c in df.columns] or list(columns)
    return df.repartition(max(1, -(-df.count() // ROWS_PER_TASK)), *keys).sortWithinPartitions(*keys)


def fit(spec: ModelSpec, train: DataFrame, target: str = "y",
        scaler: StandardizerModel | None = None, members_of=None, dealt: bool = False) -> Fitted:
    """Fit preprocessing and estimator on ``train``.  ``members_of(i, make)``
    may give a learner that was fitted on the same rows already; ``dealt``:
    the rows went through ``deal``."""
    shift = None
    if spec.kind not in LINEAR and not dealt:
        train = deal(train, [*spec.features, target])
    if spec.kind in LINEAR:
        scaler, shift = _moments(spec, train, target, scaler)
    pre, terms = _prep_stages(spec, train, scaler)
    xt = PipelineModel(pre).transform(train).withColumn("__label", _label(spec, target))
    notes, members = [], []
    if spec.kind in LINEAR:
        lf = GramSet(xt, terms, "__label", by=(), shift=shift, **_expansion(spec)).fit(spec.kind, float(spec.params.get("alpha", 0.0)))
        lf.meta["terms"] = spec.term_names()
        post = [lf.stage("prediction")]
        fitted_linear = lf
    else:
        fitted_linear = None
        asm = VectorAssembler(inputCols=terms, outputCol="__features", handleInvalid="error")
        if spec.kind != "voting" and spec.kind not in tr.BUILDERS:
            raise ValueError(f"unknown model kind {spec.kind!r}")
        kinds, ests = _learners(spec), []
        for i, (kind, params) in enumerate(kinds):
            est, nt = tr.BUILDERS[kind](params, seed=spec.seed, strict=spec.strict, features="__features",
                                        label="__label", prediction=f"__p{i}")
            ests.append(est)
            notes += nt
        if any(kind == "boost" and est.getMaxIter() > CHAIN_ROUNDS for (kind, _), est in zip(kinds, ests)):
            ensure_checkpoint_dir(train.sparkSession)       # without one the rounds' lineage is never cut
        xv = asm.transform(xt)

        def member(i):
            make = lambda: _fit_member(ests[i], xv)
            one = members_of(i, make) if members_of else make()
            return one.copy().setPredictionCol(f"__p{i}")

        # a round of boosting is a chain of small jobs: members run beside one another
        with ThreadPoolExecutor(max_workers=len(ests)) as ex:
            members = list(ex.map(member, range(len(ests))))
        avg = " + ".join(f"__p{i}" for i in range(len(ests)))
        post = [asm] + members + [SQLTransformer(
            statement=f"SELECT *, ({avg}) / {float(len(ests))!r}D AS prediction FROM __THIS__")]
        post.append(SQLTransformer(statement="SELECT * EXCEPT (__features, "
                                   + ", ".join(f"__p{i}" for i in range(len(ests))) + ") FROM __THIS__"))
    if spec.log_target:
        post.append(SQLTransformer(statement="SELECT * EXCEPT (prediction), expm1(prediction) AS prediction FROM __THIS__"))
    post.append(_drop_internal(terms, spec))
    return Fitted(spec, PipelineModel(pre + post), notes, fitted_linear, members)


# --------------------------------------------------------- cross-validation
def _linear_single_pass(spec: ModelSpec, df: DataFrame, target: str, fold: str,
                        scaler: StandardizerModel | None) -> DataFrame:
    """All folds of a linear model from one Gram pass (global scaling)."""
    sc, shift = _moments(spec, df, target, scaler)
    pre, terms = _prep_stages(spec, df, sc)
    xt = PipelineModel(pre).transform(df).withColumn("__label", _label(spec, target))
    gs = GramSet(xt, terms, "__label", by=(fold,), shift=shift, **_expansion(spec))
    pred = None
    for (f,) in sorted(gs.mats):
        lf = gs.fit(spec.kind, float(spec.params.get("alpha", 0.0)), keep=lambda k, f=f: k[0] != f)
        e = lf.prediction()
        pred = F.when(F.col(fold) == f, e) if pred is None else pred.when(F.col(fold) == f, e)
    if spec.log_target:
        pred = F.expm1(pred)
    return xt.withColumn("prediction", pred).drop(*terms, "__label",
                                                  *([c + "__z" for c in spec.features] if spec.scale and spec.features else []))


def _single_pass_ok(spec: ModelSpec, scale_scope: str) -> bool:
    return spec.kind in LINEAR and (scale_scope == "global" or spec.kind == "ols" or not spec.scale)


def fold_scalers(df: DataFrame, features: list[str], fold: str) -> dict:
    """The scaler of every fold's training rows (all other folds), from one
    aggregation by fold: counts, means and variances of groups add up."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
    rows = df.groupBy(fold).agg(*aggs).collect()         # one row per fold
    out = {}
    for f in sorted(r[fold] for r in rows):
        rest = [r for r in rows if r[fold] != f]
        means, stds = [], []
        for i in range(len(features)):
            n = sum(r["n"] for r in rest)
            mean = sum(r["n"] * r[f"m{i}"] for r in rest) / n if n else 0.0
            var = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rest) / n if n else 0.0
            flat = not rest or min(r[f"a{i}"] for r in rest) == max(r[f"b{i}"] for r in rest)
            means.append(float(mean))
            stds.append(0.0 if flat else float(var) ** 0.5)
        out[f] = StandardizerModel(features, means, stds, "__z")
    return out


def fit_key(spec: ModelSpec) -> str:
    """Hash of all that a fit depends on besides its rows.  Settings that come
    to the same Spark model have the same key."""
    learners = [tr.effective(k, p, spec.strict, spec.seed) if k in tr.BUILDERS else [k, p] for k, p in _learners(spec)]
    what = [spec.kind, learners, spec.features, spec.degree, spec.interaction_only, spec.bias, spec.scale, spec.log_target, spec.seed]
    return hashlib.sha1(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


class _Folds:
    """Fits of (setting, fold), each distinct one once, on a pool of threads;
    a learner that several models have in common is fitted once per fold.
    With ``progress`` (a folder on shared storage) results are written there
    under a hash of the setting, the rows and the fold rule, and a rerun reads
    those; other settings or rows have other folders."""

    def __init__(self, df, target, fold, scale_scope, progress, what, columns=()):
        self.df = deal(df, [*columns, target, fold]).persist()      # passed over once for each level, round and fit
        self.target, self.fold, self.scope, self.progress = target, fold, scale_scope, progress
        self.folds = sorted(r[0] for r in self.df.select(fold).distinct().collect())   # k values
        self.scalers: dict = {}
        self.members = None
        self.rows = identity(self.df, target, fold, scale_scope, what) if progress else None

    def prepare(self, spec: ModelSpec) -> None:
        key = tuple(spec.features)
        if not (spec.scale and spec.features) or key in self.scalers:
            return
        if self.scope == "global":
            one = Standardizer(spec.features, "__z").fit(self.df)
            self.scalers[key] = {f: one for f in self.folds}
        else:
            self.scalers[key] = fold_scalers(self.df, list(spec.features), self.fold)

    def run(self, spec: ModelSpec, key: str, f, result) -> DataFrame:
        spark = self.df.sparkSession
        path = f"{self.progress.rstrip('/')}/{key}-{self.rows}/fold={f}" if self.progress else None
        if path and path_exists(spark, path):
            return spark.read.parquet(path)
        sc = self.scalers[tuple(spec.features)][f] if spec.scale and spec.features else None
        share = (lambda i, make: self.members.get(key, i, f, make)) if self.members else None
        m = fit(spec, self.df.where(F.col(self.fold) != f), self.target, sc, share, dealt=True)
        out = result(m.transform(self.df.where(F.col(self.fold) == f)))
        if path:
            out.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)
        return out

    def all(self, specs: list[ModelSpec], parallelism: int, result, read=lambda out: out) -> dict:
        """(key, fold) -> read(result(predictions)) of the distinct settings;
        ``result`` is what ``progress`` keeps, ``read`` runs in the pool's threads."""
        todo = {}
        for s in specs:
            self.prepare(s)
            todo.setdefault(fit_key(s), s)
        self.members = Members(todo)
        jobs = [(k, f) for k in todo for f in self.folds]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            return dict(zip(jobs, ex.map(lambda j: read(self.run(todo[j[0]], *j, result)), jobs)))


def _inputs(specs: list[ModelSpec]) -> list[str]:
    return list(dict.fromkeys(c for s in specs for c in s.features))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(spec: ModelSpec, df: DataFrame, target: str = "y", fold: str = "fold",
                   scale_scope: str = "fold", parallelism: int = 2,
                   keep: tuple = ("series", "day")) -> DataFrame:
    """Out-of-fold predictions ``(keep..., fold, y, prediction)``: fold ``k``
    is predicted by a model fitted on the other folds only."""
    cols = [c for c in keep if c in df.columns] + [fold, target]
    if _single_pass_ok(spec, scale_scope):
        return _linear_single_pass(spec, df, target, fold, None).select(*cols, "prediction")
    pool = _Folds(df, target, fold, scale_scope, None, "predictions", spec.features)
    return _union(list(pool.all([spec], parallelism, lambda p: p.select(*cols, "prediction")).values()))


def compare(specs: list[ModelSpec], df: DataFrame, target: str = "y", fold: str = "fold",
            scale_scope: str = "fold", parallelism: int = 2, keep: tuple = ("series", "day"),
            progress: str | None = None) -> DataFrame:
    """Out-of-fold predictions of a few models on the same folds, with
    ``model`` and ``model_order`` (declaration order) columns.  Every distinct
    (setting, fold) is fitted once, on one pool of ``parallelism`` concurrent
    Spark jobs; linear models take their single Gram pass.  ``progress``:
    shared folder where finished predictions are kept, so a long comparison
    resumes after a failure.  For searches over many candidates use
    ``compare_scores``, which keeps one row of metrics per fit."""
    cols = [c for c in keep if c in df.columns] + [fold, target]
    learned = [s for s in specs if not _single_pass_ok(s, scale_scope)]
    pool = _Folds(df, target, fold, scale_scope, progress, ["predictions", cols], _inputs(learned)) if learned else None
    done = pool.all(learned, parallelism, lambda p: p.select(*cols, "prediction")) if learned else {}
    out = None
    for i, s in enumerate(specs):
        if _single_pass_ok(s, scale_scope):
            p = _linear_single_pass(s, df, target, fold, None).select(*cols, "prediction")
        else:
            p = _union([done[fit_key(s), f] for f in pool.folds])
        p = p.withColumn("model", F.lit(s.name)).withColumn("model_order", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def compare_scores(specs: list[ModelSpec], df: DataFrame, target: str = "y", fold: str = "fold",
                   scale_scope: str = "fold", parallelism: int = 2, progress: str | None = None,
                   log: bool = False) -> DataFrame:
    """n, MAE, MSE, RMSE and R2 by model and fold, for searches: each fit is
    scored at once to one row, so no plan holds more than one fit.  ``log``
    scores log1p of truth and prediction."""
    from ..functions.metrics import metrics

    def score(p: DataFrame) -> DataFrame:
        if log:
            p = p.withColumn(target, F.log1p(F.col(target).cast("double"))).withColumn("prediction", F.log1p("prediction"))
        return metrics(p, target, "prediction")

    learned = [s for s in specs if not _single_pass_ok(s, scale_scope)]
    pool = _Folds(df, target, fold, scale_scope, progress, ["scores", log], _inputs(learned)) if learned else None
    names = ("n", "mae", "mse", "rmse", "r2")

    def linear(s: ModelSpec) -> dict:
        p = _linear_single_pass(s, pool.df if pool else df, target, fold, None)
        if log:
            p = p.withColumn(target, F.log1p(F.col(target).cast("double"))).withColumn("prediction", F.log1p("prediction"))
        return {r[fold]: r.asDict() for r in metrics(p, target, "prediction", [fold]).collect()}

    with ThreadPoolExecutor(max_workers=1) as ex:       # the single passes, beside the fits
        single = {i: ex.submit(linear, s) for i, s in enumerate(specs) if _single_pass_ok(s, scale_scope)}
        done = pool.all(learned, parallelism, score, lambda p: p.first().asDict()) if learned else {}
    rows = []
    for i, s in enumerate(specs):
        found = single[i].result() if i in single else {f: done[fit_key(s), f] for f in pool.folds}
        rows += [(s.name, i, int(f), *(m[n] for n in names)) for f, m in sorted(found.items())]
    if pool:
        pool.df.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model string, model_order int, fold int, n long, mae double, mse double, rmse double, r2 double")


def fold_scores(pred: DataFrame, target: str = "y", by=("model", "model_order", "fold")) -> DataFrame:
    from ..functions.metrics import metrics
    return metrics(pred, target, "prediction", list(by))
