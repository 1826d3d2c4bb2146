"""Least squares, Ridge and Lasso from Gram matrices.

One ``fold_gram`` pass gives a small matrix per fold; every (fold,
candidate) fit is then a p x p solve on the driver and every fold score
comes from the held-out fold's own matrix (SSE and SST are quadratic
forms), so a whole search over folds and penalties costs one pass over
the rows.  ``table_scores`` and ``table_nested`` keep the Gram blocks as a table
and solve on the executors instead, one task per training set and penalty path.
Objectives follow the common conventions:

* OLS:   min ||y - b - Xw||^2 (minimum-norm ``w`` if X is rank-deficient)
* Ridge: min ||y - b - Xw||^2 + alpha ||w||^2          (intercept free)
* Lasso: min 1/(2n) ||y - b - Xw||^2 + alpha ||w||_1   (intercept free)
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expand import qi, sql_double
from .moments import Stats, fold_gram, gram_matrices, sum_groups

# The penalty grid of the reference's linear study: ten values spaced
# evenly in log scale from 1e-3 to 1e3 (fixed values).
REFERENCE_ALPHAS = [float(a) for a in np.logspace(-3, 3, 10)]


def _ridge_solve(C: np.ndarray, c: np.ndarray, alpha: float) -> np.ndarray:
    p = C.shape[0]
    if p == 0:
        return np.zeros(0)
    if alpha == 0:
        d = np.sqrt(np.diag(C))
        d[d == 0] = 1.0
        v, *_ = np.linalg.lstsq(C / np.outer(d, d), c / d, rcond=None)
        return v / d
    return np.linalg.solve(C + alpha * np.eye(p), c)


def _lasso_cd(C: np.ndarray, c: np.ndarray, n: float, alpha: float,
              tol: float = 1e-12, max_sweeps: int = 100000, w0=None) -> np.ndarray:
    """Coordinate descent on the Gram form of the Lasso objective."""
    G = C / n
    b = c / n
    p = G.shape[0]
    w = np.zeros(p) if w0 is None else w0.copy()
    diag = np.diag(G).copy()
    r = b - G @ w
    scale = max(np.sqrt(np.abs(diag)).max(initial=0.0), 1e-300)
    for _ in range(max_sweeps):
        dmax = 0.0
        for j in range(p):
            if diag[j] <= 0:
                if w[j] != 0:
                    r += G[:, j] * w[j]
                    w[j] = 0.0
                continue
            t = r[j] + diag[j] * w[j]
            nw = np.sign(t) * max(abs(t) - alpha, 0.0) / diag[j]
            d = nw - w[j]
            if d != 0.0:
                r -= G[:, j] * d
                w[j] = nw
                dmax = max(dmax, abs(d) * np.sqrt(diag[j]))
        if dmax <= tol * scale * (1.0 + np.abs(w).max(initial=0.0)):
            return w
    raise NotConverged(f"Lasso did not converge in {max_sweeps} sweeps (alpha={alpha})")


class NotConverged(RuntimeError):
    pass


def solve(s: Stats, kind: str, alpha: float = 0.0, w0=None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the shifted scale of ``s``."""
    if kind == "ols":
        w = _ridge_solve(s.Cxx, s.Cxy, 0.0)
    elif kind == "ridge":
        w = _ridge_solve(s.Cxx, s.Cxy, alpha)
    elif kind == "lasso":
        w = _lasso_cd(s.Cxx, s.Cxy, s.n, alpha, w0=w0)
    else:
        raise ValueError(f"unknown linear model {kind!r}")
    return w, float(s.my - s.mx @ w)


def fold_score(test: Stats, w: np.ndarray, a: float) -> dict:
    sse = float(test.sse(w, a))
    sst = float(test.Cyy)
    n = float(test.n)
    return {"n": int(round(n)), "sse": sse, "sst": sst,
            "mse": sse / n if n else None,
            "rmse": float(np.sqrt(max(sse, 0.0) / n)) if n else None,
            "r2": (1.0 - sse / sst) if not test.constant_y() else None}


@dataclass
class LinearFit:
    """A fitted linear model on named feature columns."""
    features: list[str]
    coef: list[float]
    intercept: float
    kind: str = "ols"
    alpha: float = 0.0
    meta: dict = field(default_factory=dict)

    def prediction(self) -> Column:
        e = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            e = e + F.col(c) * F.lit(float(w))
        return e

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.prediction())

    def sql(self, out: str = "prediction") -> str:
        terms = [sql_double(self.intercept)] + [f"{qi(c)} * {sql_double(w)}" for c, w in zip(self.features, self.coef)]
        return f"{' + '.join(terms)} AS {qi(out)}"

    def stage(self, out: str = "prediction"):
        from pyspark.ml.feature import SQLTransformer
        return SQLTransformer(statement=f"SELECT *, {self.sql(out)} FROM __THIS__")

    def coef_rows(self, names: list[str] | None = None) -> list[tuple]:
        names = names or self.features
        return [(n, float(w)) for n, w in zip(names, self.coef)]


def unshift(w: np.ndarray, a: float, shift: list[float]) -> float:
    """Intercept on the original scale from one on the shifted scale."""
    sx = np.asarray(shift[:-1])
    return float(a + shift[-1] - sx @ w)


class GramSet:
    """Gram matrices of a frame by group, with the shift they were taken at."""

    def __init__(self, df: DataFrame, features: list[str], target: str,
                 by: list[str] | tuple = ("fold",), shift: list[float] | None = None,
                 base: list[str] | None = None, monomials: list[tuple] | None = None):
        """``base`` and ``monomials``: ``features`` are these products of the
        base columns, which then are all that wide passes read."""
        from .moments import column_means
        self.features, self.target, self.by = list(features), target, list(by)
        self.shift = shift if shift is not None else column_means(df, self.features + [target])
        self.mats = gram_matrices(fold_gram(df, self.features, target, self.by, self.shift, base=base, monomials=monomials), self.by)

    def stats(self, keep=lambda k: True) -> Stats:
        return Stats(sum_groups(self.mats, keep))

    def fit(self, kind: str, alpha: float = 0.0, keep=lambda k: True) -> LinearFit:
        s = self.stats(keep)
        w, a = solve(s, kind, alpha)
        return LinearFit(self.features, [float(x) for x in w], unshift(w, a, self.shift), kind, alpha)

    def keys(self, pos: int = 0) -> list:
        return sorted({k[pos] for k in self.mats})


def fit_linear(df: DataFrame, features: list[str], target: str, kind: str = "ols",
               alpha: float = 0.0) -> LinearFit:
    """Fit on all rows of ``df`` (one Gram pass)."""
    return GramSet(df, features, target, by=()).fit(kind, alpha)


def cv_scores(gs: GramSet, candidates: list[dict], fold_pos: int = 0,
              within=lambda k: True) -> list[dict]:
    """Score every candidate (``{'kind', 'alpha'}``) on every fold among
    the groups kept by ``within``; fold ``f`` trains on the others."""
    folds = sorted({k[fold_pos] for k in gs.mats if within(k)})
    out = []
    for f in folds:
        train = gs.stats(lambda k: within(k) and k[fold_pos] != f)
        test = gs.stats(lambda k: within(k) and k[fold_pos] == f)
        w_prev = None
        for ci, cand in enumerate(candidates):
            w, a = solve(train, cand["kind"], cand.get("alpha", 0.0), w0=w_prev if cand["kind"] == "lasso" else None)
            w_prev = w if cand["kind"] == "lasso" else None
            sc = fold_score(test, w, a)
            out.append({"candidate": ci, "fold": int(f), **sc})
    return out


def best_of(scores: list[dict], n_candidates: int, metric: str = "r2") -> tuple[int, float]:
    """Best mean score over folds, larger is better; the first candidate
    wins a tie.  ``metric`` is ``r2`` or ``neg_rmse``."""
    best, best_v = -1, -np.inf
    for ci in range(n_candidates):
        vals = [(s["r2"] if metric == "r2" else -s["rmse"]) for s in scores if s["candidate"] == ci]
        vals = [v for v in vals if v is not None]
        if not vals:
            continue
        m = float(np.mean(vals))
        if m > best_v:  # strictly better: the first candidate keeps a tie
            best, best_v = ci, m
    return best, best_v


def linear_candidates(kind: str, alphas: list[float] | None = None) -> list[dict]:
    if kind == "ols":
        return [{"kind": "ols", "alpha": 0.0}]
    return [{"kind": kind, "alpha": float(a)} for a in (alphas or REFERENCE_ALPHAS)]


def nested_cv(gs: GramSet, kind: str, alphas: list[float] | None = None,
              metric: str = "r2") -> list[dict]:
    """Search ``alpha`` again inside every outer training fold (inner folds
    from the same pass: groups are ``(fold, inner)``), refit the winner on
    the outer training rows, score the outer fold."""
    cands = linear_candidates(kind, alphas)
    out = []
    for f in gs.keys(0):
        inner = cv_scores(gs, cands, fold_pos=1, within=lambda k, f=f: k[0] != f)
        ci, inner_best = best_of(inner, len(cands), metric)
        train = gs.stats(lambda k: k[0] != f)
        test = gs.stats(lambda k: k[0] == f)
        w, a = solve(train, kind, cands[ci]["alpha"])
        sc = fold_score(test, w, a)
        model = LinearFit(gs.features, [float(x) for x in w], unshift(w, a, gs.shift), kind, cands[ci]["alpha"])
        out.append({"fold": int(f), "alpha": cands[ci]["alpha"], "inner_score": inner_best, "model": model, **sc})
    return out


def nested_metrics(df: DataFrame, nested: list[dict], target: str = "y", fold: str = "fold") -> DataFrame:
    """n, MAE, MSE, RMSE and R2 of every outer fold, from one row pass: each
    row is predicted by the model of its own outer fold's search."""
    from ..functions.metrics import metrics
    pred = None
    for r in nested:
        e = r["model"].prediction()
        pred = F.when(F.col(fold) == r["fold"], e) if pred is None else pred.when(F.col(fold) == r["fold"], e)
    return metrics(df.withColumn("prediction", pred), target, "prediction", [fold])


def lasso_selection(fit: LinearFit, names: list[str] | None = None) -> list[tuple[str, bool]]:
    """Features kept (coefficient != 0) and eliminated (== 0)."""
    names = names or fit.features
    return [(n, w != 0.0) for n, w in zip(names, fit.coef)]


def nested_cv_blocks(df: DataFrame, features: list[str], target: str, kind: str,
                     alphas: list[float] | None = None, k_inner: int = 5, fold: str = "fold",
                     metric: str = "r2") -> list[dict]:
    """Nested search whose inner folds are contiguous chronological blocks
    of each outer training set (so they depend on the outer fold).  One Gram
    pass by outer fold gives every held-out fold's matrix; each outer fold
    then takes one pass for its inner blocks (cut search + Gram)."""
    from . import splits
    from .moments import column_means
    cands = linear_candidates(kind, alphas)
    shift = column_means(df, list(features) + [target])
    outer = GramSet(df, features, target, by=(fold,), shift=shift)
    out = []
    for f in outer.keys(0):
        tr = splits.kfold(df.where(F.col(fold) != f), k_inner, mode="blocks", out="__inner")
        inner = GramSet(tr, features, target, by=("__inner",), shift=shift)
        ci, inner_best = best_of(cv_scores(inner, cands), len(cands), metric)
        w, a = solve(inner.stats(), kind, cands[ci]["alpha"])          # all inner blocks = outer training rows
        sc = fold_score(outer.stats(lambda k, f=f: k[0] == f), w, a)
        model = LinearFit(outer.features, [float(x) for x in w], unshift(w, a, shift), kind, cands[ci]["alpha"])
        out.append({"fold": int(f), "alpha": cands[ci]["alpha"], "inner_score": inner_best, "model": model, **sc})
    return out


# ------------------------------------------------- solves on the executors
SCORES = "candidate int, n long, sse double, sst double, mse double, rmse double, r2 double"


def gram_table(df: DataFrame, features: list[str], target: str, by: list[str], path: str, **expansion) -> tuple[DataFrame, list[float]]:
    """Gram blocks (by..., block, s) written to ``path`` on shared storage, and
    the shift they were taken at."""
    from .moments import column_means
    shift = column_means(df, [*features, target])
    summed, _ = fold_gram(df, features, target, by, shift, method="arrow", **expansion)._packed
    summed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), shift


def _per_job(blocks: DataFrame, jobs: Column) -> DataFrame:
    """``jobs``: for a block's row, an array of (job, role) it belongs to; sums
    of blocks per job and role ('train' or 'test')."""
    from .moments import BLOCK
    rows = blocks.withColumn("j", F.explode(jobs)).select("j.job", "j.role", "block", "s").where("role is not null")
    return rows.groupBy("job", "role", "block").agg(F.array(*[F.sum(F.col("s")[t]) for t in range(BLOCK)]).alias("s"))


def _solve_jobs(parts: DataFrame, q: int, candidates: list[dict], out: str = SCORES) -> DataFrame:
    """One task per job: the path of candidates with warm starts on its training
    matrix, scored on its test matrix; only scores leave the task."""
    import pandas as pd

    def matrix(t: pd.DataFrame) -> np.ndarray:
        iu, m = np.triu_indices(q), np.zeros((q, q))
        flat = np.concatenate([np.asarray(s) for s in t.sort_values("block")["s"]])[:len(iu[0])]
        m[iu] = flat
        return m + m.T - np.diag(np.diag(m))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        job = t["job"].iloc[0]
        sides = {r: matrix(p) for r, p in t.groupby("role")}
        rows = []
        if len(sides) == 2:
            train, test, before = Stats(sides["train"]), Stats(sides["test"]), None
            only = int(t["only"].iloc[0]) if "only" in t else -1
            for i, c in enumerate(candidates):
                if only not in (-1, i):
                    continue
                lasso = c["kind"] == "lasso"
                w, a = solve(train, c["kind"], c.get("alpha", 0.0), w0=before if lasso else None)
                before = w if lasso else None
                rows.append((job, i, *fold_score(test, w, a).values()))
        return pd.DataFrame(rows, columns=["job", "candidate", "n", "sse", "sst", "mse", "rmse", "r2"])

    return parts.groupBy("job").applyInPandas(run, "job string, " + out)


def table_scores(blocks: DataFrame, q: int, candidates: list[dict], fold: str = "fold") -> DataFrame:
    """``cv_scores`` from a table of Gram blocks: fold, candidate and scores."""
    folds = [r[0] for r in blocks.select(fold).distinct().orderBy(fold).collect()]       # k values
    jobs = F.array(*[F.struct(F.lit(str(f)).alias("job"), F.when(F.col(fold) == f, "test").otherwise("train").alias("role")) for f in folds])
    return _solve_jobs(_per_job(blocks, jobs), q, candidates).select(F.col("job").cast("int").alias("fold"), *[c.split()[0] for c in SCORES.split(", ")])


def table_nested(blocks: DataFrame, q: int, candidates: list[dict], outer: str = "fold", inner: str = "inner") -> DataFrame:
    """``nested_cv`` (R2) from blocks keyed by (outer, inner): a task for each
    inner training set's path, the first best mean per outer fold, and a task for
    each outer refit: fold, candidate (the winner), inner_score and scores."""
    from pyspark.sql import Window
    o, i = F.col(outer), F.col(inner)
    folds = [r[0] for r in blocks.select(outer).distinct().orderBy(outer).collect()]     # k values
    inners = [r[0] for r in blocks.select(inner).distinct().orderBy(inner).collect()]
    role = lambda f, g: F.when(o != f, F.when(i == g, "test").otherwise("train"))
    jobs = F.array(*[F.struct(F.lit(f"{f}/{g}").alias("job"), role(f, g).alias("role")) for f in folds for g in inners])
    searched = _solve_jobs(_per_job(blocks, jobs), q, candidates)
    mean = searched.groupBy(F.substring_index("job", "/", 1).alias("job"), "candidate").agg(F.avg("r2").alias("inner_score"))
    first = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("inner_score"), "candidate"))
    best = mean.withColumn("rn", first).where("rn = 1").select("job", F.col("candidate").alias("only"), "inner_score")
    jobs = F.array(*[F.struct(F.lit(str(f)).alias("job"), F.when(o == f, "test").otherwise("train").alias("role")) for f in folds])
    refit = _solve_jobs(_per_job(blocks, jobs).join(best.select("job", "only"), "job"), q, candidates)
    return refit.join(best.select("job", "inner_score"), "job").select(
        F.col("job").cast("int").alias("fold"), "candidate", "inner_score", *[c.split()[0] for c in SCORES.split(", ")[1:]])
