"""Least squares, Ridge and Lasso without a Gram matrix, for any number of
columns.

The matrix of products (p x p) is never formed.  Every step needs ``X'(X v)``
only: tasks expand their rows, multiply them with the broadcast vectors and add
up their part, in one pass over the rows for all systems (training folds) at
once; p numbers per system reach the driver.

* OLS and Ridge: conjugate gradients on columns of unit length (Jacobi), one
  pass an iteration.  From zero, rank-deficient OLS ends at the minimum-norm
  solution in these coordinates, as the Gram solver does.
* Lasso: down the path of penalties with warm starts.  The sequential strong
  rule leaves out columns; accelerated proximal gradient steps with line search
  and restart find support and signs, conjugate gradients solve the support's
  equations exactly, and a pass over all columns checks the optimality (KKT)
  conditions: columns that violate them join and the penalty is solved again.

Objectives and results are those of ``operators.linear``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .linear import LinearFit, NotConverged

CHUNK = 4096            # numbers in a shuffled row
TOL = 1e-12             # relative residual of conjugate gradients
GOOD = 1e-8             # accepted where rounding stops it earlier
BURST = 10              # proximal steps before the support is tried


def sum_vectors(df: DataFrame, read: list[str], partial) -> dict[str, np.ndarray]:
    """Sums over all tasks of the vectors that ``partial(batches)`` returns for
    a task's Arrow batches: a dict of names and 1-d arrays."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def run(batches):
        for name, v in (partial(b for b in batches if len(b)) or {}).items():
            for at in range(0, len(v), CHUNK):
                yield pd.DataFrame({"name": [name], "chunk": [at // CHUNK], "v": [v[at:at + CHUNK]]}).astype({"chunk": "int32"})

    rows = df.select(*read).mapInPandas(run, "name string, chunk int, v array<double>")
    summed = rows.groupBy("name", "chunk").agg(Summarizer.sum(array_to_vector("v")).alias("s")).collect()
    parts: dict[str, dict[int, np.ndarray]] = {}
    for r in summed:
        parts.setdefault(r["name"], {})[r["chunk"]] = r["s"].toArray()
    return {name: np.concatenate([found[c] for c in sorted(found)]) for name, found in parts.items()}


@dataclass(frozen=True)
class Columns:
    """The p columns: products of ``base`` columns (``monomials``: index tuples;
    the base columns themselves if None), or the entries of one array column."""
    base: tuple
    monomials: tuple | None = None
    array: str | None = None
    width: int = 0

    @property
    def p(self) -> int:
        return self.width if self.array else len(self.base if self.monomials is None else self.monomials)

    @property
    def read(self) -> list[str]:
        return [self.array] if self.array else list(self.base)

    def matrix(self, pdf: pd.DataFrame, cols: np.ndarray | None = None) -> np.ndarray:
        if self.array:
            x = np.stack(pdf[self.array].to_numpy()).astype(float)
            return x if cols is None else x[:, cols]
        x = pdf[list(self.base)].to_numpy(dtype=float)
        if self.monomials is None:
            return x if cols is None else x[:, cols]
        terms = self.monomials if cols is None else [self.monomials[j] for j in cols]
        out = np.empty((len(x), len(terms)))
        for j, term in enumerate(terms):
            out[:, j] = x[:, list(term)].prod(axis=1)
        return out


class Systems:
    """The training systems of a frame: one per fold (all other folds train), or
    one of all rows where ``fold`` is None.  The caller persists ``df``."""

    def __init__(self, df: DataFrame, columns: Columns, target: str, fold: str | None = None):
        self.df, self.columns, self.target, self.fold = df, columns, target, fold
        self.passes = 0
        p = columns.p
        read = [*columns.read, target, *([fold] if fold else [])]
        self.read = list(dict.fromkeys(read))

        def sums(batches):
            total = np.zeros(p + 2)
            for pdf in batches:
                total += np.concatenate([[len(pdf)], columns.matrix(pdf).sum(0), [pdf[target].astype(float).sum()]])
            return {"sums": total}

        total = self._sum(sums).get("sums")
        if total is None or not total[0]:
            raise ValueError("no rows")
        self.shift, self.shift_y = total[1:p + 1] / total[0], total[p + 1] / total[0]
        shift, shift_y = self.shift, self.shift_y

        def moments(batches):
            out = {}
            for pdf in batches:
                x, y = columns.matrix(pdf) - shift, pdf[target].to_numpy(float) - shift_y
                for f, rows in (pdf.groupby(fold).indices if fold else {"": slice(None)}).items():
                    a, b = x[rows], y[rows]
                    v = np.concatenate([[len(b), b.sum(), b @ b], a.sum(0), (a * a).sum(0), a.T @ b])
                    out[str(f)] = out[str(f)] + v if str(f) in out else v
            return out

        by = self._sum(moments)
        self.folds = sorted(by, key=lambda f: (len(f), f)) if fold else [None]
        whole = sum(by.values())
        self.held = [by[f] if fold else whole for f in self.folds]
        m = np.array([whole - by[f] if fold else whole for f in self.folds])
        self.n, self.sy, self.syy = m[:, 0], m[:, 1], m[:, 2]
        if not self.n.all():
            raise ValueError("a fold without training rows")
        self.sx, sxx, sxy = (m[:, 3 + i * p:3 + (i + 1) * p].T for i in range(3))     # p x systems
        self.mean = self.sx / self.n
        diag = sxx - self.n * self.mean ** 2
        self.live = diag > 1e-12 * np.maximum(sxx, 0)         # others are constant up to rounding
        self.length = np.where(self.live, np.sqrt(np.maximum(diag, 0)), 1.0)
        self.rhs = np.where(self.live, (sxy - self.mean * self.sy) / self.length, 0.0)

    def _sum(self, partial) -> dict[str, np.ndarray]:
        self.passes += 1
        return sum_vectors(self.df, self.read, partial)

    def product(self, v: np.ndarray, cols: np.ndarray, out_cols: np.ndarray | None = None,
                which: np.ndarray | None = None) -> np.ndarray:
        """``A v`` in unit-length coordinates for the systems ``which`` (all
        unless given); ``v``: entries of ``cols``, zero elsewhere; rows of the
        result are those of ``out_cols`` (``cols`` unless given)."""
        which = np.arange(len(self.folds)) if which is None else which
        same = out_cols is None
        out_cols = cols if same else out_cols
        at, to = np.ix_(cols, which), np.ix_(out_cols, which)
        w = np.where(self.live[at], v / self.length[at], 0.0)
        columns, fold, shift = self.columns, self.fold, self.shift
        left_out = [self.folds[i] for i in which]
        shared = self.df.sparkSession.sparkContext.broadcast(w)

        def partial(batches):
            w, total = shared.value, None
            for pdf in batches:
                a = columns.matrix(pdf, cols) - shift[cols]
                b = a if same else columns.matrix(pdf, out_cols) - shift[out_cols]
                t = a @ w
                if fold:
                    mine = pdf[fold].astype(str).to_numpy()
                    for i, f in enumerate(left_out):
                        t[mine == f, i] = 0.0
                total = b.T @ t if total is None else total + b.T @ t
            return {} if total is None else {"g": total.ravel()}

        g = self._sum(partial)["g"].reshape(len(out_cols), len(which))
        shared.destroy()
        g -= self.n[which] * self.mean[to] * (self.mean[at] * w).sum(0)
        return np.where(self.live[to], g / self.length[to], 0.0)

    def coefficients(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients (p x systems) and intercepts on the original scale."""
        w = np.where(self.live, u / self.length, 0.0)
        a = self.sy / self.n - (self.mean * w).sum(0)
        return w, a + self.shift_y - self.shift @ w

    def scores(self, fits: list[tuple[np.ndarray, np.ndarray]]) -> list[list[dict]]:
        """Per candidate and fold: n, sse, sst, mse, rmse, r2 of the held-out
        rows (all rows without folds), for all candidates in one pass."""
        columns, target, fold, folds = self.columns, self.target, self.fold, self.folds
        w = np.stack([f[0] for f in fits], axis=1)           # p x candidates x systems
        b = np.stack([f[1] for f in fits])
        shared = self.df.sparkSession.sparkContext.broadcast((w, b))

        def partial(batches):
            w, b = shared.value
            total = np.zeros(b.shape)
            for pdf in batches:
                x, y = columns.matrix(pdf), pdf[target].to_numpy(float)
                mine = pdf[fold].astype(str).to_numpy() if fold else None
                for s, f in enumerate(folds):
                    rows = slice(None) if f is None else mine == f
                    total[:, s] += ((y[rows, None] - x[rows] @ w[:, :, s] - b[:, s]) ** 2).sum(0)
            return {"sse": total.ravel()}

        sse = self._sum(partial)["sse"].reshape(b.shape)
        out = []
        for c in range(len(fits)):
            rows = []
            for s, f in enumerate(folds):
                n, sy, syy = self.held[s][:3]
                sst = syy - sy * sy / n
                flat = not sst > 1e-12 * max(syy, 0.0)
                rows.append({"fold": int(f) if f is not None else 0, "n": int(round(n)), "sse": float(sse[c, s]), "sst": float(sst),
                             "mse": float(sse[c, s] / n), "rmse": float(np.sqrt(sse[c, s] / n)), "r2": None if flat else float(1 - sse[c, s] / sst)})
            out.append(rows)
        return out


def conjugate_gradients(product, rhs: np.ndarray, more: np.ndarray | float = 0.0, start: np.ndarray | None = None,
                        tol: float = TOL, most: int = 2000) -> np.ndarray:
    """Solve ``(A + diag(more)) x = rhs`` for each column of ``rhs`` at once.
    ``product``: A times such columns.  A has unit diagonal, so ``1 + more`` is
    the preconditioner."""
    scale = 1.0 + more
    x = np.zeros_like(rhs) if start is None else start.copy()
    r = rhs - (product(x) + more * x) if x.any() else rhs.copy()
    norm = np.linalg.norm(rhs, axis=0)
    norm[norm == 0] = 1.0
    z = r / scale
    d, rz = z.copy(), (r * z).sum(0)
    best, best_x, waited = np.linalg.norm(r, axis=0) / norm, x.copy(), 0
    for _ in range(most):
        if (best <= tol).all():
            return best_x
        q = product(d) + more * d
        dq = (d * q).sum(0)
        step = np.divide(rz, dq, out=np.zeros_like(rz), where=(dq > 0) & (best > tol))
        x += step * d
        r -= step * q
        now = np.linalg.norm(r, axis=0) / norm
        better = now < best
        waited = 0 if (now < 0.5 * best).any() else waited + 1
        best_x[:, better], best[better] = x[:, better], now[better]
        if waited > 25 + rhs.shape[0] // 4 and (best <= GOOD).all():
            return best_x                       # rounding, not the method, ends it
        z = r / scale
        new = (r * z).sum(0)
        d = z + np.divide(new, rz, out=np.zeros_like(rz), where=rz > 0) * d
        rz = new
    if (best <= GOOD).all():
        return best_x
    raise NotConverged(f"conjugate gradients: residual {best.max():.1e} after {most} steps")


def solve_squares(s: Systems, alpha: float = 0.0) -> np.ndarray:
    """OLS (alpha 0) or Ridge of all systems, in unit-length coordinates."""
    every = np.arange(s.columns.p)
    more = np.where(s.live, alpha / s.length ** 2, 0.0)
    return conjugate_gradients(lambda v: s.product(v, every), s.rhs, more)


def solve_lasso_path(s: Systems, alphas: list[float], most_rounds: int = 60) -> dict[float, np.ndarray]:
    """Solutions (p x systems) of every penalty, from the largest down."""
    p, m = s.rhs.shape
    u, gradient = np.zeros((p, m)), -s.rhs                  # A u - rhs
    unit = s.n / s.length                                   # threshold of a penalty of 1
    before = np.where(s.live, np.abs(s.rhs) / unit, 0.0).max(0)     # from here up all are zero
    out = {}
    for alpha in sorted(set(map(float, alphas)), reverse=True):
        limit = alpha * unit
        chosen = s.live & ((np.abs(gradient) >= np.maximum(2 * alpha - before, 0.0) * unit) | (u != 0))
        chosen &= (alpha < before) | (u != 0)               # the strong rule's trivial case
        while chosen.any():
            u = _solve_chosen(s, u, limit, chosen, most_rounds)
            used = np.flatnonzero((u != 0).any(1))
            every = np.arange(p)
            gradient = (s.product(u[used], used, every) if len(used) else np.zeros((p, m))) - s.rhs
            broken = s.live & ~chosen & (np.abs(gradient) > limit * (1 + 1e-9))
            if not broken.any():
                break
            chosen |= broken
        before = np.maximum(np.minimum(before, alpha), 0.0)
        out[alpha] = u.copy()
    return out


def _solve_chosen(s: Systems, u: np.ndarray, limit: np.ndarray, chosen: np.ndarray, most_rounds: int) -> np.ndarray:
    """The Lasso over the chosen columns of each system, others held at zero."""
    cols = np.flatnonzero(chosen.any(1))
    pick, thr, rhs = chosen[cols], limit[cols], s.rhs[cols]
    x = np.where(pick, u[cols], 0.0)
    open_ = np.arange(x.shape[1])                            # systems not solved yet
    product = lambda v, which: np.where(pick[:, which], s.product(v, cols, which=which), 0.0)
    result = x.copy()
    step = np.full(x.shape[1], 1.0)                          # 1 / Lipschitz estimate, one per system
    ax = product(x, open_) if x.any() else np.zeros_like(x)
    burst, before = BURST, np.sign(x)
    for round_ in range(most_rounds):
        # 1. support and signs have settled: exact equations, then the conditions
        w = open_[(np.sign(x[:, open_]) == before[:, open_]).all(0)]
        before = np.sign(x)
        if len(w) and (round_ or x.any()):
            on = x[:, w] != 0
            sign = np.sign(x[:, w])
            target = np.where(on, rhs[:, w] - thr[:, w] * sign, 0.0)
            try:
                exact = conjugate_gradients(lambda v: np.where(on, product(v, w), 0.0), target, np.where(on, 0.0, 1.0), start=np.where(on, x[:, w], 0.0))
            except NotConverged:
                exact = None
            if exact is not None:
                g = product(exact, w) - rhs[:, w]
                fine = ((exact * sign > 0) | ~on).all(0) & ((np.abs(g) <= thr[:, w] * (1 + 1e-9)) | on | ~pick[:, w]).all(0)
                result[:, w[fine]] = exact[:, fine]
                open_ = np.setdiff1d(open_, w[fine])
                if not len(open_):
                    break
        # 2. proximal steps
        x, ax, step = _proximal(product, x, ax, rhs, thr, pick, step, open_, burst)
        burst = min(2 * burst, 400)
    else:
        raise NotConverged(f"Lasso: {len(open_)} systems without a proven solution after {most_rounds} rounds")
    out = np.zeros_like(u)
    out[cols] = result
    return out


def _proximal(product, x, ax, rhs, thr, pick, step, which, steps: int):
    """Accelerated proximal gradient steps of the systems ``which``."""
    x, ax, step = x.copy(), ax.copy(), step.copy()
    a, b, t, live = rhs[:, which], thr[:, which], step[which], pick[:, which]
    now, anow = x[:, which], ax[:, which]
    old, aold, k = now, anow, np.ones(len(which))
    for _ in range(steps):
        k_new = (1 + np.sqrt(1 + 4 * k * k)) / 2
        beta = (k - 1) / k_new
        y, ay = now + beta * (now - old), anow + beta * (anow - aold)
        g = ay - a
        move = y - t * g
        new = np.where(live, np.sign(move) * np.maximum(np.abs(move) - t * b, 0.0), 0.0)
        anew = product(new, which)
        d = new - y
        curve = (d * (anew - ay)).sum(0)                     # d'Ad
        size = (d * d).sum(0)
        steep = curve > size / t * (1 + 1e-12)               # the step was too long
        t = np.where(steep, np.divide(size, curve, out=t.copy(), where=curve > 0) * 0.9, t)
        back = (((y - new) * (new - now)).sum(0) > 0) | steep
        k = np.where(back, 1.0, k_new)
        old, aold = np.where(back, np.where(steep, now, new), now), np.where(back, np.where(steep, anow, anew), anow)
        now, anow = np.where(steep, now, new), np.where(steep, anow, anew)
    x[:, which], ax[:, which], step[which] = now, anow, t
    return x, ax, step


def solve_wide(s: Systems, candidates: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients and intercepts of every candidate (``kind``, ``alpha``)."""
    path = [c["alpha"] for c in candidates if c["kind"] == "lasso"]
    lasso = solve_lasso_path(s, path) if path else {}
    out = []
    for c in candidates:
        if c["kind"] not in ("ols", "ridge", "lasso"):
            raise ValueError(f"unknown linear model {c['kind']!r}")
        u = lasso[float(c["alpha"])] if c["kind"] == "lasso" else solve_squares(s, c["alpha"] if c["kind"] == "ridge" else 0.0)
        out.append(s.coefficients(u))
    return out


def fit_wide(df: DataFrame, columns: Columns, target: str, kind: str = "ols", alpha: float = 0.0,
             names: list[str] | None = None) -> LinearFit:
    """Fit on all rows of ``df``."""
    (w, b), = solve_wide(Systems(df, columns, target), [{"kind": kind, "alpha": alpha}])
    names = names or (list(columns.base) if columns.monomials is None and not columns.array else [f"t{j}" for j in range(columns.p)])
    return LinearFit(names, [float(x) for x in w[:, 0]], float(b[0]), kind, alpha, {"method": "cg"})


def cv_scores_wide(df: DataFrame, columns: Columns, target: str, candidates: list[dict], fold: str = "fold") -> list[dict]:
    """As ``linear.cv_scores``: every candidate on every fold."""
    s = Systems(df, columns, target, fold)
    by = s.scores(solve_wide(s, candidates))
    return [{"candidate": c, **row} for f in range(len(s.folds)) for c, rows in enumerate(by) for row in [rows[f]]]
