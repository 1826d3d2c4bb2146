"""Principal components of standardised columns.

``pca``: the correlation matrix comes from one Gram pass (p x p, no folds); its
eigen-decomposition runs on the driver; scores are column expressions.
``pca_subspace``: the first k components of any number of columns by randomised
subspace iteration; p x k numbers reach the driver, never p x p, and a
tree-reduced QR gives the singular values without squaring them.
Signs are fixed so that the largest absolute loading of each component
is positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .moments import fold_gram, gram_matrices


@dataclass
class PCAModel:
    cols: list[str]
    means: np.ndarray
    stds: np.ndarray
    components: np.ndarray   # k x p, rows are components
    eigenvalues: np.ndarray
    total: float
    residuals: np.ndarray | None = None      # |R v - lambda v| of each component, where measured
    passes: int = 0                          # over the rows

    @property
    def ratio(self) -> np.ndarray:
        return self.eigenvalues / self.total

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        z = [(F.col(c) - F.lit(float(self.means[i]))) / F.lit(float(self.stds[i] or 1.0))
             for i, c in enumerate(self.cols)]
        new = {}
        for k, v in enumerate(self.components):
            e = F.lit(0.0)
            for zi, w in zip(z, v):
                e = e + zi * F.lit(float(w))
            new[f"{prefix}{k + 1}"] = e
        return df.withColumns(new)

    def loadings(self, spark: SparkSession, names: dict | None = None) -> DataFrame:
        names = names or {}
        rows = [(names.get(c, c), f"PC{k + 1}", k + 1, float(self.components[k, i]))
                for i, c in enumerate(self.cols) for k in range(len(self.components))]
        return spark.createDataFrame(rows, "variable string, component string, component_no int, loading double")

    def explained(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, float(r), float(self.eigenvalues[k])) for k, r in enumerate(self.ratio)]
        return spark.createDataFrame(rows, "component int, ratio double, eigenvalue double")


def _fix_signs(vecs: np.ndarray) -> np.ndarray:
    """Rows with their largest absolute entry made positive."""
    big = vecs[np.arange(len(vecs)), np.abs(vecs).argmax(1)] if len(vecs) else np.zeros(0)
    return vecs * np.where(big < 0, -1.0, 1.0)[:, None]


def pca(df: DataFrame, cols: list[str], k: int | None = None) -> PCAModel:
    """Fit on all rows of ``df`` (nulls must be dropped first)."""
    from .moments import column_means
    cols = list(cols)
    shift = np.asarray(column_means(df, cols))
    # Gram of [1, cols[:-1], cols[-1]]: the last column plays the "target" slot
    g = gram_matrices(fold_gram(df, cols[:-1], cols[-1], by=(), shift=list(shift)), by=())[()]
    n = g[0, 0]
    q = g.shape[0]
    S = g[1:, 1:]                      # all p columns, shifted sums
    s = g[0, 1:]
    m = s / n
    C = (S - n * np.outer(m, m)) / n   # population covariance (shifted scale)
    means = shift + m
    stds = np.sqrt(np.clip(np.diag(C), 0, None))
    spread = np.diag(C) > 1e-12 * np.diag(S) / n     # else rounding is all there is
    stds = np.where(spread, stds, 0.0)
    C[~spread] = C[:, ~spread] = 0.0
    d = np.where(spread, stds, 1.0)
    R = C / np.outer(d, d)
    vals, vecs = np.linalg.eigh(R)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], _fix_signs(vecs[:, order].T)
    vals = np.clip(vals, 0, None)
    k = k or len(cols)
    return PCAModel(cols, means, stds, vecs[:k], vals[:k], float(vals.sum()))


QR_FAN = 16             # triangles that one group of the tree takes
OVERSAMPLE = 10


def tree_qr(rows: DataFrame, width: int) -> np.ndarray:
    """R factor (width x width) of a tall matrix whose tasks gave a triangle
    each: (leaf, r), r row by row.  Groups of ``QR_FAN`` triangles are stacked
    and factored on the executors, level by level, until one is left."""
    import pandas as pd

    def merge(t: pd.DataFrame) -> pd.DataFrame:
        stacked = np.concatenate([np.asarray(r).reshape(-1, width) for r in t.sort_values("leaf")["r"]])
        return pd.DataFrame({"leaf": [int(t["node"].iloc[0])], "r": [np.linalg.qr(stacked, mode="r").ravel()]})

    # leaves are numbered by their task, so that the tree's shape is known beforehand
    count = rows.rdd.getNumPartitions()
    while count > 1:
        rows = (rows.withColumn("node", F.floor(F.col("leaf") / QR_FAN).cast("int")).groupBy("node")
                .applyInPandas(merge, "leaf int, r array<double>"))
        count = -(-count // QR_FAN)
    found = rows.collect()
    return np.linalg.qr(np.concatenate([np.asarray(r["r"]).reshape(-1, width) for r in found]), mode="r")


def pca_subspace(df: DataFrame, columns, k: int, tol: float = 1e-8, most: int = 200, seed: int = 42) -> PCAModel:
    """The first ``k`` components of standardised ``columns`` (a list of names or
    ``wide.Columns``); no nulls, and the caller persists ``df``.

    A random p x l basis (l = k + ``OVERSAMPLE``, at most p) is multiplied with
    the correlation matrix, one pass over the rows each time, until no
    component's residual ``|R v - lambda v|`` exceeds ``tol`` times the largest
    eigenvalue; the last pass takes the tree-reduced QR of the rows in the final
    basis.  Raises ``NotConverged`` after ``most`` passes."""
    import pandas as pd

    from .linear import NotConverged
    from .wide import Columns, sum_vectors
    columns = columns if isinstance(columns, Columns) else Columns(tuple(columns))
    p = columns.p
    if not 1 <= k <= p:
        raise ValueError(f"k must lie between 1 and {p}")
    width = min(p, k + OVERSAMPLE)

    def sums(batches):
        total = np.zeros(p + 1)
        for pdf in batches:
            total += np.append(columns.matrix(pdf).sum(0), len(pdf))
        return {"s": total}

    s = sum_vectors(df, columns.read, sums).get("s")
    if s is None or not s[-1]:
        raise ValueError("no rows")
    n, shift = s[-1], s[:-1] / s[-1]

    def squares(batches):
        total = np.zeros(2 * p)
        for pdf in batches:
            x = columns.matrix(pdf) - shift
            total += np.concatenate([x.sum(0), (x * x).sum(0)])
        return {"s": total}

    s = sum_vectors(df, columns.read, squares)["s"]
    mean = s[:p] / n
    var = s[p:] / n - mean ** 2
    spread = var > 1e-12 * s[p:] / n
    stds = np.where(spread, np.sqrt(np.maximum(var, 0)), 0.0)
    means, unit = shift + mean, np.where(spread, stds, 1.0)
    share = lambda x: df.sparkSession.sparkContext.broadcast(x)

    def times(basis: np.ndarray) -> np.ndarray:
        shared = share(np.where(spread[:, None], basis / unit[:, None], 0.0))

        def partial(batches):
            total = None
            for pdf in batches:
                x = columns.matrix(pdf) - means
                part = x.T @ (x @ shared.value)
                total = part if total is None else total + part
            return {} if total is None else {"g": total.ravel()}

        g = sum_vectors(df, columns.read, partial)["g"].reshape(p, -1)
        shared.destroy()
        return np.where(spread[:, None], g / unit[:, None], 0.0) / n

    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((p, width)))
    for passes in range(3, most + 1):
        image = times(basis)
        vals, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        order = np.argsort(vals)[::-1]
        vals, inner = vals[order], inner[:, order]
        vecs, moved = basis @ inner, image @ inner
        residuals = np.linalg.norm(moved - vecs * vals, axis=0)[:k]
        if (residuals <= tol * max(vals[0], 1e-300)).all():
            break
        basis, _ = np.linalg.qr(image)
    else:
        raise NotConverged(f"subspace iteration: residual {residuals.max():.1e} after {most} passes")

    # Rayleigh-Ritz on the rows themselves: singular values of Z V by TSQR
    shared = share(np.where(spread[:, None], vecs / unit[:, None], 0.0))

    def triangles(batches):
        from pyspark import TaskContext
        r = np.zeros((0, width))
        for pdf in batches:
            if len(pdf):
                r = np.linalg.qr(np.concatenate([r, (columns.matrix(pdf) - means) @ shared.value]), mode="r")
        yield pd.DataFrame({"leaf": [TaskContext.get().partitionId()], "r": [r.ravel()]}).astype({"leaf": "int32"})

    r = tree_qr(df.select(*columns.read).mapInPandas(triangles, "leaf int, r array<double>"), width)
    shared.destroy()
    _, sigma, turn = np.linalg.svd(r)
    vals = np.zeros(width)
    vals[:len(sigma)] = sigma ** 2 / n
    vecs = _fix_signs((vecs @ turn.T).T)
    names = list(columns.base) if columns.monomials is None and not columns.array else [f"t{j}" for j in range(p)]
    return PCAModel(names, means, stds, vecs[:k], vals[:k], float(spread.sum()), residuals, passes + 1)
