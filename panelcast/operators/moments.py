"""Moments and per-fold Gram matrices: the one pass linear models need.

``fold_gram`` computes, for every group (fold, or outer x inner fold), the
count, sums and cross products of ``z = [1, x - c, y - c_y]``.  With few
columns this is one built-in aggregation (partial per task, codegen).
With many, each task folds its rows into one small matrix per group with
NumPy (Arrow batches in), cuts the upper triangle into blocks of 64 and
emits one row per (group, block); ``groupBy(group, block)`` with 64 exact
sums combines them, spread over groups x blocks reducers.  Rows never
leave their task; what is shuffled is ``tasks x groups x q(q+1)/128``
rows of 64 doubles, with ``q`` the number of columns plus two.  Centring on global means (``shift``) keeps the sums
free of cancellation when a column's mean is large next to its spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_means(df: DataFrame, cols: list[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return [float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]


# Up to this many sums the Gram matrix is one built-in aggregation (JVM,
# whole-stage codegen); above it, generated code would grow past the JIT
# method limit, so tasks fold rows into partial matrices with NumPy.
JVM_MAX_SUMS = 66      # q(q+1)/2 for q = 11: ten inputs and the target
BLOCK = 64             # partial sums per shuffled row on the wide path
RELATIVE_SPREAD = 1e-28     # of the sum of squares: less is what the means' rounding leaves
MAX_COLUMNS = 2_000    # of a Gram matrix: 2 million numbers, 16 MB, per group


def fold_gram(df: DataFrame, cols: list[str], target: str, by: list[str] | tuple = ("fold",),
              shift: list[float] | None = None, method: str = "auto",
              base: list[str] | None = None, monomials: list[tuple] | None = None) -> DataFrame:
    """Long table ``(by..., i, j, value)`` of ``sum(z_i * z_j)`` for ``i <= j``
    over ``z = [1, cols - shift, target - shift_y]``; ``i = 0`` is the count
    and the plain sums.  ``method``: ``jvm``, ``arrow`` or ``auto``.

    If ``cols`` are products of ``base`` columns, ``monomials`` (index tuples,
    one per column) lets the wide pass read the base columns only and expand
    them inside the task.  ``MAX_COLUMNS`` bounds the matrices that reach the
    driver: groups x q(q+1)/2 numbers, packed 64 to a row."""
    by = list(by)
    names = list(cols) + [target]
    q = len(names) + 1
    if q > MAX_COLUMNS:
        raise ValueError(f"{q} columns; Gram matrices are solved on the driver up to {MAX_COLUMNS}")
    if shift is None:
        shift = column_means(df, names)
    n_sums = q * (q + 1) // 2
    if method == "jvm" or (method == "auto" and n_sums <= JVM_MAX_SUMS):
        return _fold_gram_jvm(df, names, by, shift)
    shift_arr = np.asarray(shift, dtype=float)
    iu0, iu1 = np.triu_indices(q)
    n_sums = len(iu0)
    n_blocks = (n_sums + BLOCK - 1) // BLOCK
    key_fields = [df.schema[b] for b in by]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in key_fields]
                          + [T.StructField("block", T.IntegerType()),
                             T.StructField("v", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.empty((len(pdf), q))
            z[:, 0] = 1.0
            if monomials is None:
                z[:, 1:] = pdf[names].to_numpy(dtype=float)
            else:
                x = pdf[base].to_numpy(dtype=float)
                for c, term in enumerate(monomials, 1):
                    z[:, c] = x[:, list(term)].prod(axis=1)
                z[:, -1] = pdf[target].to_numpy(dtype=float)
            z[:, 1:] -= shift_arr
            if by:
                groups = pdf.groupby(by, sort=False).indices
            else:
                groups = {(): np.arange(len(pdf))}
            for key, idx in groups.items():
                zi = z[idx]
                g = zi.T @ zi
                k = key if isinstance(key, tuple) else (key,)
                acc[k] = acc[k] + g if k in acc else g
        for k, g in acc.items():
            flat = np.zeros(n_blocks * BLOCK)
            flat[:n_sums] = g[iu0, iu1]
            blocks = flat.reshape(n_blocks, BLOCK)
            out = {b: [k[t]] * n_blocks for t, b in enumerate(by)}
            out.update({"block": np.arange(n_blocks, dtype="int32"), "v": list(blocks)})
            yield pd.DataFrame(out)

    read = names if monomials is None else [*base, target]
    parts = df.select(*by, *read).mapInPandas(partial, schema)
    # one row per (task, group, block) is shuffled; BLOCK exact sums per row
    summed = parts.groupBy(*by, "block").agg(
        F.array(*[F.sum(F.col("v")[t]) for t in range(BLOCK)]).alias("s"))
    flat = summed.select(*by, "block", F.posexplode("s").alias("pos", "value")) \
        .withColumn("idx", F.col("block") * BLOCK + F.col("pos")).where(F.col("idx") < n_sums)
    ii = F.array(*[F.lit(int(x)) for x in iu0])
    jj = F.array(*[F.lit(int(x)) for x in iu1])
    out = flat.select(*by, F.element_at(ii, F.col("idx") + 1).alias("i"),
                      F.element_at(jj, F.col("idx") + 1).alias("j"), "value")
    out._packed = (summed, q)
    return out


def _fold_gram_jvm(df: DataFrame, names: list[str], by: list[str], shift) -> DataFrame:
    """One ``groupBy(by).agg`` of all cross products (partial on the map
    side: one row per task and group is shuffled), then unpivoted."""
    z = [F.lit(1.0)] + [F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(names, shift)]
    q = len(z)
    aggs, labels = [], []
    for i in range(q):
        for j in range(i, q):
            aggs.append(F.sum(z[i] * z[j]).alias(f"g_{i}_{j}"))
            labels.append((i, j))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stack = ", ".join(f"{i}, {j}, g_{i}_{j}" for i, j in labels)
    return wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(labels)}, {stack}) AS (i, j, value)") \
               .withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int"))


def gram_matrices(gram: DataFrame, by: list[str] | tuple = ("fold",)) -> dict[tuple, np.ndarray]:
    """Collect the (small) long Gram table into symmetric matrices per group."""
    by = list(by)
    if hasattr(gram, "_packed"):           # 64 numbers to a row instead of one
        summed, q = gram._packed
        iu = np.triu_indices(q)
        flat: dict[tuple, np.ndarray] = {}
        n_sums = len(iu[0])
        for r in summed.collect():
            v = flat.setdefault(tuple(r[b] for b in by), np.zeros(-(-n_sums // BLOCK) * BLOCK))
            v[r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = r["s"]
        out = {}
        for k, v in flat.items():
            m = np.zeros((q, q))
            m[iu] = v[:n_sums]
            out[k] = m + m.T - np.diag(np.diag(m))
        return out
    rows = gram.collect()
    q = max(r["j"] for r in rows) + 1
    out = {}
    for r in rows:
        k = tuple(r[b] for b in by)
        m = out.setdefault(k, np.zeros((q, q)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
    return out


class Stats:
    """Centred moments of one set of rows, from its Gram matrix."""

    def __init__(self, g: np.ndarray):
        q = g.shape[0]
        p = q - 2
        self.p = p
        self.n = g[0, 0]
        n = self.n
        self.sx = g[0, 1:p + 1]
        self.sy = g[0, q - 1]
        self.Sxx = g[1:p + 1, 1:p + 1]
        self.Sxy = g[1:p + 1, q - 1]
        self.Syy = g[q - 1, q - 1]
        self.mx = self.sx / n if n else np.zeros(p)
        self.my = self.sy / n if n else 0.0
        self.Cxx = self.Sxx - n * np.outer(self.mx, self.mx)
        self.Cxy = self.Sxy - n * self.mx * self.my
        self.Cyy = self.Syy - n * self.my * self.my

    def constant_y(self) -> bool:
        """Whether the target's spread is nothing but rounding."""
        return not self.Cyy > 1e-12 * max(self.Syy, 0.0)

    def constant_x(self) -> np.ndarray:
        return ~(np.diag(self.Cxx) > 1e-12 * np.maximum(np.diag(self.Sxx), 0.0))

    def sse(self, w: np.ndarray, a: float) -> float:
        """Sum of squared errors of ``a + w'x`` on these rows (shifted scale)."""
        return float(self.Syy - 2 * a * self.sy - 2 * w @ self.Sxy + self.n * a * a
                     + 2 * a * (w @ self.sx) + w @ self.Sxx @ w)


def sum_groups(mats: dict[tuple, np.ndarray], keep) -> np.ndarray:
    sel = [m for k, m in mats.items() if keep(k)]
    if not sel:
        raise ValueError("no rows in the requested set")
    return np.sum(sel, axis=0)


def pair_moments(batches, cols: list[str]):
    """Co-moments of each pair of columns over the rows of a task where both are
    present, one row per pair (i < j): n, means and centred sums.  One product
    of matrices per batch (values, squares and presence masks)."""
    p, shift, acc = len(cols), None, None
    for pdf in batches:
        x = pdf[cols].to_numpy(dtype=float)
        mask = ~np.isnan(x)
        if shift is None:           # any value near the column's; moments don't depend on it
            at = mask.argmax(0)
            shift = np.where(mask.any(0), x[at, np.arange(p)], 0.0)
            shift = np.where(np.isfinite(shift), shift, 0.0)
        x = np.where(mask, x - shift, 0.0)
        m = mask.astype(float)
        new = [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
        acc = new if acc is None else [a + b for a, b in zip(acc, new)]
    if acc is None:
        shift, acc = np.zeros(p), [np.zeros((p, p))] * 4
    i, j = np.triu_indices(p, 1)
    n, sx, sxx, sxy = acc
    count = n[i, j]
    some = np.maximum(count, 1)
    mx, my = sx[i, j] / some, sx[j, i] / some
    yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": count, "mx": mx + shift[i], "my": my + shift[j],
                        "cxx": sxx[i, j] - count * mx * mx, "cyy": sxx[j, i] - count * my * my, "cxy": sxy[i, j] - count * mx * my})


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (long form, ``i < j``) over the rows
    where both are present, for any number of pairs in one scan.

    Each task adds up one masked Gram matrix over its Arrow batches (products
    of values, squares and presence masks) and emits one row per pair; a pair's
    rows, at most one per task, are merged exactly: their centred sums plus
    what their means differ by.  A pair with fewer than two common rows or a
    constant side has a null correlation; NaN counts as missing."""
    cols = list(cols)
    names = [F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)]
    inner = [f"c{k}" for k in range(len(cols))]
    parts = df.select(*names).mapInPandas(
        lambda batches: pair_moments(batches, inner),
        "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double")
    pair, n = Window.partitionBy("i", "j"), F.col("n")
    for side in ("x", "y"):         # from the pair's own mean over all tasks
        mean = F.try_divide(F.sum(n * F.col(f"m{side}")).over(pair), F.sum(n).over(pair))
        parts = parts.withColumn(f"d{side}", F.col(f"m{side}") - mean)
    sums = [F.sum(F.col(f"c{a}{b}") + n * F.col(f"d{a}") * F.col(f"d{b}")).alias(f"c{a}{b}") for a, b in ("xx", "yy", "xy")]
    large = [F.sum(n * F.col(f"m{side}") * F.col(f"m{side}")).alias(f"q{side}") for side in ("x", "y")]
    merged = parts.groupBy("i", "j").agg(*sums, *large)
    varies = [(F.col(f"c{s}{s}") > 0) & (F.col(f"c{s}{s}") > RELATIVE_SPREAD * F.col(f"q{s}")) for s in ("x", "y")]
    corr = F.when(varies[0] & varies[1], F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy")))
    name = F.array(*[F.lit(c) for c in cols])
    return merged.select(F.element_at(name, F.col("i") + 1).alias("var_a"), F.element_at(name, F.col("j") + 1).alias("var_b"), corr.alias("corr"))
