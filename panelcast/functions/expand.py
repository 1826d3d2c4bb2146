"""Scaling and polynomial expansion as column expressions.

Both produce plain SQL expressions, so a fitted preprocessing step is a
built-in ``SQLTransformer`` stage: it runs inside whole-stage codegen and
is saved and loaded by stock Spark.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sql_double(v: float) -> str:
    """A double literal that Spark SQL parses back to the same bits."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def qi(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------- scaling
class StandardizerModel:
    """``(x - mean) / std`` with population std; a column whose smallest and
    largest value are equal has std 0 (whatever rounding leaves of it) and
    scales by 1, so it becomes 0 up to rounding, the usual standard-scaler rule."""

    def __init__(self, cols: list[str], means: list[float], stds: list[float], suffix: str = ""):
        self.cols, self.means, self.stds, self.suffix = list(cols), list(means), list(stds), suffix

    def scale(self, i: int) -> float:
        s = self.stds[i]
        return s if s and s > 0 else 1.0

    def columns(self) -> dict[str, Column]:
        return {c + self.suffix: (F.col(c) - F.lit(self.means[i])) / F.lit(self.scale(i))
                for i, c in enumerate(self.cols)}

    def sql_items(self) -> list[str]:
        return [f"({qi(c)} - {sql_double(self.means[i])}) / {sql_double(self.scale(i))} AS {qi(c + self.suffix)}"
                for i, c in enumerate(self.cols)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())

    def stage(self):
        """A built-in SQLTransformer adding the scaled columns (needs a suffix,
        since the input columns stay)."""
        from pyspark.ml.feature import SQLTransformer
        if not self.suffix:
            raise ValueError("a pipeline stage needs a suffix for the scaled columns")
        return SQLTransformer(statement=f"SELECT *, {', '.join(self.sql_items())} FROM __THIS__")

    def to_rows(self) -> list[tuple]:
        return [(c, float(self.means[i]), float(self.stds[i])) for i, c in enumerate(self.cols)]


def moments(df: DataFrame, cols: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """Mean and population std per column (long form), optionally per group.
    One aggregation pass, partial on the map side."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_pop(c).alias(f"s__{c}")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m__{c}`, `s__{c}`" for c in cols)
    return wide.selectExpr(*by, f"stack({len(cols)}, {stack}) AS (variable, mean, std)")


def spread(col: str) -> Column:
    """Population std as an aggregate; exactly 0 for a constant column."""
    return F.when(F.min(col) == F.max(col), F.lit(0.0)).otherwise(F.stddev_pop(col))


class Standardizer:
    def __init__(self, cols: list[str], suffix: str = ""):
        self.cols, self.suffix = list(cols), suffix

    def fit(self, df: DataFrame) -> StandardizerModel:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.cols)],
                     *[spread(c).alias(f"s{i}") for i, c in enumerate(self.cols)]).first()
        means = [row[f"m{i}"] for i in range(len(self.cols))]
        stds = [row[f"s{i}"] for i in range(len(self.cols))]
        if any(m is None for m in means):
            raise ValueError("cannot standardize an empty frame")
        return StandardizerModel(self.cols, means, stds, self.suffix)


# ------------------------------------------------------------- polynomials
def poly_terms(n_inputs: int, degree: int, interaction_only: bool = False,
               bias: bool = False) -> list[tuple[int, ...]]:
    """Monomials as index tuples, degree-major, lexicographic inside a
    degree (the usual polynomial-features order); ``()`` is the bias."""
    terms: list[tuple[int, ...]] = [()] if bias else []
    gen = combinations if interaction_only else combinations_with_replacement
    for d in range(1, degree + 1):
        terms += list(gen(range(n_inputs), d))
    return terms


def poly_names(cols: list[str], degree: int, interaction_only: bool = False,
               bias: bool = False) -> list[str]:
    """Readable names: ``a``, ``a b``, ``a^2``, ``1`` for the bias."""
    out = []
    for t in poly_terms(len(cols), degree, interaction_only, bias):
        if not t:
            out.append("1")
            continue
        parts = []
        for i in sorted(set(t)):
            k = t.count(i)
            parts.append(cols[i] if k == 1 else f"{cols[i]}^{k}")
        out.append(" ".join(parts))
    return out


def poly_column_names(cols: list[str], degree: int, interaction_only: bool = False,
                      bias: bool = False, prefix: str = "f") -> list[str]:
    """Safe column names for the generated terms (``f0``, ``f1``...)."""
    n = len(poly_terms(len(cols), degree, interaction_only, bias))
    return [f"{prefix}{i}" for i in range(n)]


def poly_sql(cols: list[str], degree: int, interaction_only: bool = False,
             bias: bool = False, prefix: str = "f") -> list[str]:
    terms = poly_terms(len(cols), degree, interaction_only, bias)
    names = poly_column_names(cols, degree, interaction_only, bias, prefix)
    items = []
    for t, n in zip(terms, names):
        e = " * ".join(qi(cols[i]) for i in t) if t else "CAST(1 AS DOUBLE)"
        items.append(f"{e} AS {qi(n)}")
    return items


def poly(df: DataFrame, cols: list[str], degree: int, interaction_only: bool = False,
         bias: bool = False, prefix: str = "f") -> DataFrame:
    """Append all monomials up to ``degree`` as ``f0..fK`` columns."""
    terms = poly_terms(len(cols), degree, interaction_only, bias)
    names = poly_column_names(cols, degree, interaction_only, bias, prefix)
    new = {}
    for t, n in zip(terms, names):
        e = F.lit(1.0)
        for i in t:
            e = e * F.col(cols[i])
        new[n] = e
    return df.withColumns(new)
