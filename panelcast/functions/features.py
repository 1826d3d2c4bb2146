"""Column-level feature transforms over a panel keyed by ``(series, day)``.

All of them are Catalyst expressions (whole-stage codegen, no Python on
the executors).  The one window, the lag, is always partitioned by the
series key; the panel key ``(series, day)`` is unique, so one window
partition holds at most one row per calendar day of one series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("series", "day")


def parse_day(df: DataFrame, col: str, out: str | None = None, fmt: str | None = None,
              on_error: str = "raise") -> DataFrame:
    """Text or timestamp to date.  Bad text raises (``on_error='raise'``)
    or becomes null (``'null'``), whatever the ANSI setting is."""
    out = out or col
    c = F.col(col)
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DateType):
        expr = c
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        expr = c.cast("date")
    else:
        parsed = (F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)).cast("date")
        if on_error == "raise":
            expr = F.when(c.isNotNull() & parsed.isNull(),
                          F.raise_error(F.concat(F.lit(f"cannot parse {col} as a date: "), c))
                          ).otherwise(parsed)
        elif on_error == "null":
            expr = parsed
        else:
            raise ValueError("on_error must be 'raise' or 'null'")
    return df.withColumn(out, expr)


CALENDAR = {
    "year": F.year,
    "month": F.month,
    "day_of_month": F.dayofmonth,
    "weekday": F.weekday,  # Monday = 0, like pandas .dt.weekday
}


def calendar_parts(df: DataFrame, day: str = "day",
                   parts=("year", "month", "day_of_month", "weekday"), prefix: str = "") -> DataFrame:
    """Year, month, day of month and weekday (Monday = 0) of a date column."""
    unknown = [p for p in parts if p not in CALENDAR]
    if unknown:
        raise ValueError(f"unknown calendar parts {unknown}")
    return df.withColumns({f"{prefix}{p}": CALENDAR[p](F.col(day)) for p in parts})


def cyclical(df: DataFrame, col: str, period: float = 12, parts=("sin", "cos")) -> DataFrame:
    """``sin``/``cos`` of ``2*pi*x/period`` as ``<col>_sin`` / ``<col>_cos``."""
    ang = F.lit(2 * math.pi) * F.col(col) / F.lit(float(period))
    fn = {"sin": F.sin, "cos": F.cos}
    return df.withColumns({f"{col}_{p}": fn[p](ang) for p in parts})


def lag_feature(df: DataFrame, col: str, n: int = 1, out: str | None = None,
                by: str | None = "series", order: str = "day") -> DataFrame:
    """Value of ``col`` ``n`` rows earlier in the same series (row position,
    not calendar day: a missing day is skipped over, like ``shift``).

    A key is required: a window without one plans a single-partition
    exchange of all rows.
    """
    if not by:
        raise ValueError("lag_feature needs a series key; an unkeyed window runs in one task")
    if out is None:
        out = f"{col}_prev" if n == 1 else f"{col}_lag{n}"
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn(out, F.lag(col, n).over(w))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null (or NaN) in any column, or in ``subset``."""
    return df.dropna("any", subset=subset)


def select_features(df: DataFrame, features: list[str], target: str | None = None,
                    keys=KEY) -> DataFrame:
    """Keys, the ordered feature list, then the target."""
    cols = [k for k in keys if k in df.columns] + list(features) + ([target] if target else [])
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*cols)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Feature vector for Spark ML; a null or NaN raises (``handleInvalid='error'``)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def cast_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def log_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``log1p`` of the target."""
    return df.withColumn(out or col, F.log1p(F.col(col).cast("double")))


def unlog(df: DataFrame, cols: list[str]) -> DataFrame:
    """``expm1`` on predictions and truth, back to the original scale."""
    return df.withColumns({c: F.expm1(F.col(c)) for c in cols})


def rename_values(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Display names for report values; unmapped values pass through."""
    if not mapping:
        return df.withColumn(out or col, F.col(col))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or col, F.coalesce(m[F.col(col)], F.col(col)))


def union_series(frames: dict[str, DataFrame], key: str = "series") -> DataFrame:
    """Stack independently read series under a ``series`` key.  Apply the
    lag after the union: it is keyed by series, so the result equals
    preparing each series apart."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(key, F.lit(name)) if key not in df.columns else df
        out = d if out is None else out.unionByName(d)
    return out


def prepare_daily(df: DataFrame, lag_of: str = "y", month_parts=("sin", "cos"),
                  drop: list[str] | None = None, dropna_subset: list[str] | None = None) -> DataFrame:
    """The preparation block the reference repeats in several studies:
    drop a column, month, its sine/cosine, previous-row target, drop nulls."""
    if drop:
        df = df.drop(*drop)
    df = calendar_parts(df, "day", parts=("month",))
    if month_parts:
        df = cyclical(df, "month", 12, month_parts)
    if lag_of:
        df = lag_feature(df, lag_of)
    return drop_nulls(df, dropna_subset)


TIE_NUDGE = 3.71e-5   # of the last kept digit: moves exact decimal ties off the half


def rounded(col: str | Column, digits: int = 6) -> Column:
    """Round for comparison with another engine.  Averages of decimal data
    often sit exactly on a half, where engines round differently (decimal
    text half-up vs the binary value); a tiny fixed nudge moves every value
    off the half first.  ``+ 0.0`` folds -0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(TIE_NUDGE * 10.0 ** (-digits)), digits) + F.lit(0.0)
