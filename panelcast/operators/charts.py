"""The tables behind the usual study figures (no drawing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_summary(t: DataFrame, by: str = "model", value: str = "r2", exact: bool = False,
                accuracy: int = 10000) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (farthest point inside the fence) and the
    number of points outside, per group.  By default ``percentile_approx``
    (bounded memory per group, whatever its size); ``exact=True`` uses
    ``percentile`` with linear interpolation, which buffers a group's values
    in one task: for small tables such as fold scores."""
    if exact:
        q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    else:
        q = F.percentile_approx(F.col(value), [0.25, 0.5, 0.75], accuracy)
    qs = t.groupBy(by).agg(q.alias("_q"))
    qs = qs.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    qs = qs.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = t.join(qs, by)   # qs is one row per group
    v = F.col(value)
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    return (j.groupBy(by, "q1", "median", "q3")
             .agg(F.min(F.when(inside, v)).alias("whisker_lo"),
                  F.max(F.when(inside, v)).alias("whisker_hi"),
                  F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers")))


def fold_lines(scores: DataFrame, value: str = "r2") -> DataFrame:
    """Fold on x (1-based), score on y, one line per model."""
    return scores.select("model", (F.col("fold") + 1).alias("fold_no"), F.col(value).alias(value)) \
                 .orderBy("model", "fold_no")


def actual_vs_predicted(pred: DataFrame, label: str = "y", prediction: str = "prediction") -> DataFrame:
    """Pairs with the shared axis limits of the diagonal (two scalars from
    one aggregation, added as literals)."""
    lim = pred.agg(F.least(F.min(label).cast("double"), F.min(prediction)).alias("lo"),
                   F.greatest(F.max(label).cast("double"), F.max(prediction)).alias("hi")).first()
    return pred.select(*[c for c in ("series", "day") if c in pred.columns],
                       F.col(label).cast("double").alias("actual"), F.col(prediction).alias("predicted"),
                       F.lit(lim["lo"]).alias("axis_lo"), F.lit(lim["hi"]).alias("axis_hi"))


def variance_labels(t: DataFrame, value: str = "cumulative") -> DataFrame:
    """Cumulative share as percent text, one decimal."""
    return t.withColumn("label", F.format_string("%.1f%%", F.col(value) * 100))


def cumulative(t: DataFrame, value: str = "ratio", order: str = "component",
               by: list[str] | tuple = ()) -> DataFrame:
    """Running sum of variance ratios (over at most p components)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cumulative", F.sum(value).over(w))


SKETCH_K = 4096         # of a KLL sketch; exact up to as many values, rank error about 0.06 % beyond
SKETCH_GRID = 8192      # ranks at which a sketch is read: twice k, so that no kept value is skipped
MAX_DEPTH = 12          # of a quadtree: at most 4096 x 4096 smallest cells


def value_sketches(t: DataFrame, by: list[str] | tuple, value: str, k: int = SKETCH_K) -> DataFrame:
    """``by``..., sketch: a mergeable KLL sketch of the values of each group
    (nulls and NaN left out).  Bounded, whatever the group's size: a table of
    these, say per series and month, stands for the rows of any later grouping."""
    v = F.col(value).cast("double")
    return t.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str] | tuple, k: int = SKETCH_K) -> DataFrame:
    """Sketches of coarser groups, from sketches only."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_box(sketches: DataFrame, by: list[str] | tuple) -> DataFrame:
    """``box_summary`` of each row's sketch: n, quartiles (the smallest value
    with at least that share of the values up to it), whiskers and the number of
    outliers, without reading rows again.  Exact where a group had at most k
    values, else within the sketch's rank error.  (Whiskers depend on the
    fences, and Spark reads sketches at constant ranks only: so each is read at
    ``SKETCH_GRID`` even ranks once, which no group's size changes.)"""
    ranks = F.expr(f"array({', '.join(f'{(i + 0.5) / SKETCH_GRID!r}D' for i in range(SKETCH_GRID))})")
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    t = sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"),
                        F.kll_sketch_get_quantile_double("sketch", ranks).alias("grid"))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.filter("grid", lambda v: (v >= lo) & (v <= hi))
    values = lambda test: F.round(F.size(F.filter("grid", test)) * F.col("n") / SKETCH_GRID).cast("long")
    return t.select(*by, "n", "q1", "median", "q3", F.array_min(inside).alias("whisker_lo"), F.array_max(inside).alias("whisker_hi"),
                    (values(lambda v: v < lo) + values(lambda v: v > hi)).alias("n_outliers"))


def scatter_cells(pred: DataFrame, label: str = "y", prediction: str = "prediction", bound: int = 100, depth: int = 8,
                  limits: tuple[float, float] | None = None) -> DataFrame:
    """The figure of actual against predicted values as adaptive cells: a square
    is quartered where it holds more than ``bound`` points, down to ``depth``
    quarterings.  level, ix, iy, n, and the cell's corner and side on the shared
    axes.  Counts sum to the number of pairs (nulls left out).

    One pass counts the smallest cells (at most 4^depth rows, whatever the
    table's size); the levels above are sums of these."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must lie between 0 and {MAX_DEPTH}")
    xy = pred.select(F.col(label).cast("double").alias("x"), F.col(prediction).cast("double").alias("y")).where("x is not null and y is not null")
    if limits is None:
        lim = xy.agg(F.least(F.min("x"), F.min("y")).alias("lo"), F.greatest(F.max("x"), F.max("y")).alias("hi")).first()
        limits = (lim["lo"], lim["hi"])
    lo, hi = limits if limits[0] is not None else (0.0, 0.0)
    size = 1 << depth
    side = float(hi - lo) or 1.0
    place = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.lit(float(lo))) / F.lit(side) * size), F.lit(0)), F.lit(size - 1)).cast("int")
    small = xy.groupBy(place("x").alias("ix"), place("y").alias("iy")).agg(F.count("*").alias("n"))
    # every cell of every level above, from the smallest ones
    up = small.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    cells = up.groupBy("level", shift("ix").alias("ix"), shift("iy").alias("iy")).agg(F.sum("n").alias("n"))
    split = cells.where((F.col("n") > bound) & (F.col("level") < depth))
    parent = split.select((F.col("level") + 1).alias("level"), F.col("ix").alias("px"), F.col("iy").alias("py"))
    inner = cells.withColumns({"px": F.expr("shiftright(ix, 1)"), "py": F.expr("shiftright(iy, 1)")}).join(parent, ["level", "px", "py"], "left_semi")
    shown = cells.where("level = 0").unionByName(inner.select("level", "ix", "iy", "n")).where((F.col("n") <= bound) | (F.col("level") == depth))
    width = F.lit(side) / F.pow(F.lit(2.0), "level")
    return shown.select("level", "ix", "iy", "n", (F.lit(float(lo)) + F.col("ix") * width).alias("x0"),
                        (F.lit(float(lo)) + F.col("iy") * width).alias("y0"), width.alias("side"))
