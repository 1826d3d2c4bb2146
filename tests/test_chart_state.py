"""Mergeable box summaries and adaptive cells of a scatter figure."""

import random

import numpy as np
import pandas as pd
import pytest

from panelcast.operators import charts

COLUMNS = ["n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers"]


def exact_box(v):
    v = np.sort(np.asarray(v))
    n = len(v)
    q1, q2, q3 = (v[max(0, int(np.ceil(s * n)) - 1)] for s in (0.25, 0.5, 0.75))
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = v[(v >= lo) & (v <= hi)]
    return (n, q1, q2, q3, inside[0], inside[-1], n - len(inside))


def frame(spark, groups):
    rows = [(g, i % 7, float(x)) for g, v in groups.items() for i, x in enumerate(v)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["g", "part", "v"])).repartition(5)


def test_sketches_are_exact_up_to_k_and_merge(spark):
    r = np.random.default_rng(1)
    groups = {"a": r.standard_normal(900), "b": r.standard_cauchy(1500), "ties": r.integers(0, 4, 700), "one": [5.0], "same": [2.0] * 30,
              "fence": [0, 1, 2, 3, 4, 5, 6, 7, 8, 15.5, -7.5, 16, -8]}
    t = frame(spark, groups)
    direct = charts.sketch_box(charts.value_sketches(t, ["g"], "v"), ["g"])
    parts = charts.value_sketches(t, ["g", "part"], "v")
    merged = charts.sketch_box(charts.merge_sketches(parts, ["g"]), ["g"])
    for df in (direct, merged):
        got = {x.g: tuple(x[c] for c in COLUMNS) for x in df.collect()}
        assert got == {g: exact_box(v) for g, v in groups.items()}


def test_sketches_keep_their_rank_error(spark):
    r = np.random.default_rng(2)
    v = r.lognormal(size=60_000)
    t = frame(spark, {"a": v})
    for sketches in (charts.value_sketches(t, ["g"], "v", k=512), charts.merge_sketches(charts.value_sketches(t, ["g", "part"], "v", k=512), ["g"], k=512)):
        x = charts.sketch_box(sketches, ["g"]).first()
        assert x.n == 60_000 and len(bytes(sketches.first().sketch)) < 40_000
        for share, q in ((0.25, x.q1), (0.5, x.median), (0.75, x.q3)):
            assert abs((v <= q).mean() - share) < 0.015
        lo, hi = x.q1 - 1.5 * (x.q3 - x.q1), x.q3 + 1.5 * (x.q3 - x.q1)
        assert abs(x.n_outliers - ((v < lo) | (v > hi)).sum()) < 0.015 * 60_000


def test_nulls_have_no_part_in_a_sketch(spark):
    t = spark.createDataFrame([("a", None), ("a", 1.0), ("a", float("nan")), ("b", None)], "g string, v double")
    assert [tuple(r) for r in charts.sketch_box(charts.value_sketches(t, ["g"], "v"), ["g"]).collect()] == [("a", 1, 1.0, 1.0, 1.0, 1.0, 1.0, 0)]


def brute_cells(points, bound, depth, lo, side):
    out, size = {}, 1 << depth
    at = [tuple(min(max(int(np.floor((c - lo) / side * size)), 0), size - 1) for c in p) for p in points]

    def visit(level, ix, iy, inside):
        if not inside:
            return
        if len(inside) <= bound or level == depth:
            out[level, ix, iy] = len(inside)
            return
        for dx in (0, 1):
            for dy in (0, 1):
                x, y, s = 2 * ix + dx, 2 * iy + dy, depth - level - 1
                visit(level + 1, x, y, [p for p in inside if p[0] >> s == x and p[1] >> s == y])

    visit(0, 0, 0, at)
    return out


@pytest.mark.parametrize("bound, depth", [(20, 6), (1, 3), (5000, 6), (20, 0)])
def test_cells_equal_a_quadtree(spark, bound, depth):
    r = random.Random(3)
    points = [(r.gauss(10, 3), r.gauss(10, 1)) for _ in range(1500)] + [(4.0, 4.0)] * 200
    df = spark.createDataFrame([*points, (None, 1.0), (1.0, None)], "y double, prediction double")
    lo, hi = min(min(p) for p in points), max(max(p) for p in points)
    cells = charts.scatter_cells(df, bound=bound, depth=depth).collect()
    assert {(c.level, c.ix, c.iy): c.n for c in cells} == brute_cells(points, bound, depth, lo, hi - lo)
    assert sum(c.n for c in cells) == 1700
    # cells don't overlap and lie inside the axes
    assert abs(sum(c.side ** 2 for c in cells)) <= (hi - lo) ** 2 * (1 + 1e-9)
    assert all(lo - 1e-9 <= c.x0 and c.x0 + c.side <= hi + 1e-9 for c in cells)


def test_cells_of_few_points(spark):
    df = spark.createDataFrame([(3.0, 3.0)] * 4, "y double, prediction double")
    assert [tuple(c)[:4] for c in charts.scatter_cells(df, bound=9).collect()] == [(0, 0, 0, 4)]
    assert [tuple(c)[:4] for c in charts.scatter_cells(df, bound=1, depth=2).collect()] == [(2, 0, 0, 4)]
    assert charts.scatter_cells(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="depth"):
        charts.scatter_cells(df, depth=40)
