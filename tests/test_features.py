import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelcast.functions import features as fx
from panelcast.functions.expand import Standardizer, poly_names, poly_terms


def test_panel_shape(panel):
    assert panel.count() == 4517
    assert panel.select("series").distinct().count() == 5
    assert panel.where("x_ret IS NULL").count() == 2726


def test_lag_takes_previous_row_not_previous_day(spark):
    rows = [("a", dt.date(2020, 1, 1), 1), ("a", dt.date(2020, 1, 3), 3), ("a", dt.date(2020, 1, 4), 4),
            ("b", dt.date(2020, 1, 2), 9)]
    df = spark.createDataFrame(rows, "series string, day date, y long")
    out = {(r.series, r.day): r.y_prev for r in fx.lag_feature(df, "y").collect()}
    assert out[("a", dt.date(2020, 1, 3))] == 1           # gap day: previous row
    assert out[("a", dt.date(2020, 1, 1))] is None
    assert out[("b", dt.date(2020, 1, 2))] is None        # single-row series


def test_lag_needs_a_key(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1)], "series string, day date, y long")
    with pytest.raises(ValueError):
        fx.lag_feature(df, "y", by=None)


def test_lag_plan_is_partitioned(spark, panel):
    plan = fx.lag_feature(panel, "y")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_drop_nulls_all_columns_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", float("nan"), 2.0), ("c", 3.0, None)],
                               "series string, x double, unused double")
    assert fx.drop_nulls(df).count() == 1
    assert fx.drop_nulls(df, ["x"]).count() == 2


def test_calendar_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),)], "day date")   # a Monday
    r = fx.calendar_parts(df, "day").first()
    assert (r.year, r.month, r.day_of_month, r.weekday) == (2024, 1, 1, 0)


def test_cyclical_values(spark):
    df = spark.createDataFrame([(3,)], "month int")
    r = fx.cyclical(df, "month", 12).first()
    assert abs(r.month_sin - 1.0) < 1e-12 and abs(r.month_cos) < 1e-12


def test_parse_day_raises_or_nulls(spark):
    df = spark.createDataFrame([("2020-01-02",), ("bad",)], "d string")
    assert fx.parse_day(df, "d", on_error="null").where("d IS NULL").count() == 1
    with pytest.raises(Exception):
        fx.parse_day(df, "d", on_error="raise").collect()


def test_standardize_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    m = Standardizer(["x", "c"]).fit(df)
    rows = m.transform(df).collect()
    assert all(r.c == 0.0 for r in rows)
    assert abs(m.stds[0] - math.sqrt(2 / 3)) < 1e-12      # population std


def test_poly_order_and_counts():
    assert len(poly_terms(7, 2)) == 35
    assert len(poly_terms(8, 2)) == 44
    assert len(poly_terms(5, 3, interaction_only=True, bias=True)) == 26
    assert poly_names(["a", "b"], 2) == ["a", "b", "a^2", "a b", "b^2"]
    assert poly_names(["a", "b", "c"], 3, True, True) == ["1", "a", "b", "c", "a b", "a c", "b c", "a b c"]


def test_rename_values(spark):
    df = spark.createDataFrame([("x_tax",), ("x_qty",)], "v string")
    out = sorted(r.v for r in fx.rename_values(df, "v", {"x_tax": "temp"}).collect())
    assert out == ["temp", "x_qty"]


def test_union_series_then_lag_equals_apart(spark, panel):
    p = panel.select("series", "day", "y")
    frames = {n: p.where(F.col("series") == n).drop("series") for n in ("EUROPE", "ASIA")}
    u = fx.lag_feature(fx.union_series(frames), "y")
    apart = fx.lag_feature(p.where(F.col("series").isin("EUROPE", "ASIA")), "y")
    assert sorted(u.collect()) == sorted(apart.select(*u.columns).collect())


def test_assemble_raises_on_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    with pytest.raises(Exception):
        fx.assemble(df, ["a", "b"]).collect()


def test_drop_columns_strict_and_lenient(spark):
    from panelcast.sources import io
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        io.drop_columns(df, ["c"], strict=True)
    assert io.drop_columns(df, ["b", "c"], strict=False).columns == ["a"]


def test_read_panel_failfast_and_required(spark, tmp_path):
    from pyspark.sql import types as T

    from panelcast.sources import io
    p = tmp_path / "bad.csv"
    p.write_text("series,day,y\na,2020-01-01,1\nb,not-a-date,2\n")
    schema = T.StructType([T.StructField("series", T.StringType()), T.StructField("day", T.DateType()),
                           T.StructField("y", T.LongType())])
    with pytest.raises(Exception):
        io.read_panel(spark, str(p), schema=schema, fmt="csv").collect()
    good = tmp_path / "good.csv"
    good.write_text("series,day,y\na,2020-01-01,1\n")
    assert io.read_panel(spark, str(good), schema=schema, fmt="csv", required=["y"]).count() == 1
    with pytest.raises(ValueError):
        io.read_panel(spark, str(good), schema=schema, fmt="csv", required=["x"])


def test_unlog_undoes_log_target(spark):
    from panelcast.functions.features import log_target, unlog
    d = spark.createDataFrame([(0.0,), (3.5,), (120.0,)], "y double")
    names = [c for c in log_target(d, "y").columns if c != "y"] or ["y"]
    back = unlog(log_target(d, "y"), names)
    assert [round(r[names[0]], 9) for r in back.collect()] == [0.0, 3.5, 120.0]


def test_prepare_daily_is_the_steps_one_by_one(spark):
    from panelcast.functions.features import calendar_parts, cyclical, drop_nulls, lag_feature, prepare_daily
    d = spark.sql("select 'a' series, date_add(date'2020-01-30', cast(id as int)) day, id y, 1 z from range(5)")
    want = drop_nulls(lag_feature(cyclical(calendar_parts(d.drop("z"), "day", ("month",)), "month", 12, ("sin", "cos")), "y"), None)
    got = prepare_daily(d, drop=["z"])
    assert got.columns == want.columns and got.collect() == want.collect() and got.count() == 4
