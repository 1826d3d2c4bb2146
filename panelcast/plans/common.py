"""Shared inputs of the registered queries: the prepared fixture panel and
the feature lists of the reference's studies (on the fixture's stand-in
columns, see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.features import calendar_parts, cyclical, drop_nulls, lag_feature
from ..sources.fixture import fixture_panel

# Stand-ins: SO2=x_qty, C6H6=x_disc, NOx=x_price, temperatura=x_tax,
# humedad=x_size, PM10=x_retail, PM25=x_open, O3=x_ret, ingresos=y.
F_COMPARE = ["x_qty", "x_disc", "x_price", "x_tax", "x_size", "month_sin", "month_cos", "y_prev"]
F_NETWORK = ["x_qty", "x_disc", "x_price", "x_tax", "x_size", "month_sin", "y_prev"]
F_LINEAR = ["x_qty", "x_disc", "x_price", "x_tax", "x_size"]
F_TREE = ["x_qty", "x_disc", "x_price", "x_tax", "x_size", "x_retail", "x_open"]
F_PCA = ["x_open", "x_retail", "x_qty", "x_ret", "x_disc", "x_price", "x_tax", "x_size"]
F_TWO = ["y_prev", "x_qty"]          # two inputs: closed forms exist for the SQL oracle
DISPLAY = {"x_tax": "temp", "x_size": "hum"}


def prep(spark: SparkSession, sf: str, cols: list[str] | None, key: str = "region") -> DataFrame:
    """Fixture panel without ``y_drop``, with month, its sine and cosine and
    the previous-row target per series; rows with a null in ``cols`` dropped
    (every column when ``cols`` is None)."""
    p = fixture_panel(spark, sf, key).drop("y_drop")
    p = calendar_parts(p, "day", ("month",))
    p = cyclical(p, "month", 12, ("sin", "cos"))
    p = lag_feature(p, "y")
    # Persisted: studies read the prepared panel in several passes (moments,
    # Gram, splits); the panel is an aggregate, far smaller than lineitem,
    # and a lost block is rebuilt from its short lineage.
    return drop_nulls(p, cols).persist()
