"""Registered queries (Spark) and their DuckDB oracles.

Every query reads the test tables through the fixture panel, over whole
tables.  Doubles are rounded on both sides before comparison (see
``functions.features.rounded``); large-magnitude columns to fewer digits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as fx
from ..functions.expand import Standardizer
from ..functions.features import rounded as R
from ..functions.metrics import metrics, summarise
from ..operators import charts, linear, selection, splits
from ..operators.fitting import ModelSpec, cross_validate, fit
from ..session import scratch_path
from ..sources import io
from ..sources.fixture import fixture_panel
from . import oracle as O
from .common import DISPLAY, F_COMPARE, F_PCA, F_TWO, prep

QUERIES: dict = {}
ORACLES: dict = {}

PANEL_DIGITS = {"x_qty": 6, "x_price": 4, "x_disc": 6, "x_tax": 6, "x_size": 6, "x_retail": 4,
                "x_open": 6, "x_ret": 6}
ALPHAS = linear.REFERENCE_ALPHAS
SEED = 42
K = 5


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _round_panel(df: DataFrame) -> DataFrame:
    return df.withColumns({c: R(c, d) for c, d in PANEL_DIGITS.items() if c in df.columns})


def _panel_sql_rounded(src: str, extra: str = "") -> str:
    cols = ", ".join(f"{O.r(c, d)} AS {c}" for c, d in PANEL_DIGITS.items())
    return f"SELECT series, day, {cols}, y{extra} FROM {src}"


# =========================================================== sources, projections
@register("fixture_panel", sql=_panel_sql_rounded(f"({O.panel_sql()})", ", y_drop"))
def q_fixture_panel(spark, sf):
    return _round_panel(fixture_panel(spark, sf))


@register("supplier_panel", sql=_panel_sql_rounded(f"({O.panel_sql('supplier')})", ", y_drop"))
def q_supplier_panel(spark, sf):
    return _round_panel(fixture_panel(spark, sf, "supplier"))


@register("read_panel", sql=_panel_sql_rounded(f"({O.panel_sql()})", ", y_drop"))
def q_read_panel(spark, sf):
    """Write the panel as CSV to the shared scratch folder, read it back with
    a fixed schema (FAILFAST)."""
    p = fixture_panel(spark, sf)
    path = scratch_path(spark, f"read_panel-{uuid.uuid4().hex}")
    p.write.option("header", "true").csv(path)
    back = io.read_panel(spark, path, schema=p.schema, fmt="csv", required=["series", "day", "y"])
    return _round_panel(back)


@register("drop_columns", sql=_panel_sql_rounded(f"({O.panel_sql()})"))
def q_drop_columns(spark, sf):
    return _round_panel(io.drop_columns(fixture_panel(spark, sf), ["y_drop"], strict=True))


@register("parse_day", sql=f"""SELECT series, strftime(day, '%Y-%m-%d') AS day_text,
  CAST(strftime(day, '%Y-%m-%d') AS DATE) AS parsed FROM ({O.panel_sql()})""")
def q_parse_day(spark, sf):
    p = fixture_panel(spark, sf).select("series", F.date_format("day", "yyyy-MM-dd").alias("day_text"))
    return fx.parse_day(p, "day_text", out="parsed", fmt="yyyy-MM-dd").select("series", "day_text", "parsed")


@register("calendar_parts", sql=f"""SELECT series, day, CAST(year(day) AS INTEGER) AS year,
  CAST(month(day) AS INTEGER) AS month, CAST(dayofmonth(day) AS INTEGER) AS day_of_month,
  CAST(isodow(day) - 1 AS INTEGER) AS weekday FROM ({O.panel_sql()})""")
def q_calendar_parts(spark, sf):
    p = fixture_panel(spark, sf).select("series", "day")
    return fx.calendar_parts(p, "day")


@register("cyclical", sql=f"""SELECT series, day, CAST(month(day) AS INTEGER) AS month,
  {O.r('sin(2 * pi() * month(day) / 12)')} AS month_sin, {O.r('cos(2 * pi() * month(day) / 12)')} AS month_cos
  FROM ({O.panel_sql()})""")
def q_cyclical(spark, sf):
    p = fx.calendar_parts(fixture_panel(spark, sf).select("series", "day"), "day", ("month",))
    p = fx.cyclical(p, "month", 12)
    return p.withColumns({"month_sin": R("month_sin"), "month_cos": R("month_cos")})


@register("lag_feature", sql=f"""SELECT series, day, y, lag(y) OVER (PARTITION BY series ORDER BY day) AS y_prev
  FROM ({O.panel_sql()})""")
def q_lag_feature(spark, sf):
    return fx.lag_feature(fixture_panel(spark, sf).select("series", "day", "y"), "y")


@register("union_series", sql=f"""WITH p AS ({O.panel_sql()})
  SELECT series, day, y, lag(y) OVER (PARTITION BY series ORDER BY day) AS y_prev FROM p""")
def q_union_series(spark, sf):
    """Every region's series stacked, then the keyed lag.  The panel is built
    and aggregated once (a written table, as daily files of each city would
    be); the frames of the regions read their share of it."""
    from ..sources.fixture import table
    path = scratch_path(spark, f"panel-{uuid.uuid4().hex}")
    fixture_panel(spark, sf).select("series", "day", "y").write.partitionBy("series").parquet(path)
    names = [r.r_name for r in table(spark, sf, "region").select("r_name").distinct().collect()]
    p = spark.read.parquet(path)
    frames = {n: p.where(F.col("series") == n).select("day", "y") for n in sorted(names)}
    return fx.lag_feature(fx.union_series(frames), "y").select("series", "day", "y", "y_prev")


@register("drop_nulls", sql=_panel_sql_rounded(f"({O.panel_sql()})", ", y_drop")
          + " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in list(PANEL_DIGITS) + ["y", "y_drop"]))
def q_drop_nulls(spark, sf):
    return _round_panel(fx.drop_nulls(fixture_panel(spark, sf)))


_SEL = F_COMPARE + ["y"]


@register("select_features", sql=f"""WITH {O.prep_ctes(_SEL)}
  SELECT series, day, {', '.join((O.r(c, PANEL_DIGITS.get(c, 6)) if c != 'y_prev' else c) + ' AS ' + c for c in F_COMPARE)}, y FROM clean""")
def q_select_features(spark, sf):
    d = fx.select_features(prep(spark, sf, _SEL), F_COMPARE, "y")
    return d.withColumns({c: R(c, PANEL_DIGITS.get(c, 6)) for c in F_COMPARE if c != "y_prev"})


@register("cast_double", sql=f"""WITH {O.prep_ctes(F_TWO + ['y'])}
  SELECT series, day, CAST(y_prev AS DOUBLE) AS y_prev, {O.r('x_qty')} AS x_qty, CAST(y AS DOUBLE) AS y FROM clean""")
def q_cast_double(spark, sf):
    d = fx.cast_double(prep(spark, sf, F_TWO + ["y"]).select("series", "day", *F_TWO, "y"), F_TWO + ["y"])
    return d.withColumn("x_qty", R("x_qty"))


@register("log_target", sql=f"""SELECT series, day, y, {O.r('ln(1 + y)')} AS y_log FROM ({O.panel_sql()})""")
def q_log_target(spark, sf):
    p = fixture_panel(spark, sf).select("series", "day", "y")
    return fx.log_target(p, "y", out="y_log").withColumn("y_log", R("y_log"))


@register("unlog_prediction", sql=f"""WITH {O.prep_ctes(['y_prev'])},
  c AS (SELECT covar_pop(y_prev, ln(1 + y)) / var_pop(y_prev) AS w1, avg(ln(1 + y)) AS my, avg(y_prev) AS m1 FROM clean)
  SELECT s.series, s.day, s.y, {O.r('exp(c.my - c.w1 * c.m1 + c.w1 * s.y_prev) - 1')} AS prediction
  FROM clean s, c""")
def q_unlog_prediction(spark, sf):
    d = prep(spark, sf, ["y_prev"])
    m = fit(ModelSpec("log_ols", "ols", ["y_prev"], scale=False, log_target=True), d)
    return m.transform(d).select("series", "day", "y", R("prediction").alias("prediction"))


def _moments_sql(by_series: bool, names: dict | None = None) -> str:
    parts = []
    for c in F_PCA:
        label = f"'{(names or {}).get(c, c)}'"
        g = "series, " if by_series else ""
        parts.append(f"SELECT {g}{label} AS variable, {O.r(f'avg({c})', 4)} AS mean, "
                     f"{O.r(f'stddev_pop({c})', 4)} AS std FROM p" + (" GROUP BY series" if by_series else ""))
    return f"WITH p AS ({O.panel_sql()}) " + " UNION ALL ".join(parts)


@register("column_moments", sql=_moments_sql(True))
def q_column_moments(spark, sf):
    from ..functions.expand import moments
    m = moments(fixture_panel(spark, sf), F_PCA, by=["series"])
    return m.withColumns({"mean": R("mean", 4), "std": R("std", 4)})


@register("display_names", sql=_moments_sql(False, DISPLAY))
def q_display_names(spark, sf):
    from ..functions.expand import moments
    m = fx.rename_values(moments(fixture_panel(spark, sf), F_PCA), "variable", DISPLAY)
    return m.withColumns({"mean": R("mean", 4), "std": R("std", 4)})


@register("correlations", sql=f"WITH p AS ({O.panel_sql()}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {O.r(f'corr({a}, {b})')} AS corr FROM p"
    for i, a in enumerate(F_PCA) for b in F_PCA[i + 1:]))
def q_correlations(spark, sf):
    from ..operators.moments import correlations
    return correlations(fixture_panel(spark, sf), F_PCA).withColumn("corr", R("corr"))


# ================================================================== splits
_SPLIT_COLS = F_COMPARE + ["y"]
_H = O.hash_expr(SEED)


def _split_sql(select: str) -> str:
    return f"""WITH {O.prep_ctes(_SPLIT_COLS)}, h AS (SELECT *, {_H} AS h FROM clean)
  SELECT series, day, {select} FROM h"""


@register("holdout_hash", sql=_split_sql(f"{O.hash_bits('h')} / 4294967296.0 < 0.3 AS is_test"))
def q_holdout_hash(spark, sf):
    return splits.holdout(prep(spark, sf, _SPLIT_COLS), 0.3, SEED, "hash").select("series", "day", "is_test")


@register("holdout_exact", sql=_split_sql(
    "row_number() OVER (ORDER BY h, series, day) <= ceil(0.3 * count(*) OVER ()) AS is_test"))
def q_holdout_exact(spark, sf):
    return splits.holdout(prep(spark, sf, _SPLIT_COLS), 0.3, SEED, "exact").select("series", "day", "is_test")


@register("validation_split", sql=f"""WITH {O.prep_ctes(_SPLIT_COLS)}
  SELECT series, day, {O.hash_bits(O.hash_expr(SEED, '|valid'))} / 4294967296.0 < 0.2 AS is_valid FROM clean""")
def q_validation_split(spark, sf):
    return splits.validation(prep(spark, sf, _SPLIT_COLS), 0.2, SEED).select("series", "day", "is_valid")


@register("kfold_hash", sql=_split_sql(f"CAST({O.hash_bits('h')} % {K} AS INTEGER) AS fold"))
def q_kfold_hash(spark, sf):
    return splits.kfold(prep(spark, sf, _SPLIT_COLS), K, SEED, "hash").select("series", "day", "fold")


@register("kfold_exact", sql=_split_sql(f"CAST(ntile({K}) OVER (ORDER BY h, series, day) - 1 AS INTEGER) AS fold"))
def q_kfold_exact(spark, sf):
    return splits.kfold(prep(spark, sf, _SPLIT_COLS), K, SEED, "exact").select("series", "day", "fold")


@register("kfold_blocks", sql=_split_sql(f"CAST(ntile({K}) OVER (ORDER BY day, h, series) - 1 AS INTEGER) AS fold"))
def q_kfold_blocks(spark, sf):
    return splits.kfold(prep(spark, sf, _SPLIT_COLS), K, SEED, "blocks").select("series", "day", "fold")


# ======================================================= linear, SQL-checked
def _folded(spark, sf, cols, std_cols=None, mode="hash", salt=""):
    d = splits.kfold(prep(spark, sf, cols), K, SEED, mode, salt=salt)
    if std_cols:
        d = Standardizer(std_cols, suffix="_z").fit(d).transform(d)
    return d


def _zsql(std_cols) -> str:
    return "".join(f", ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}_z" for c in std_cols or [])


def _folded_sql(cols, std_cols=None, extra_fold: str = "") -> str:
    return (f"{O.prep_ctes(cols)}, f AS (SELECT *, CAST({O.hash_bits(_H)} % {K} AS INTEGER) AS fold"
            f"{extra_fold}{_zsql(std_cols)} FROM clean)")


def _cv_pred_sql(src: str, feats: list[str], alpha: str = "0.0", model: str | None = None) -> str:
    mcols = f"'{model}' AS model, " if model else ""
    return (f"SELECT {mcols}s.series, s.day, s.fold, s.y, {O.pred_expr(feats)} AS prediction FROM {src} s JOIN "
            f"(SELECT k, {O.coef_cols(len(feats), alpha)} FROM (SELECT kk.fold AS k, {O.stats_cols(feats)} "
            f"FROM {src} t JOIN (SELECT DISTINCT fold FROM {src}) kk ON t.fold <> kk.fold GROUP BY kk.fold)) c "
            f"ON s.fold = c.k")


def _metrics_sql(rel: str, by: str, digits: int = 6) -> str:
    e = "(y - prediction)"
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {sel}count(*) AS n, {O.r(f'avg(abs({e}))', digits)} AS mae, {O.r(f'avg({e} * {e})', digits)} AS mse, "
            f"{O.r(f'sqrt(avg({e} * {e}))', digits)} AS rmse, "
            f"{O.r(f'1 - sum({e} * {e}) / (var_pop(y) * count(*))', digits)} AS r2 FROM {rel}{grp}")


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: R(c) for c in ("mae", "mse", "rmse", "r2")})


def _spec_two(name="lag_qty", feats=None, kind="ols", alpha=0.0, scale=False) -> ModelSpec:
    return ModelSpec(name, kind, list(F_TWO if feats is None else feats), {"alpha": alpha}, scale=scale)


_TWO_COLS = F_TWO + ["y"]


@register("fold_gram", sql=f"""WITH {_folded_sql(_TWO_COLS)},
  g AS (SELECT fold, 1.0 AS z0, y_prev - avg(y_prev) OVER () AS z1, x_qty - avg(x_qty) OVER () AS z2,
        y - avg(y) OVER () AS z3 FROM f)
  """ + " UNION ALL ".join(f"SELECT fold, {i} AS i, {j} AS j, {O.r(f'sum(z{i} * z{j})', 4)} AS value FROM g GROUP BY fold"
                           for i in range(4) for j in range(i, 4)))
def q_fold_gram(spark, sf):
    from ..operators.moments import fold_gram
    d = _folded(spark, sf, _TWO_COLS)
    return fold_gram(d, F_TWO, "y", by=["fold"]).withColumn("value", R("value", 4))


@register("cross_validate", sql=f"""WITH {_folded_sql(_TWO_COLS)}
  SELECT series, day, fold, y, {O.r('prediction')} AS prediction FROM ({_cv_pred_sql('f', F_TWO)})""")
def q_cross_validate(spark, sf):
    d = _folded(spark, sf, _TWO_COLS)
    return cross_validate(_spec_two(), d).withColumn("prediction", R("prediction"))


@register("fold_metrics", sql=f"""WITH {_folded_sql(_TWO_COLS)}, p AS ({_cv_pred_sql('f', F_TWO)})
  {_metrics_sql('p', 'fold')}""")
def q_fold_metrics(spark, sf):
    d = _folded(spark, sf, _TWO_COLS)
    return _round_metrics(metrics(cross_validate(_spec_two(), d), "y", "prediction", ["fold"]))


@register("score_summary", sql=f"""WITH {_folded_sql(_TWO_COLS)}, p AS ({_cv_pred_sql('f', F_TWO)}),
  m AS ({_metrics_sql('p', 'fold', 15)})
  SELECT {O.r('avg(r2)')} AS mean_r2, {O.r('stddev_pop(r2)')} AS std_r2, count(*) AS folds FROM m""")
def q_score_summary(spark, sf):
    d = _folded(spark, sf, _TWO_COLS)
    sc = metrics(cross_validate(_spec_two(), d), "y", "prediction", ["fold"])
    return summarise(sc.withColumn("_g", F.lit(1)), "_g", "r2").select(
        R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), "folds")


@register("search_metric", sql=f"""WITH {_folded_sql(_TWO_COLS)}, p AS ({_cv_pred_sql('f', F_TWO)}),
  m AS ({_metrics_sql('p', 'fold', 15)})
  SELECT fold, {O.r('r2')} AS r2, {O.r('-rmse')} AS neg_rmse FROM m""")
def q_search_metric(spark, sf):
    from ..functions.metrics import search_metric
    d = _folded(spark, sf, _TWO_COLS)
    sc = metrics(cross_validate(_spec_two(), d), "y", "prediction", ["fold"])
    return sc.select("fold", R("r2").alias("r2"),
                     R(search_metric("neg_rmse", F.col("r2"), F.col("rmse"))).alias("neg_rmse"))


def _holdout_sql(cols, std_cols=None) -> str:
    return (f"{O.prep_ctes(cols)}, f AS (SELECT *, {O.hash_bits(_H)} / 4294967296.0 < 0.3 AS is_test"
            f"{_zsql(std_cols)} FROM clean)")


def _holdout(spark, sf, cols, std_cols=None):
    d = splits.holdout(prep(spark, sf, cols), 0.3, SEED, "hash")
    if std_cols:
        d = Standardizer(std_cols, suffix="_z").fit(d).transform(d)
    return d


def _holdout_pred_sql(feats, alpha="0.0") -> str:
    return (f"SELECT s.series, s.day, s.y, {O.pred_expr(feats)} AS prediction FROM f s, "
            f"(SELECT {O.coef_cols(len(feats), alpha)} FROM (SELECT {O.stats_cols(feats)} FROM f WHERE NOT is_test)) c "
            f"WHERE s.is_test")


@register("regression_metrics", sql=f"""WITH {_holdout_sql(_TWO_COLS)}, p AS ({_holdout_pred_sql(F_TWO)})
  {_metrics_sql('p', '')}""")
def q_regression_metrics(spark, sf):
    d = _holdout(spark, sf, _TWO_COLS)
    m = fit(_spec_two(), d.where(~F.col("is_test")))
    return _round_metrics(metrics(m.transform(d.where("is_test")), "y", "prediction"))


@register("actual_vs_predicted", sql=f"""WITH {_holdout_sql(_TWO_COLS)}, p AS ({_holdout_pred_sql(F_TWO)})
  SELECT series, day, CAST(y AS DOUBLE) AS actual, {O.r('prediction')} AS predicted,
    {O.r('least(min(y) OVER (), min(prediction) OVER ())')} AS axis_lo,
    {O.r('greatest(max(y) OVER (), max(prediction) OVER ())')} AS axis_hi FROM p""")
def q_actual_vs_predicted(spark, sf):
    d = _holdout(spark, sf, _TWO_COLS)
    m = fit(_spec_two(), d.where(~F.col("is_test")))
    t = charts.actual_vs_predicted(m.transform(d.where("is_test")))
    return t.withColumns({c: R(c) for c in ("predicted", "axis_lo", "axis_hi")})


# --------------------------------------------------- comparison of linear models
_CMP_MODELS = [("mean", []), ("lag", ["y_prev"]), ("lag_qty", F_TWO)]


def _cmp_scores(spark, sf) -> DataFrame:
    from ..operators.fitting import compare, fold_scores
    d = _folded(spark, sf, _TWO_COLS).cache()
    specs = [_spec_two(n, f) for n, f in _CMP_MODELS]
    return fold_scores(compare(specs, d))


def _cmp_sql() -> str:
    preds = " UNION ALL ".join(
        f"SELECT {i} AS model_order, * FROM ({_cv_pred_sql('f', feats, model=name)})"
        for i, (name, feats) in enumerate(_CMP_MODELS))
    e = "(y - prediction)"
    return (f"WITH {_folded_sql(_TWO_COLS)}, p AS ({preds}), "
            f"sc AS (SELECT model, model_order, fold, 1 - sum({e} * {e}) / (var_pop(y) * count(*)) AS r2 "
            f"FROM p GROUP BY model, model_order, fold)")


@register("rank_models", sql=_cmp_sql() + f""" SELECT fold, model, {O.r('r2')} AS r2,
  CAST(row_number() OVER (PARTITION BY fold ORDER BY r2 DESC, model_order) AS INTEGER) AS rank FROM sc""")
def q_rank_models(spark, sf):
    r = selection.rank_models(_cmp_scores(spark, sf))
    return r.select("fold", "model", R("r2").alias("r2"), "rank")


_BOARD_SQL = _cmp_sql() + """, b AS (SELECT model, model_order, avg(r2) AS mean, stddev_pop(r2) AS std FROM sc GROUP BY model, model_order),
  bp AS (SELECT *, CAST(row_number() OVER (ORDER BY mean DESC, model_order) AS INTEGER) AS position FROM b)"""


@register("leaderboard", sql=_BOARD_SQL + f" SELECT model, {O.r('mean')} AS mean, {O.r('std')} AS std, position FROM bp")
def q_leaderboard(spark, sf):
    b = selection.leaderboard(_cmp_scores(spark, sf))
    return b.select("model", R("mean").alias("mean"), R("std").alias("std"), "position")


@register("top_models", sql=_BOARD_SQL + f" SELECT model, {O.r('mean')} AS mean, position FROM bp WHERE position <= 2")
def q_top_models(spark, sf):
    b = selection.top(selection.leaderboard(_cmp_scores(spark, sf)), 2)
    return b.select("model", R("mean").alias("mean"), "position")


@register("stability_flag", sql=_BOARD_SQL + f""" SELECT model, {O.r('std')} AS std,
  CASE WHEN std < 0.05 THEN 'OK' ELSE 'CHECK' END AS status FROM bp WHERE position <= 2""")
def q_stability_flag(spark, sf):
    b = selection.stability(selection.leaderboard(_cmp_scores(spark, sf)), 0.05, 2)
    return b.select("model", R("std").alias("std"), "status")


@register("box_summary", sql=_cmp_sql() + f""", q AS (SELECT model, quantile_cont(r2, 0.25) AS q1,
    quantile_cont(r2, 0.5) AS median, quantile_cont(r2, 0.75) AS q3 FROM sc GROUP BY model),
  j AS (SELECT sc.model, r2, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM sc JOIN q ON sc.model = q.model)
  SELECT model, {O.r('q1')} AS q1, {O.r('median')} AS median, {O.r('q3')} AS q3,
    {O.r('min(CASE WHEN r2 >= lo AND r2 <= hi THEN r2 END)')} AS whisker_lo,
    {O.r('max(CASE WHEN r2 >= lo AND r2 <= hi THEN r2 END)')} AS whisker_hi,
    CAST(sum(CASE WHEN r2 >= lo AND r2 <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
  FROM j GROUP BY model, q1, median, q3""")
def q_box_summary(spark, sf):
    b = charts.box_summary(_cmp_scores(spark, sf), "model", "r2", exact=True)   # 5 scores per model
    return b.select("model", *[R(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")], "n_outliers")


@register("fold_lines", sql=_cmp_sql() + f" SELECT model, fold + 1 AS fold_no, {O.r('r2')} AS r2 FROM sc")
def q_fold_lines(spark, sf):
    t = charts.fold_lines(_cmp_scores(spark, sf))
    return t.withColumn("r2", R("r2"))


# ============================================== supplier-keyed panel (many series)
_SUP_COLS = F_TWO + ["y"]


@register("supplier_kfold_exact", sql=f"""WITH {O.prep_ctes(_SUP_COLS, 'supplier')}, h AS (SELECT *, {_H} AS h FROM clean)
  SELECT series, day, CAST(ntile({K}) OVER (ORDER BY h, series, day) - 1 AS INTEGER) AS fold FROM h""")
def q_supplier_kfold_exact(spark, sf):
    d = prep(spark, sf, _SUP_COLS, key="supplier")
    return splits.kfold(d, K, SEED, "exact").select("series", "day", "fold")


@register("supplier_fold_metrics", sql=f"""WITH {O.prep_ctes(_SUP_COLS, 'supplier')},
  f AS (SELECT *, CAST({O.hash_bits(_H)} % {K} AS INTEGER) AS fold FROM clean), p AS ({_cv_pred_sql('f', F_TWO)})
  {_metrics_sql('p', 'fold')}""")
def q_supplier_fold_metrics(spark, sf):
    d = splits.kfold(prep(spark, sf, _SUP_COLS, key="supplier"), K, SEED, "hash")
    return _round_metrics(metrics(cross_validate(_spec_two(), d), "y", "prediction", ["fold"]))
