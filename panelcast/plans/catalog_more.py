"""Registered queries, part four: workbooks, streams with state, solvers and
components without p x p numbers, successive halving, mergeable box summaries
and adaptive cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expand import Standardizer
from ..functions.features import rounded as R
from ..operators import charts, linear, wide
from ..operators import pca as pca_op
from ..operators.fitting import fit
from ..session import scratch_path
from ..sources import io
from ..sources.fixture import fixture_panel
from . import oracle as O
from .catalog import (_TWO_COLS, _holdout, _holdout_pred_sql, _holdout_sql, _panel_sql_rounded, _round_metrics, _round_panel,
                      _spec_two, ALPHAS, K, ORACLES, SEED, register)
from .catalog_models import _HOLD_SQL, _PCA_RATIO, _PCA_WITH, _board, _coef_unpivot, _cv_grid_sql, _dz, _saved_model, _zf_sql, Z
from .common import DISPLAY, F_PCA, F_TWO, prep


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ workbooks
WORKBOOKS = {"sheets": "*", "seriesColumn": "series", "seriesFrom": "sheet"}


@register("read_workbook", sql=_panel_sql_rounded(f"({O.panel_sql()})", ", y_drop"))
def q_read_workbook(spark, sf):
    """The panel as a folder of workbooks with a sheet per series, read back by
    one task for each file and sheet."""
    from ..sources.workbook import write_workbooks
    p = fixture_panel(spark, sf)
    path = write_workbooks(p, _scratch(spark, "workbooks"), files=8)
    return _round_panel(io.read_panel(spark, path, schema=p.schema, fmt="workbook", required=["series", "day", "y"], options=WORKBOOKS))


@register("workbook_lag", sql=f"""SELECT series, day, y, lag(y) OVER (PARTITION BY series ORDER BY day) AS y_prev
  FROM ({O.panel_sql()})""")
def q_workbook_lag(spark, sf):
    """The start of every study: workbooks, three of their columns parsed, then
    the previous row of each series."""
    from ..functions.features import lag_feature
    from ..sources.workbook import write_workbooks
    path = write_workbooks(fixture_panel(spark, sf), _scratch(spark, "workbooks"), files=8)
    return lag_feature(io.read_panel(spark, path, schema="series string, day date, y long", fmt="workbook", options=WORKBOOKS), "y")


# -------------------------------------------------------------------- streams
def _by_day(df: DataFrame, parts: int) -> list[DataFrame]:
    """The rows in ``parts`` spans of days, as they would arrive."""
    cuts = df.select(F.unix_date("day").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.01)
    d, out, low = F.unix_date("day"), [], None
    for high in [*cuts, None]:
        inside = F.lit(True) if low is None else d >= low
        out.append(df.where(inside if high is None else inside & (d < high)))
        low = high
    return out


@register("lag_stream", sql=f"""SELECT series, day, y, lag(y) OVER (PARTITION BY series ORDER BY day) AS y_prev, 'on time' AS lag_status
  FROM ({O.panel_sql()})""")
def q_lag_stream(spark, sf):
    """Records arrive in four spans of days; the query is started anew for each
    and finds each series' previous row in its state."""
    from ..streaming.lag import lag_stream, rocksdb_state
    base, p = _scratch(spark, "lag-stream"), fixture_panel(spark, sf).select("series", "day", "y").persist()
    for part in _by_day(p, 4):
        part.write.mode("append").parquet(f"{base}/in")
        rows = lag_stream(spark.readStream.schema(p.schema).parquet(f"{base}/in"), "y")
        with rocksdb_state(spark):
            query = (rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
                     .trigger(availableNow=True).start())
        query.awaitTermination()
    p.unpersist()
    return spark.read.parquet(f"{base}/out")


@register("score_records", sql=_HOLD_SQL + f""" SELECT s.series, s.day, {O.r('co.b0 + co.w1 * s.y_prev + co.w2 * s.x_qty')} AS prediction
  FROM f s, co""")
def q_score_records(spark, sf):
    """As ``score_stream``, but the records hold no previous row: it comes from
    the stream's state, over four restarts."""
    from ..streaming.lag import score_records
    _, model = _saved_model(spark, sf)
    base, p = _scratch(spark, "records"), fixture_panel(spark, sf).select("series", "day", "x_qty", "y").persist()
    for part in _by_day(p, 4):
        part.write.mode("append").parquet(f"{base}/in")
        score_records(spark, f"{base}/in", model, f"{base}/out", f"{base}/chk", p.schema,
                      dropna=_TWO_COLS, keep=["series", "day"]).awaitTermination()
    p.unpersist()
    return spark.read.parquet(f"{base}/out").withColumn("prediction", R("prediction"))


_E = "(t.y - s.prediction)"


@register("stream_metrics", sql=_HOLD_SQL + f""",
  s AS (SELECT f.series, f.day, co.b0 + co.w1 * f.y_prev + co.w2 * f.x_qty AS prediction, date_diff('day', DATE '1970-01-01', f.day) // 28 AS w FROM f, co),
  t AS (SELECT series, day, y FROM panel WHERE x_ret IS NOT NULL),
  g AS (SELECT w, count(t.y) AS n, count(*) FILTER (t.y IS NULL) AS n_unmatched, avg(abs({_E})) AS mae, avg({_E} * {_E}) AS mse,
    sum({_E} * {_E}) AS sse, var_pop(t.y) * count(t.y) AS sst FROM s LEFT JOIN t ON s.series = t.series AND s.day = t.day GROUP BY w)
  SELECT CAST(DATE '1970-01-01' + CAST(28 * w AS INTEGER) AS DATE) AS window_start, CAST(DATE '1970-01-01' + CAST(28 * w + 28 AS INTEGER) AS DATE) AS window_end,
    n, n_unmatched, {O.r('mae')} AS mae, {O.r('mse')} AS mse, {O.r('sqrt(mse)')} AS rmse, {O.r('CASE WHEN sst > 0 THEN 1 - sse / sst END')} AS r2 FROM g""")
def q_stream_metrics(spark, sf):
    """A scored stream against the truths that follow it (days without a return
    never get one), both in three spans of days; a record of a later day in each
    stream moves the watermark on, which closes the last windows."""
    from ..streaming.evaluation import evaluate_stream
    d, model = _saved_model(spark, sf)
    scored = io.score_batch(d, model, keep=["series", "day"]).persist()
    truths = fixture_panel(spark, sf).where("x_ret is not null").select("series", "day", "y").persist()
    base = _scratch(spark, "stream-metrics")
    end = scored.agg(F.date_add(F.max("day"), 400).alias("day")).first()["day"]
    ends = [spark.createDataFrame([("end", end, value)], x.schema) for x, value in ((scored, 0.0), (truths, 0))]
    for part in zip([*_by_day(scored, 3), ends[0]], [*_by_day(truths, 3), ends[1]]):
        for rows, name in zip(part, ("predictions", "truths")):
            rows.write.mode("append").parquet(f"{base}/{name}")
        evaluate_stream(spark, f"{base}/predictions", f"{base}/truths", f"{base}/out", f"{base}/chk",
                        scored.schema, truths.schema).awaitTermination()
    scored.unpersist()
    truths.unpersist()
    return _round_metrics(spark.read.parquet(f"{base}/out"))


# ------------------------------------------------- without p x p on the driver
@register("wide_ols", sql=f"""WITH {O.prep_ctes(_TWO_COLS)}, st AS (SELECT {O.stats_cols(F_TWO)} FROM clean),
  co AS (SELECT {O.coef_cols(2)} FROM st) {_coef_unpivot('co', '')}""")
def q_wide_ols(spark, sf):
    m = wide.fit_wide(prep(spark, sf, _TWO_COLS), wide.Columns(tuple(F_TWO)), "y")
    return spark.createDataFrame([("(intercept)", m.intercept), *m.coef_rows()], "term string, coef double").withColumn("coef", R("coef"))


def _wide_grid(spark, sf, kind: str) -> DataFrame:
    d = _dz(spark, sf, "").persist()
    cands = linear.linear_candidates(kind, ALPHAS)
    b = _board(spark, cands, wide.cv_scores_wide(d, wide.Columns(tuple(Z)), "y", cands))
    d.unpersist()
    return b.select("candidate", "alpha", R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), "rank")


def _wide_grid_sql(kind: str) -> str:
    return f"""WITH {_zf_sql()}, {_cv_grid_sql(kind)},
  b AS (SELECT alpha_idx, alpha, avg(r2) AS m, stddev_pop(r2) AS s FROM gsc GROUP BY alpha_idx, alpha)
  SELECT alpha_idx AS candidate, alpha, {O.r('m')} AS mean_r2, {O.r('s')} AS std_r2,
    CAST(row_number() OVER (ORDER BY m DESC, alpha_idx) AS INTEGER) AS rank FROM b"""


@register("wide_ridge_search", sql=_wide_grid_sql("ridge"))
def q_wide_ridge_search(spark, sf):
    """Ten penalties on five folds by conjugate gradients."""
    return _wide_grid(spark, sf, "ridge")


@register("wide_lasso_search", sql=_wide_grid_sql("lasso").replace("ORDER BY m DESC", f"ORDER BY {O.r('m', 9)} DESC"))
def q_wide_lasso_search(spark, sf):
    """Ten penalties on five folds by proximal gradients with screening; equal
    scores (all coefficients zero) rank by penalty."""
    from pyspark.sql import Window
    b = _wide_grid(spark, sf, "lasso").drop("rank")
    return b.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_r2"), "candidate")))


@register("nested_cv_table", sql=ORACLES["nested_cv"])
def q_nested_cv_table(spark, sf):
    """The nested search with its 25 Gram matrices as a table: the inner paths
    and the refits are solved by tasks."""
    from ..operators import splits
    d = splits.nested_folds(prep(spark, sf, _TWO_COLS), K, K, SEED, "hash")
    d = Standardizer(F_TWO, suffix="_z").fit(d).transform(d)
    blocks, _ = linear.gram_table(d, Z, "y", ["fold", "inner"], _scratch(spark, "gram"))
    cands = linear.linear_candidates("ridge", ALPHAS)
    alpha = F.array(*[F.lit(c["alpha"]) for c in cands])
    return linear.table_nested(blocks, len(Z) + 2, cands).select(
        "fold", F.element_at(alpha, F.col("candidate") + 1).alias("alpha"), R("inner_score").alias("inner_score"), R("r2").alias("r2"))


@register("pca_subspace", sql=_PCA_WITH + _PCA_RATIO + f""" SELECT variable, 'PC' || component AS component, component AS component_no,
  {O.r('loading')} AS loading, {O.r('ratio')} AS ratio FROM load JOIN r USING (component) WHERE component <= 3""")
def q_pca_subspace(spark, sf):
    """The first three components by subspace iteration and a tree-reduced QR."""
    d = fixture_panel(spark, sf).select(*F_PCA).dropna().persist()      # nothing else is read
    m = pca_op.pca_subspace(d, F_PCA, 3)
    d.unpersist()
    ratio = m.explained(spark).select(F.col("component").alias("component_no"), R("ratio").alias("ratio"))
    return (m.loadings(spark, DISPLAY).join(ratio, "component_no")
            .select("variable", "component", "component_no", R("loading").alias("loading"), "ratio"))


# --------------------------------------------------------------- the network
@register("network_halving")
def q_network_halving(spark, sf):
    """Successive halving over six random trials of at most 18 epochs (the
    reference's 25 trials of 400 by ``studies.network_search``): epochs, rung and
    best validation loss of each."""
    from .studies import network_search
    return network_search(spark, sf, trials=6, epochs=18, first=2)["trials"].withColumn("val_loss", R("val_loss"))


# -------------------------------------------------------------------- figures
def _box_sql(value: str) -> str:
    at = lambda share: f"max(CASE WHEN rn = ceil({share} * n) THEN v END)"
    return f"""WITH p AS ({O.panel_sql()}), o AS (SELECT series, {value} AS v, row_number() OVER (PARTITION BY series ORDER BY {value}) AS rn,
    count(*) OVER (PARTITION BY series) AS n FROM p WHERE {value} IS NOT NULL),
  q AS (SELECT series, n, {at(0.25)} AS q1, {at(0.5)} AS median, {at(0.75)} AS q3 FROM o GROUP BY series, n),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
  SELECT series, f.n, {O.r('q1', 4)} AS q1, {O.r('median', 4)} AS median, {O.r('q3', 4)} AS q3,
    {O.r('min(v) FILTER (v >= lo)', 4)} AS whisker_lo, {O.r('max(v) FILTER (v <= hi)', 4)} AS whisker_hi,
    count(*) FILTER (v < lo OR v > hi) AS n_outliers FROM o JOIN f USING (series) GROUP BY series, f.n, q1, median, q3"""


@register("box_sketches", sql=_box_sql("x_price"))
def q_box_sketches(spark, sf):
    """A sketch per series and month, kept as a table; a series' box from its
    months' sketches, without its rows (exact here: no series has more than
    ``charts.SKETCH_K`` days)."""
    path = _scratch(spark, "sketches")
    p = fixture_panel(spark, sf).withColumn("month", F.trunc("day", "month"))
    charts.value_sketches(p, ["series", "month"], "x_price").write.parquet(path)
    box = charts.sketch_box(charts.merge_sketches(spark.read.parquet(path), ["series"]), ["series"])
    return box.withColumns({c: R(c, 4) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")})


CELL_BOUND, CELL_DEPTH = 60, 6


@register("scatter_cells", sql=f"""WITH {_holdout_sql(_TWO_COLS)}, p0 AS ({_holdout_pred_sql(F_TWO)}),
  p AS (SELECT CAST(y AS DOUBLE) AS x, {O.r('prediction')} AS y FROM p0),
  lim AS (SELECT least(min(x), min(y)) AS lo, greatest(max(x), max(y)) - least(min(x), min(y)) AS side FROM p),
  c AS (SELECT CAST(least(greatest(floor((x - lo) / side * {1 << CELL_DEPTH}), 0), {(1 << CELL_DEPTH) - 1}) AS INTEGER) AS ix,
    CAST(least(greatest(floor((y - lo) / side * {1 << CELL_DEPTH}), 0), {(1 << CELL_DEPTH) - 1}) AS INTEGER) AS iy FROM p, lim),
  a AS (SELECT CAST(l AS INTEGER) AS level, CAST(ix >> CAST({CELL_DEPTH} - l AS INTEGER) AS INTEGER) AS ix,
    CAST(iy >> CAST({CELL_DEPTH} - l AS INTEGER) AS INTEGER) AS iy, count(*) AS n FROM c, range({CELL_DEPTH + 1}) r(l) GROUP BY ALL)
  SELECT a.level, a.ix, a.iy, a.n, {O.r(f'lo + a.ix * side / pow(2, a.level)')} AS x0, {O.r(f'lo + a.iy * side / pow(2, a.level)')} AS y0,
    {O.r('side / pow(2, a.level)')} AS side
  FROM a LEFT JOIN a b ON b.level = a.level - 1 AND b.ix = a.ix // 2 AND b.iy = a.iy // 2, lim
  WHERE (a.level = 0 OR b.n > {CELL_BOUND}) AND (a.n <= {CELL_BOUND} OR a.level = {CELL_DEPTH})""")
def q_scatter_cells(spark, sf):
    """Actual against predicted on the holdout, as adaptive cells."""
    d = _holdout(spark, sf, _TWO_COLS)
    m = fit(_spec_two(), d.where(~F.col("is_test")))
    t = m.transform(d.where("is_test")).withColumn("prediction", R("prediction"))
    cells = charts.scatter_cells(t, bound=CELL_BOUND, depth=CELL_DEPTH)
    return cells.withColumns({c: R(c) for c in ("x0", "y0", "side")})
