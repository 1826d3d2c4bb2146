"""Registered queries, part two: penalised linear models, searches,
scaling and expansion, persistence and streaming (SQL-checked on two
inputs), then PCA, trees, boosting and the network (row checks, with
NumPy checks in the tests)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expand import Standardizer, poly, poly_names
from ..functions.features import rounded as R
from ..functions.metrics import metrics, summarise
from ..operators import linear, selection, splits
from ..operators.fitting import ModelSpec, cross_validate, fit
from ..session import scratch_path
from ..sources import io
from . import oracle as O
from .catalog import (ALPHAS, K, SEED, _H, _TWO_COLS, _folded, _metrics_sql, _round_metrics, register)
from .common import F_LINEAR, F_TWO, prep

Z = [c + "_z" for c in F_TWO]
NAMES = dict(zip(Z, F_TWO))


def _dz(spark, sf, fold_salt: str | None = None):
    d = prep(spark, sf, _TWO_COLS)
    if fold_salt is not None:
        d = splits.kfold(d, K, SEED, "hash", salt=fold_salt)
    return Standardizer(F_TWO, suffix="_z").fit(d).transform(d)


def _alpha_values() -> str:
    rows = ", ".join(f"({i}, CAST('{a!r}' AS DOUBLE))" for i, a in enumerate(ALPHAS))
    return f"(SELECT * FROM (VALUES {rows}) v(alpha_idx, alpha))"


def _zsql(cols) -> str:
    return ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}_z" for c in cols)


def _coef_unpivot(rel: str, keys: str, b0="b0", w1="w1", w2="w2") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(
        f"SELECT {k}'{t}' AS term, {O.r(e)} AS coef FROM {rel}"
        for t, e in (("(intercept)", b0), (F_TWO[0], w1), (F_TWO[1], w2)))


def _path(spark, sf, kind: str) -> DataFrame:
    gs = linear.GramSet(_dz(spark, sf), Z, "y", by=())
    rows = []
    for i, a in enumerate(ALPHAS):
        s = gs.stats()
        w, b = linear.solve(s, kind, a)
        icpt = linear.unshift(w, b, gs.shift)
        rows.append((i, a, "(intercept)", icpt))
        rows += [(i, a, NAMES[z], float(c)) for z, c in zip(Z, w)]
    df = spark.createDataFrame(rows, "alpha_idx int, alpha double, term string, coef_raw double")
    return df


_ZBASE = f"{O.prep_ctes(_TWO_COLS)}, z AS (SELECT *, {_zsql(F_TWO)} FROM clean), st AS (SELECT {O.stats_cols(Z)} FROM z)"


@register("ols", sql=f"""WITH {O.prep_ctes(_TWO_COLS)}, st AS (SELECT {O.stats_cols(F_TWO)} FROM clean),
  co AS (SELECT {O.coef_cols(2)} FROM st) {_coef_unpivot('co', '')}""")
def q_ols(spark, sf):
    m = linear.fit_linear(prep(spark, sf, _TWO_COLS), F_TWO, "y", "ols")
    rows = [("(intercept)", m.intercept)] + m.coef_rows()
    return spark.createDataFrame(rows, "term string, coef double").withColumn("coef", R("coef"))


@register("ridge_path", sql=f"""WITH {_ZBASE}, co AS (SELECT alpha_idx, alpha, {O.coef_cols(2, 'alpha')} FROM st, {_alpha_values()})
  {_coef_unpivot('co', 'alpha_idx, alpha')}""")
def q_ridge_path(spark, sf):
    return _path(spark, sf, "ridge").select("alpha_idx", "alpha", "term", R("coef_raw").alias("coef"))


_LASSO_CO = (f"co0 AS (SELECT alpha_idx, alpha, my, m1, m2, {O.lasso2_coef('alpha')} AS w FROM st, {_alpha_values()}), "
             "co AS (SELECT alpha_idx, alpha, w[1] AS w1, w[2] AS w2, my - w[1] * m1 - w[2] * m2 AS b0 FROM co0)")


@register("lasso_path", sql=f"WITH {_ZBASE}, {_LASSO_CO} {_coef_unpivot('co', 'alpha_idx, alpha')}")
def q_lasso_path(spark, sf):
    return _path(spark, sf, "lasso").select("alpha_idx", "alpha", "term", R("coef_raw").alias("coef"))


@register("nonzero_coefs", sql=f"""WITH {_ZBASE}, {_LASSO_CO},
  t AS (SELECT alpha_idx, '{F_TWO[0]}' AS term, w1 AS c FROM co UNION ALL SELECT alpha_idx, '{F_TWO[1]}', w2 FROM co)
  SELECT alpha_idx, term, {O.r('c')} AS coef FROM t WHERE c <> 0""")
def q_nonzero_coefs(spark, sf):
    p = _path(spark, sf, "lasso").where(F.col("term") != "(intercept)")
    return p.where(F.col("coef_raw") != 0).select("alpha_idx", "term", R("coef_raw").alias("coef"))


@register("selected_vs_eliminated", sql=f"""WITH {_ZBASE}, {_LASSO_CO},
  t AS (SELECT alpha_idx, '{F_TWO[0]}' AS term, w1 AS c FROM co UNION ALL SELECT alpha_idx, '{F_TWO[1]}', w2 FROM co)
  SELECT alpha_idx, term, c <> 0 AS selected FROM t""")
def q_selected_vs_eliminated(spark, sf):
    p = _path(spark, sf, "lasso").where(F.col("term") != "(intercept)")
    return p.select("alpha_idx", "term", (F.col("coef_raw") != 0).alias("selected"))


@register("coef_by_abs", sql=f"""WITH {_ZBASE}, co AS (SELECT {O.coef_cols(2)} FROM st),
  t AS (SELECT '{F_TWO[0]}' AS term, w1 AS c FROM co UNION ALL SELECT '{F_TWO[1]}', w2 FROM co)
  SELECT term, {O.r('c')} AS coef, CAST(row_number() OVER (ORDER BY abs(c) DESC, term) AS INTEGER) AS position
  FROM t WHERE c <> 0""")
def q_coef_by_abs(spark, sf):
    m = linear.fit_linear(_dz(spark, sf), Z, "y", "ols")
    t = spark.createDataFrame([(NAMES[z], c) for z, c in m.coef_rows()], "term string, coef double")
    return selection.sort_coefs(t).select("term", R("coef").alias("coef"), "position")


@register("coef_table", sql=f"""WITH {O.prep_ctes(_TWO_COLS)},
  z AS (SELECT (y_prev - avg(y_prev) OVER ()) / stddev_pop(y_prev) OVER () AS zz, y FROM clean),
  zp AS (SELECT zz AS t1, zz * zz AS t2, y FROM z), st AS (SELECT {O.stats_cols(['t1', 't2'])} FROM zp),
  co AS (SELECT {O.coef_cols(2)} FROM st)
  SELECT '(intercept)' AS term, {O.r('b0')} AS coef FROM co UNION ALL SELECT 'y_prev', {O.r('w1')} FROM co
  UNION ALL SELECT 'y_prev^2', {O.r('w2')} FROM co""")
def q_coef_table(spark, sf):
    spec = ModelSpec("poly_ols", "ols", ["y_prev"], degree=2, scale=True)
    m = fit(spec, prep(spark, sf, _TWO_COLS))
    rows = [("(intercept)", m.linear.intercept)] + m.linear.coef_rows(spec.term_names())
    return spark.createDataFrame(rows, "term string, coef double").withColumn("coef", R("coef"))


# ------------------------------------------------------------------ searches
def _grid_scores(gs: linear.GramSet, cands: list[dict]) -> list[dict]:
    return linear.cv_scores(gs, cands)


def _cv_grid_sql(kind: str, src: str = "z", cand_rel: str | None = None) -> str:
    """CTEs ``gst`` (train stats per fold), ``gco`` (coefs per fold x
    candidate), ``gsc`` (r2 per candidate x fold) for a candidate relation
    with ``alpha_idx, alpha`` (and ``kind`` when mixing families)."""
    cand = cand_rel or _alpha_values()
    if kind == "ridge":
        co = f"gco AS (SELECT k, alpha_idx, alpha, {O.coef_cols(2, 'alpha')} FROM gst, {cand} c)"
    elif kind == "lasso":
        co = (f"gco0 AS (SELECT k, alpha_idx, alpha, my, m1, m2, {O.lasso2_coef('alpha')} AS w FROM gst, {cand} c), "
              "gco AS (SELECT k, alpha_idx, alpha, w[1] AS w1, w[2] AS w2, my - w[1] * m1 - w[2] * m2 AS b0 FROM gco0)")
    else:  # mixed: candidate relation has a kind column
        co = (f"gco0 AS (SELECT k, alpha_idx, alpha, kind, my, m1, m2, "
              f"CASE WHEN kind = 'lasso' THEN {O.lasso2_coef('alpha')} "
              f"ELSE [{', '.join(O.ridge2_ws('alpha'))}] END AS w FROM gst, {cand} c), "
              "gco AS (SELECT k, alpha_idx, alpha, w[1] AS w1, w[2] AS w2, my - w[1] * m1 - w[2] * m2 AS b0 FROM gco0)")
    e = f"(s.y - (gco.b0 + gco.w1 * s.{Z[0]} + gco.w2 * s.{Z[1]}))"
    return (f"gst AS (SELECT kk.fold AS k, {O.stats_cols(Z)} FROM {src} t JOIN (SELECT DISTINCT fold FROM {src}) kk "
            f"ON t.fold <> kk.fold GROUP BY kk.fold), {co}, "
            f"gsc AS (SELECT gco.alpha_idx, gco.alpha, s.fold, 1 - sum({e} * {e}) / (var_pop(s.y) * count(*)) AS r2 "
            f"FROM {src} s JOIN gco ON s.fold = gco.k GROUP BY gco.alpha_idx, gco.alpha, s.fold)")


def _zf_sql(salt: str = "") -> str:
    return (f"{O.prep_ctes(_TWO_COLS)}, z AS (SELECT *, CAST({O.hash_bits(O.hash_expr(SEED, salt))} % {K} AS INTEGER) "
            f"AS fold, {_zsql(F_TWO)} FROM clean)")


def _search(spark, sf, kind: str) -> tuple[list[dict], list[dict]]:
    gs = linear.GramSet(_dz(spark, sf, ""), Z, "y", by=["fold"])
    cands = linear.linear_candidates(kind, ALPHAS)
    return cands, _grid_scores(gs, cands)


def _board(spark, cands, scores) -> DataFrame:
    rows = [(s["candidate"], cands[s["candidate"]]["alpha"], s["fold"], s["r2"]) for s in scores]
    t = spark.createDataFrame(rows, "candidate int, alpha double, fold int, r2 double")
    g = summarise(t, ["candidate", "alpha"], "r2")
    from pyspark.sql import Window
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_r2").desc(), "candidate")))


@register("grid_search", sql=f"""WITH {_zf_sql()}, {_cv_grid_sql('ridge')},
  b AS (SELECT alpha_idx, alpha, avg(r2) AS m, stddev_pop(r2) AS s FROM gsc GROUP BY alpha_idx, alpha)
  SELECT alpha_idx AS candidate, alpha, {O.r('m')} AS mean_r2, {O.r('s')} AS std_r2,
    CAST(row_number() OVER (ORDER BY m DESC, alpha_idx) AS INTEGER) AS rank FROM b""")
def q_grid_search(spark, sf):
    cands, scores = _search(spark, sf, "ridge")
    b = _board(spark, cands, scores)
    return b.select("candidate", "alpha", R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), "rank")


@register("best_candidate", sql=f"""WITH {_zf_sql()}, {_cv_grid_sql('ridge')},
  b AS (SELECT alpha_idx, alpha, avg(r2) AS m FROM gsc GROUP BY alpha_idx, alpha)
  SELECT alpha_idx AS candidate, alpha, {O.r('m')} AS mean_score FROM b ORDER BY m DESC, alpha_idx LIMIT 1""")
def q_best_candidate(spark, sf):
    cands, scores = _search(spark, sf, "ridge")
    rows = [(s["candidate"], cands[s["candidate"]]["alpha"], s["r2"]) for s in scores]
    t = spark.createDataFrame(rows, "candidate int, alpha double, score double")
    b = selection.best_candidate(t, "score", "candidate")
    alpha = {i: c["alpha"] for i, c in enumerate(cands)}
    m = F.create_map(*[F.lit(x) for kv in alpha.items() for x in kv])
    return b.select("candidate", m[F.col("candidate")].alias("alpha"), R("mean_score").alias("mean_score"))


def _family_best_sql(kind: str) -> str:
    return (f"SELECT '{kind}' AS family, alpha, avg(r2) AS m, alpha_idx FROM gsc GROUP BY alpha_idx, alpha "
            "ORDER BY m DESC, alpha_idx LIMIT 1")


@register("best_family", sql=f"""WITH {_zf_sql()},
  rb AS (WITH {_cv_grid_sql('ridge')} {_family_best_sql('ridge')}),
  lb AS (WITH {_cv_grid_sql('lasso')} {_family_best_sql('lasso')})
  SELECT CASE WHEN rb.m > lb.m THEN 'ridge' ELSE 'lasso' END AS family,
    CASE WHEN rb.m > lb.m THEN rb.alpha ELSE lb.alpha END AS alpha,
    {O.r('rb.m')} AS ridge_score, {O.r('lb.m')} AS lasso_score FROM rb, lb""")
def q_best_family(spark, sf):
    gs = linear.GramSet(_dz(spark, sf, ""), Z, "y", by=["fold"])
    res = {}
    for kind in ("ridge", "lasso"):
        cands = linear.linear_candidates(kind, ALPHAS)
        ci, score = linear.best_of(linear.cv_scores(gs, cands), len(cands))
        res[kind] = (cands[ci]["alpha"], score)
    fam = selection.best_family("ridge", res["ridge"][1], "lasso", res["lasso"][1])
    row = [(fam, res[fam][0], res["ridge"][1], res["lasso"][1])]
    return spark.createDataFrame(row, "family string, alpha double, ridge_score double, lasso_score double") \
        .withColumns({"ridge_score": R("ridge_score"), "lasso_score": R("lasso_score")})


_RGRID = {"alpha": ALPHAS, "kind": ["lasso", "ridge"]}
N_DRAW = 4


def _rgrid_sql() -> str:
    rows = ", ".join(f"({i}, CAST('{c['alpha']!r}' AS DOUBLE), '{c['kind']}')"
                     for i, c in enumerate(splits.grid_candidates(_RGRID)))
    return (f"(SELECT candidate AS alpha_idx, alpha, kind, CAST(row_number() OVER (ORDER BY md5(CAST(candidate AS VARCHAR) || '|{SEED}')) - 1 AS INTEGER) AS draw "
            f"FROM (VALUES {rows}) v(candidate, alpha, kind) ORDER BY md5(CAST(candidate AS VARCHAR) || '|{SEED}') LIMIT {N_DRAW})")


@register("random_search", sql=f"""WITH {_zf_sql()}, {_cv_grid_sql('mixed', cand_rel=_rgrid_sql())},
  d AS {_rgrid_sql()}
  SELECT d.draw, d.alpha_idx AS candidate, d.kind, d.alpha, {O.r('avg(gsc.r2)')} AS mean_r2
  FROM gsc JOIN d ON gsc.alpha_idx = d.alpha_idx GROUP BY d.draw, d.alpha_idx, d.kind, d.alpha""")
def q_random_search(spark, sf):
    grid = splits.param_grid(spark, _RGRID)
    sample = splits.param_sample(grid, N_DRAW, SEED).collect()   # n candidates (small by construction)
    cands = [{"kind": r["kind"], "alpha": r["alpha"]} for r in sample]
    gs = linear.GramSet(_dz(spark, sf, ""), Z, "y", by=["fold"])
    sc = linear.cv_scores(gs, cands)
    rows = []
    for i, r in enumerate(sample):
        vals = [s["r2"] for s in sc if s["candidate"] == i]
        rows.append((r["draw"], r["candidate"], r["kind"], r["alpha"], float(np.mean(vals))))
    return spark.createDataFrame(rows, "draw int, candidate int, kind string, alpha double, mean_r2 double") \
        .withColumn("mean_r2", R("mean_r2"))


# ------------------------------------------------------------- nested search
_NESTED = f"""WITH {O.prep_ctes(_TWO_COLS)}, z AS (SELECT *,
    CAST({O.hash_bits(O.hash_expr(SEED))} % {K} AS INTEGER) AS fold,
    CAST({O.hash_bits(O.hash_expr(SEED, '|inner'))} % {K} AS INTEGER) AS inner_fold, {_zsql(F_TWO)} FROM clean),
  ko AS (SELECT DISTINCT fold AS k FROM z), ki AS (SELECT DISTINCT inner_fold AS j FROM z),
  ist AS (SELECT ko.k, ki.j, {O.stats_cols(Z)} FROM z t JOIN ko ON t.fold <> ko.k JOIN ki ON t.inner_fold <> ki.j GROUP BY ko.k, ki.j),
  ico AS (SELECT k, j, alpha_idx, alpha, {O.coef_cols(2, 'alpha')} FROM ist, {_alpha_values()} c),
  isc AS (SELECT ico.k, ico.j, ico.alpha_idx, ico.alpha,
      1 - sum((s.y - (ico.b0 + ico.w1 * s.{Z[0]} + ico.w2 * s.{Z[1]})) * (s.y - (ico.b0 + ico.w1 * s.{Z[0]} + ico.w2 * s.{Z[1]})))
        / (var_pop(s.y) * count(*)) AS r2
    FROM z s JOIN ico ON s.fold <> ico.k AND s.inner_fold = ico.j GROUP BY ico.k, ico.j, ico.alpha_idx, ico.alpha),
  ib AS (SELECT k, alpha_idx, alpha, avg(r2) AS m, row_number() OVER (PARTITION BY k ORDER BY avg(r2) DESC, alpha_idx) AS rn
    FROM isc GROUP BY k, alpha_idx, alpha),
  ost AS (SELECT ko.k, {O.stats_cols(Z)} FROM z t JOIN ko ON t.fold <> ko.k GROUP BY ko.k),
  oco AS (SELECT ost.k, ib.alpha, ib.m, {O.coef_cols(2, 'ib.alpha')} FROM ost JOIN ib ON ost.k = ib.k AND ib.rn = 1)"""


@register("nested_cv", sql=_NESTED + f""",
  osc AS (SELECT s.fold, oco.alpha, oco.m,
      1 - sum((s.y - (oco.b0 + oco.w1 * s.{Z[0]} + oco.w2 * s.{Z[1]})) * (s.y - (oco.b0 + oco.w1 * s.{Z[0]} + oco.w2 * s.{Z[1]})))
        / (var_pop(s.y) * count(*)) AS r2
    FROM z s JOIN oco ON s.fold = oco.k GROUP BY s.fold, oco.alpha, oco.m)
  SELECT fold, alpha, {O.r('m')} AS inner_score, {O.r('r2')} AS r2 FROM osc""")
def q_nested_cv(spark, sf):
    d = splits.nested_folds(prep(spark, sf, _TWO_COLS), K, K, SEED, "hash")
    d = Standardizer(F_TWO, suffix="_z").fit(d).transform(d)
    gs = linear.GramSet(d, Z, "y", by=["fold", "inner"])
    rows = [(r["fold"], r["alpha"], r["inner_score"], r["r2"]) for r in linear.nested_cv(gs, "ridge", ALPHAS)]
    return spark.createDataFrame(rows, "fold int, alpha double, inner_score double, r2 double") \
        .withColumns({"inner_score": R("inner_score"), "r2": R("r2")})


@register("nested_cv_metrics", sql=_NESTED + f""",
  p AS (SELECT s.fold, s.y, oco.b0 + oco.w1 * s.{Z[0]} + oco.w2 * s.{Z[1]} AS prediction FROM z s JOIN oco ON s.fold = oco.k)
  {_metrics_sql('p', 'fold')}""")
def q_nested_cv_metrics(spark, sf):
    """The nested search with all four metrics of each outer fold."""
    d = splits.nested_folds(prep(spark, sf, _TWO_COLS), K, K, SEED, "hash")
    d = Standardizer(F_TWO, suffix="_z").fit(d).transform(d)
    gs = linear.GramSet(d, Z, "y", by=["fold", "inner"])
    return _round_metrics(linear.nested_metrics(d, linear.nested_cv(gs, "ridge", ALPHAS)))


@register("refit_best", sql=f"""WITH {O.prep_ctes(_TWO_COLS)}, za AS (SELECT *,
    {O.hash_bits(_H)} / 4294967296.0 < 0.3 AS is_test,
    CAST({O.hash_bits(O.hash_expr(SEED, '|cv'))} % {K} AS INTEGER) AS fold, {_zsql(F_TWO)} FROM clean),
  z AS (SELECT * FROM za WHERE NOT is_test), {_cv_grid_sql('ridge')},
  b AS (SELECT alpha, avg(r2) AS m FROM gsc GROUP BY alpha_idx, alpha ORDER BY m DESC, alpha_idx LIMIT 1),
  st AS (SELECT {O.stats_cols(Z)} FROM z), co AS (SELECT b.alpha, {O.coef_cols(2, 'b.alpha')} FROM st, b),
  p AS (SELECT co.alpha, s.y, co.b0 + co.w1 * s.{Z[0]} + co.w2 * s.{Z[1]} AS prediction FROM za s, co WHERE s.is_test)
  {_metrics_sql('p', 'alpha')}""")
def q_refit_best(spark, sf):
    d = splits.holdout(prep(spark, sf, _TWO_COLS), 0.3, SEED, "hash")
    d = Standardizer(F_TWO, suffix="_z").fit(d).transform(d)      # scaler fitted on all rows, as in the study
    train = splits.kfold(d.where(~F.col("is_test")), K, SEED, "hash", salt="|cv")
    gs = linear.GramSet(train, Z, "y", by=["fold"])
    cands = linear.linear_candidates("ridge", ALPHAS)
    ci, _ = linear.best_of(linear.cv_scores(gs, cands), len(cands))
    best = gs.fit("ridge", cands[ci]["alpha"])                      # refit on all training rows
    pred = best.transform(d.where("is_test")).withColumn("alpha", F.lit(cands[ci]["alpha"]))
    return _round_metrics(metrics(pred, "y", "prediction", ["alpha"]))


@register("feature_pipeline", sql=f"""WITH {O.prep_ctes(_TWO_COLS)},
  f AS (SELECT *, CAST({O.hash_bits(_H)} % {K} AS INTEGER) AS fold FROM clean),
  ms AS (SELECT kk.fold AS k, avg(y_prev) AS mk, stddev_pop(y_prev) AS sk FROM f t JOIN (SELECT DISTINCT fold FROM f) kk
    ON t.fold <> kk.fold GROUP BY kk.fold),
  zz AS (SELECT ms.k, t.fold, t.y, (t.y_prev - ms.mk) / ms.sk AS t1, ((t.y_prev - ms.mk) / ms.sk) * ((t.y_prev - ms.mk) / ms.sk) AS t2
    FROM f t, ms),
  st AS (SELECT k, {O.stats_cols(['t1', 't2'])} FROM zz WHERE fold <> k GROUP BY k),
  co AS (SELECT k, {O.coef_cols(2, '10.0')} FROM st),
  p AS (SELECT zz.fold, zz.y, co.b0 + co.w1 * zz.t1 + co.w2 * zz.t2 AS prediction FROM zz JOIN co ON zz.k = co.k WHERE zz.fold = zz.k)
  {_metrics_sql('p', 'fold')}""")
def q_feature_pipeline(spark, sf):
    d = _folded(spark, sf, _TWO_COLS)
    spec = ModelSpec("scaled_poly_ridge", "ridge", ["y_prev"], {"alpha": 10.0}, degree=2, scale=True)
    pred = cross_validate(spec, d, scale_scope="fold")      # scaler refitted inside each training fold
    return _round_metrics(metrics(pred, "y", "prediction", ["fold"]))


# --------------------------------------------------------- scaling, expansion
@register("standardize", sql=f"""WITH {O.prep_ctes(F_LINEAR + ['y'])}
  SELECT series, day, {', '.join(O.r(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()') + ' AS ' + c for c in F_LINEAR)} FROM clean""")
def q_standardize(spark, sf):
    d = prep(spark, sf, F_LINEAR + ["y"]).select("series", "day", *F_LINEAR)
    z = Standardizer(F_LINEAR).fit(d).transform(d)
    return z.withColumns({c: R(c) for c in F_LINEAR})


_PX = ["x_qty", "x_disc", "y_prev"]


def _poly_query(spark, sf, degree, interaction_only, bias):
    d = prep(spark, sf, _PX + ["y"]).select("series", "day", *_PX)
    z = Standardizer(_PX).fit(d).transform(d)
    out = poly(z, _PX, degree, interaction_only, bias, prefix="f")
    n = len(poly_names(_PX, degree, interaction_only, bias))
    return out.select("series", "day", *[R(f"f{i}").alias(f"f{i}") for i in range(n)])


# the expected terms, written out by hand: degree 2 with squares, degree-major;
# and all products of distinct inputs up to degree 3, with the constant
_POLY_FULL = ["a", "b", "c", "a * a", "a * b", "a * c", "b * b", "b * c", "c * c"]
_POLY_PRODUCTS = ["1.0", "a", "b", "c", "a * b", "a * c", "b * c", "a * b * c"]


def _poly_oracle(terms: list[str]) -> str:
    zs = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {n}" for c, n in zip(_PX, "abc"))
    items = ", ".join(f"{O.r(t)} AS f{i}" for i, t in enumerate(terms))
    return f"""WITH {O.prep_ctes(_PX + ['y'])}, z AS (SELECT series, day, {zs} FROM clean)
  SELECT series, day, {items} FROM z"""


@register("poly_full", sql=_poly_oracle(_POLY_FULL))
def q_poly_full(spark, sf):
    return _poly_query(spark, sf, 2, False, False)


@register("poly_interactions", sql=_poly_oracle(_POLY_PRODUCTS))
def q_poly_interactions(spark, sf):
    return _poly_query(spark, sf, 3, True, True)


# -------------------------------------------------- persistence and streaming
_HOLD_SQL = f"""WITH {O.prep_ctes(_TWO_COLS)}, f AS (SELECT *, {O.hash_bits(_H)} / 4294967296.0 < 0.3 AS is_test FROM clean),
  st AS (SELECT {O.stats_cols(F_TWO)} FROM f WHERE NOT is_test), co AS (SELECT {O.coef_cols(2)} FROM st)"""


def _saved_model(spark, sf) -> tuple[DataFrame, str]:
    d = splits.holdout(prep(spark, sf, _TWO_COLS), 0.3, SEED, "hash")
    m = fit(ModelSpec("scaled_ols", "ols", F_TWO, scale=True), d.where(~F.col("is_test")))
    path = io.save_model(m.model, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
    return d, path


@register("save_model", sql=_HOLD_SQL + f""" SELECT s.series, s.day, {O.r('co.b0 + co.w1 * s.y_prev + co.w2 * s.x_qty')} AS prediction
  FROM f s, co WHERE s.is_test""")
def q_save_model(spark, sf):
    d, path = _saved_model(spark, sf)
    out = io.score_batch(d.where("is_test"), path, keep=["series", "day"])
    return out.withColumn("prediction", R("prediction"))


@register("score_batch", sql=_HOLD_SQL + f""" SELECT s.series, s.day, {O.r('co.b0 + co.w1 * s.y_prev + co.w2 * s.x_qty')} AS prediction
  FROM f s, co""")
def q_score_batch(spark, sf):
    d, path = _saved_model(spark, sf)
    return io.score_batch(d, path, keep=["series", "day"]).withColumn("prediction", R("prediction"))


@register("score_stream", sql=_HOLD_SQL + f""" SELECT s.series, s.day, {O.r('co.b0 + co.w1 * s.y_prev + co.w2 * s.x_qty')} AS prediction
  FROM f s, co""")
def q_score_stream(spark, sf):
    from ..streaming.scoring import score_stream
    d, path = _saved_model(spark, sf)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    d.drop("is_test").repartition(4).write.parquet(f"{base}/in")      # records arriving as files
    score_stream(spark, f"{base}/in", path, f"{base}/out", f"{base}/chk",
                 schema=d.drop("is_test").schema, keep=["series", "day"]).awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("prediction", R("prediction"))


@register("save_study", sql=f"""WITH {_zf_sql()}, {_cv_grid_sql('ridge')},
  b AS (SELECT alpha_idx, alpha, avg(r2) AS m, stddev_pop(r2) AS s FROM gsc GROUP BY alpha_idx, alpha)
  SELECT alpha_idx AS candidate, alpha, {O.r('m')} AS mean_r2, {O.r('s')} AS std_r2,
    CAST(row_number() OVER (ORDER BY m DESC, alpha_idx) AS INTEGER) AS rank FROM b""")
def q_save_study(spark, sf):
    cands, scores = _search(spark, sf, "ridge")
    b = _board(spark, cands, scores)
    best = b.where("rank = 1").first()
    path = io.save_study(b, scratch_path(spark, f"study-{uuid.uuid4().hex}"),
                         {"family": "ridge", "alpha": best["alpha"], "mean_r2": best["mean_r2"]})
    back, params = io.load_study(spark, path)
    assert params and params["alpha"] == best["alpha"]
    return back.select("candidate", "alpha", R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), "rank")


# ======================================================================= PCA
from ..operators import charts, pca as pca_op  # noqa: E402
from ..operators import trees as tr  # noqa: E402
from ..operators.mlp import MLPConfig, sample_configs  # noqa: E402
from .common import DISPLAY, F_COMPARE, F_NETWORK, F_PCA, F_TREE  # noqa: E402


def _pca(spark, sf):
    from ..sources.fixture import fixture_panel
    # read columns only: a cached y_drop would have every (series, day, order) shuffled
    d = fixture_panel(spark, sf).select("series", "day", *F_PCA).dropna().persist()
    return d, pca_op.pca(d, F_PCA)


_PCA_SRC = f"p AS ({O.panel_sql()} HAVING " + " AND ".join(f"{c} IS NOT NULL" for c in F_PCA) + ")"
_PCA_WITH = (f"WITH RECURSIVE {_PCA_SRC}, "
             + O.pca_ctes("p", F_PCA, [DISPLAY.get(c, c) for c in F_PCA]))
_PCA_RATIO = ", r AS (SELECT component, greatest(lam, 0) / t AS ratio FROM ord, tot)"
_PCA_CUM = _PCA_RATIO + (", cu AS (SELECT component, ratio, sum(ratio) OVER (ORDER BY component "
                         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM r)")
_ZS = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(F_PCA))
_PCS = ", ".join(
    O.r(" + ".join(f"z{r} * l[{(k - 1) * len(F_PCA) + r + 1}]" for r in range(len(F_PCA)))) + f" AS pc{k}"
    for k in range(1, len(F_PCA) + 1))


@register("pca", sql=_PCA_WITH + f""", z AS (SELECT series, day, {_ZS} FROM p),
  lv AS (SELECT list(loading ORDER BY component, var_idx) AS l FROM load)
  SELECT series, day, {_PCS} FROM z, lv""")
def q_pca(spark, sf):
    d, m = _pca(spark, sf)
    out = m.transform(d.select("series", "day", *F_PCA))
    return out.select("series", "day", *[R(f"pc{k + 1}").alias(f"pc{k + 1}") for k in range(len(F_PCA))])


@register("pca_loadings", sql=_PCA_WITH + f""" SELECT variable, 'PC' || component AS component,
  component AS component_no, {O.r('loading')} AS loading FROM load""")
def q_pca_loadings(spark, sf):
    d, m = _pca(spark, sf)
    return m.loadings(spark, DISPLAY).withColumn("loading", R("loading"))


@register("explained_variance", sql=_PCA_WITH + _PCA_RATIO + f" SELECT component, {O.r('ratio')} AS ratio FROM r")
def q_explained_variance(spark, sf):
    d, m = _pca(spark, sf)
    return m.explained(spark).select("component", R("ratio").alias("ratio"))


@register("cumulative_variance", sql=_PCA_WITH + _PCA_CUM
          + f" SELECT component, {O.r('ratio')} AS ratio, {O.r('cumulative')} AS cumulative FROM cu")
def q_cumulative_variance(spark, sf):
    d, m = _pca(spark, sf)
    return charts.cumulative(m.explained(spark)).select("component", R("ratio").alias("ratio"),
                                                        R("cumulative").alias("cumulative"))


@register("variance_labels", sql=_PCA_WITH + _PCA_CUM
          + " SELECT component, printf('%.1f%%', cumulative * 100) AS label FROM cu")
def q_variance_labels(spark, sf):
    d, m = _pca(spark, sf)
    return charts.variance_labels(charts.cumulative(m.explained(spark))).select("component", "label")


# ============================================================ trees, boosting
_TREE_COLS = F_TREE + ["y"]
from .studies import BOOST_LEAFWISE_SMALL, BOOST_SMALL, FOREST_SMALL as RF_COMPARE  # noqa: E402


def _holdout_fit(spark, sf, spec: ModelSpec, cols) -> DataFrame:
    d = splits.holdout(prep(spark, sf, cols), 0.3, SEED, "hash")
    m = fit(spec, d.where(~F.col("is_test")))
    return _round_metrics(metrics(m.transform(d.where("is_test")), "y", "prediction"))


@register("decision_tree")
def q_decision_tree(spark, sf):
    return _holdout_fit(spark, sf, ModelSpec("tree", "tree", F_TREE, {"max_depth": 5, "min_samples_leaf": 1},
                                             scale=False), _TREE_COLS)


@register("random_forest")
def q_random_forest(spark, sf):
    return _holdout_fit(spark, sf, ModelSpec("forest", "forest", F_TREE, RF_COMPARE, scale=True), _TREE_COLS)


@register("boosting")
def q_boosting(spark, sf):
    spec = ModelSpec("boost", "boost", F_NETWORK, BOOST_SMALL, scale=True, strict=False)
    return _holdout_fit(spark, sf, spec, F_NETWORK + ["y"])


@register("boosting_log")
def q_boosting_log(spark, sf):
    spec = ModelSpec("boost_log", "boost", F_TREE, BOOST_LEAFWISE_SMALL, scale=True, log_target=True, strict=False)
    return _holdout_fit(spark, sf, spec, _TREE_COLS)


@register("voting")
def q_voting(spark, sf):
    spec = ModelSpec("voting", "voting", F_NETWORK, members=[("boost", BOOST_SMALL), ("forest", RF_COMPARE)],
                     degree=2, scale=True, strict=False)
    return _holdout_fit(spark, sf, spec, F_NETWORK + ["y"])


def _importance_frame(spark, pairs):
    return spark.createDataFrame(pairs, "feature string, importance double")


@register("tree_importance")
def q_tree_importance(spark, sf):
    d = prep(spark, sf, _TREE_COLS)
    m = fit(ModelSpec("tree", "tree", F_TREE, {"max_depth": 5, "min_samples_leaf": 1}, scale=False), d)
    t = _importance_frame(spark, tr.impurity_importance(m.members[0], F_TREE))
    return t.withColumn("importance", R("importance"))


@register("importance_sorted")
def q_importance_sorted(spark, sf):
    d = prep(spark, sf, _TREE_COLS)
    m = fit(ModelSpec("forest", "forest", F_TREE, RF_COMPARE, scale=False), d)
    t = _importance_frame(spark, tr.impurity_importance(m.members[0], F_TREE))
    return selection.sort_importance(t).withColumn("importance", R("importance"))


def _boost_nodes(spark, sf):
    d = prep(spark, sf, _TREE_COLS)
    m = fit(ModelSpec("boost_log", "boost", F_TREE, BOOST_LEAFWISE_SMALL, scale=False, log_target=True, strict=False), d)
    return tr.node_table(spark, m.members[0], scratch_path(spark, f"gbt-{uuid.uuid4().hex}"))


@register("split_importance")
def q_split_importance(spark, sf):
    return tr.split_importance(_boost_nodes(spark, sf), F_TREE)


@register("gain_importance")
def q_gain_importance(spark, sf):
    return tr.gain_importance(_boost_nodes(spark, sf), F_TREE).withColumn("importance", R("importance"))


def _spark_ml_search(spark, d: DataFrame, specs: list[ModelSpec], parallelism: int = 8) -> DataFrame:
    """Every distinct candidate on every fold (fit on the others), one row of
    metrics per fit."""
    from ..operators.fitting import compare_scores
    sc = compare_scores(specs, d, parallelism=parallelism)
    d.unpersist()
    g = sc.groupBy("model", "model_order").agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))
    from pyspark.sql import Window
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_r2").desc(), "model_order")))


TREE_GRID = {"max_depth": [5, None], "min_samples_leaf": [1, 10]}


@register("tree_search")
def q_tree_search(spark, sf):
    d = splits.kfold(splits.holdout(prep(spark, sf, _TREE_COLS), 0.3, SEED, "hash").where(~F.col("is_test")),
                     K, SEED, "hash", salt="|cv").persist()
    specs = [ModelSpec(f"c{i}", "tree", F_TREE, c, scale=False) for i, c in enumerate(splits.grid_candidates(TREE_GRID))]
    b = _spark_ml_search(spark, d, specs)
    return b.select(F.col("model_order").alias("candidate"), R("mean_r2").alias("mean_r2"),
                    R("std_r2").alias("std_r2"), "rank")


BOOST_SPACE = {"n_estimators": [10, 20], "max_depth": [3, 5], "learning_rate": [0.05, 0.1],
               "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]}


@register("boost_random_search")
def q_boost_random_search(spark, sf):
    grid = splits.param_grid(spark, BOOST_SPACE)
    draws = splits.param_sample(grid, 3, SEED).orderBy("draw").collect()
    d = splits.kfold(prep(spark, sf, F_NETWORK + ["y"]), K, SEED, "hash").persist()
    specs = [ModelSpec(f"draw{r['draw']}", "boost", F_NETWORK,
                       {k: r[k] for k in BOOST_SPACE}, scale=True) for r in draws]
    b = _spark_ml_search(spark, d, specs)
    return b.select("model", R("mean_r2").alias("mean_r2"), R("std_r2").alias("std_r2"), "rank")


@register("compare_models")
def q_compare_models(spark, sf):
    """The reference comparison: least squares on the degree-2 expansion,
    boosting, and a vote of boosting, forest and boosting (second setting),
    with the reference's 300, 300 and 500 trees."""
    from ..operators import presets
    from ..operators.fitting import compare_scores
    d = splits.kfold(prep(spark, sf, F_COMPARE + ["y"]), K, SEED, "hash").persist()
    specs = [ModelSpec("least_squares_degree2", "ols", F_COMPARE, degree=presets.COMPARE_DEGREE),
             ModelSpec("boosting", "boost", F_COMPARE, presets.COMPARE_BOOST, strict=False),
             ModelSpec("voting", "voting", F_COMPARE, members=[("boost", presets.COMPARE_BOOST), ("forest", presets.COMPARE_FOREST),
                                                              ("boost", presets.COMPARE_BOOST_LEAFWISE)], strict=False)]
    sc = compare_scores(specs, d, parallelism=8)   # all fold fits share one pool
    d.unpersist()
    return sc.select("model", "model_order", "fold", R("r2").alias("r2"))


# =================================================================== network
@register("mlp_regression")
def q_mlp_regression(spark, sf):
    """Holdout metrics of one network, saved with its preprocessing and read
    back before it scores."""
    from .studies import network_study
    cfg = MLPConfig(hidden=[32, 16], l2=[1e-4, 1e-4], dropout=[0.0, 0.0], learning_rate=3e-3, epochs=20)
    path = scratch_path(spark, f"network-{uuid.uuid4().hex}")
    network_study(spark, sf, configs=[cfg], model_path=path)
    d = splits.holdout(prep(spark, sf, F_NETWORK + ["y"]), 0.3, SEED, "hash")
    return _round_metrics(metrics(io.score_batch(d.where("is_test"), path), "y", "prediction"))


@register("network_search")
def q_network_search(spark, sf):
    from pyspark.sql import Window

    from .studies import network_study
    t = network_study(spark, sf, configs=sample_configs(3, SEED, epochs=8))["trials"]
    return t.select("trial", "layers", "learning_rate", F.col("val_loss").alias("best_val_loss"), "epochs",
                    F.row_number().over(Window.orderBy("val_loss", "trial")).alias("rank")) \
            .withColumn("best_val_loss", R("best_val_loss"))


# ============================================================ whole studies
@register("linear_study")
def q_linear_study(spark, sf):
    """The linear study end to end (``studies.linear_study``): nonzero
    coefficients by size, with the holdout metrics of the winner."""
    from .studies import linear_study
    out = linear_study(spark, sf)
    test, best = out["metrics"].first(), out["best"].first()
    return out["coefs"].select("term", R("coef").alias("coef"), "position", F.lit(best["family"]).alias("family"),
                               F.lit(best["alpha"]).alias("alpha"),
                               *[F.lit(float(test[m])).alias(f"test_{m}") for m in ("r2", "mae", "mse", "rmse")])


@register("linear_study_nested")
def q_linear_study_nested(spark, sf):
    """Nested search over the study's winning family, all four metrics of each
    outer fold."""
    from .studies import linear_study
    return _round_metrics(linear_study(spark, sf)["nested"])


@register("nested_cv_blocks", sql=f"""WITH {O.prep_ctes(_TWO_COLS)}, z0 AS (SELECT *,
    CAST({O.hash_bits(O.hash_expr(SEED))} % {K} AS INTEGER) AS fold, {O.hash_expr(SEED)} AS h, {_zsql(F_TWO)} FROM clean),
  ko AS (SELECT DISTINCT fold AS k FROM z0),
  z AS (SELECT ko.k, t.*, CAST(ntile({K}) OVER (PARTITION BY ko.k ORDER BY t.day, t.h, t.series) - 1 AS INTEGER) AS inner_fold
    FROM z0 t JOIN ko ON t.fold <> ko.k),
  ki AS (SELECT DISTINCT inner_fold AS j FROM z),
  ist AS (SELECT t.k, ki.j, {O.stats_cols(Z)} FROM z t JOIN ki ON t.inner_fold <> ki.j GROUP BY t.k, ki.j),
  ico AS (SELECT k, j, alpha_idx, alpha, {O.coef_cols(2, 'alpha')} FROM ist, {_alpha_values()} c),
  isc AS (SELECT ico.k, ico.j, ico.alpha_idx, ico.alpha,
      1 - sum((s.y - (ico.b0 + ico.w1 * s.{Z[0]} + ico.w2 * s.{Z[1]})) * (s.y - (ico.b0 + ico.w1 * s.{Z[0]} + ico.w2 * s.{Z[1]})))
        / (var_pop(s.y) * count(*)) AS r2
    FROM z s JOIN ico ON s.k = ico.k AND s.inner_fold = ico.j GROUP BY ico.k, ico.j, ico.alpha_idx, ico.alpha),
  ib AS (SELECT k, alpha_idx, alpha, avg(r2) AS m, row_number() OVER (PARTITION BY k ORDER BY avg(r2) DESC, alpha_idx) AS rn
    FROM isc GROUP BY k, alpha_idx, alpha),
  ost AS (SELECT ko.k, {O.stats_cols(Z)} FROM z0 t JOIN ko ON t.fold <> ko.k GROUP BY ko.k),
  oco AS (SELECT ost.k, ib.alpha, ib.m, {O.coef_cols(2, 'ib.alpha')} FROM ost JOIN ib ON ost.k = ib.k AND ib.rn = 1),
  osc AS (SELECT s.fold, oco.alpha, oco.m,
      1 - sum((s.y - (oco.b0 + oco.w1 * s.{Z[0]} + oco.w2 * s.{Z[1]})) * (s.y - (oco.b0 + oco.w1 * s.{Z[0]} + oco.w2 * s.{Z[1]})))
        / (var_pop(s.y) * count(*)) AS r2
    FROM z0 s JOIN oco ON s.fold = oco.k GROUP BY s.fold, oco.alpha, oco.m)
  SELECT fold, alpha, {O.r('m')} AS inner_score, {O.r('r2')} AS r2 FROM osc""")
def q_nested_cv_blocks(spark, sf):
    """Nested search with chronological inner blocks inside each outer
    training set (the linear study's inner cv of five blocks)."""
    d = splits.kfold(prep(spark, sf, _TWO_COLS), K, SEED, "hash")
    d = Standardizer(F_TWO, suffix="_z").fit(d).transform(d).persist()
    rows = [(r["fold"], r["alpha"], r["inner_score"], r["r2"])
            for r in linear.nested_cv_blocks(d, Z, "y", "ridge", ALPHAS, K)]
    return spark.createDataFrame(rows, "fold int, alpha double, inner_score double, r2 double") \
        .withColumns({"inner_score": R("inner_score"), "r2": R("r2")})
