"""Registered queries, part three: trees, forest, boosting, voting, their
importances and searches on the calendar inputs, with DuckDB oracles.

Month and weekday take 12 and 7 values, so every threshold that Spark can pick
lies between two neighbouring values, and a tree is a chain of sums over 84
cells: the oracle finds each split as the largest variance reduction over all
thresholds (ties: first input, then smallest threshold), from its definition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import calendar_parts
from ..functions.features import rounded as R
from ..functions.metrics import metrics
from ..operators import selection, splits
from ..operators import trees as tr
from ..operators.fitting import ModelSpec, compare_scores, fit
from ..session import scratch_path
from . import oracle as O
from .catalog import K, SEED, _metrics_sql, _round_metrics, register
from .common import prep

CALENDAR = ["month", "weekday"]
TREE = {"max_depth": 2, "min_samples_leaf": 5}
FOREST = {"n_estimators": 3, "max_depth": 2, "bootstrap": False}
BOOST = {"n_estimators": 3, "max_depth": 1, "learning_rate": 0.1}


# ------------------------------------------------------------------ SQL side
_H = O.hash_expr(SEED)
_SRC = f"""{O.prep_ctes(['y'])}, src AS (SELECT *, isodow(day) - 1 AS weekday,
    {O.hash_bits(_H)} / 4294967296.0 < 0.3 AS is_test, CAST({O.hash_bits(_H)} % {K} AS INTEGER) AS fold,
    CAST({O.hash_bits(O.hash_expr(SEED, '|cv'))} % {K} AS INTEGER) AS cv FROM clean)"""


def _cells(name: str, rows: str, target: str = "y") -> str:
    """Count and sum of the target by set of rows (k) and cell."""
    return f"{name} AS (SELECT k, month AS f1, weekday AS f2, count(*) AS n, sum({target}) AS s FROM ({rows}) GROUP BY ALL)"


def _tree(name: str, cells: str, depth: int, leaf: int = 1) -> list[str]:
    """``<name>`` (k, f1, f2, p: the leaf's mean) and ``<name>_splits``."""
    out = [f"{name}_n0 AS (SELECT *, 1 AS node FROM {cells})"]
    for d in range(depth):
        out.append(f"""{name}_c{d} AS (SELECT k, node, f, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
      sum(n) OVER (PARTITION BY k, node, f) AS nt, sum(s) OVER (PARTITION BY k, node, f) AS st
    FROM (SELECT k, node, 1 AS f, f1 AS v, sum(n) AS n, sum(s) AS s FROM {name}_n{d} GROUP BY ALL
          UNION ALL SELECT k, node, 2 AS f, f2 AS v, sum(n) AS n, sum(s) AS s FROM {name}_n{d} GROUP BY ALL)
    WINDOW w AS (PARTITION BY k, node, f ORDER BY v))""")
        out.append(f"""{name}_g{d} AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain
    FROM (SELECT k, node, f, v, nt, CAST(nl AS DOUBLE) AS nl, CAST(sl AS DOUBLE) AS sl, CAST(st AS DOUBLE) AS st FROM {name}_c{d})
    WHERE nl >= {leaf} AND nt - nl >= {leaf})""")
        out.append(f"""{name}_b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, v) AS rn
    FROM {name}_g{d}) WHERE rn = 1 AND gain > 1e-9)""")
        out.append(f"""{name}_n{d + 1} AS (SELECT c.k, c.f1, c.f2, c.n, c.s, CASE WHEN b.node IS NULL THEN c.node
      ELSE 2 * c.node + CASE WHEN (CASE b.f WHEN 1 THEN c.f1 ELSE c.f2 END) > b.v THEN 1 ELSE 0 END END AS node
    FROM {name}_n{d} c LEFT JOIN {name}_b{d} b ON c.k = b.k AND c.node = b.node)""")
    out.append(f"{name}_splits AS (" + " UNION ALL ".join(f"SELECT k, node, f, gain, nt FROM {name}_b{d}" for d in range(depth)) + ")")
    out.append(f"{name} AS (SELECT k, f1, f2, CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS p FROM {name}_n{depth} WINDOW w AS (PARTITION BY k, node))")
    return out


def _boost(name: str, cells: str, rounds: int, depth: int, rate: float) -> list[str]:
    """``<name>``: the first tree fits the target, each further one twice the
    residual, added at the learning rate."""
    out = [f"{name}_f0 AS (SELECT k, f1, f2, n, CAST(s AS DOUBLE) AS y, 0.0 AS p, CAST(s AS DOUBLE) AS s FROM {cells})"]
    for m in range(rounds):
        out += _tree(f"{name}_t{m}", f"(SELECT k, f1, f2, n, s FROM {name}_f{m})", depth)
        step = 1.0 if m == 0 else rate
        out.append(f"""{name}_f{m + 1} AS (SELECT c.k, c.f1, c.f2, c.n, c.y, c.p + {step} * t.p AS p, 2 * (c.y - c.n * (c.p + {step} * t.p)) AS s
    FROM {name}_f{m} c JOIN {name}_t{m} t USING (k, f1, f2))""")
    out.append(f"{name} AS (SELECT k, f1, f2, p FROM {name}_f{rounds})")
    return out


_TRAIN = "SELECT 0 AS k, * FROM src WHERE NOT is_test"
_ALL = "SELECT 0 AS k, * FROM src"


def _score_test(model: str, prediction: str = "p") -> str:
    return f"scored AS (SELECT t.y, {prediction} AS prediction FROM src t JOIN {model} m ON t.month = m.f1 AND t.weekday = m.f2 WHERE t.is_test)"


def _with(*ctes) -> str:
    flat = [c for x in ctes for c in (x if isinstance(x, list) else [x])]
    return "WITH " + ",\n  ".join(flat) + "\n  "


def _holdout_sql(model: list[str], target: str = "y", prediction: str = "p") -> str:
    return _with(_SRC, _cells("cells", _TRAIN, target), model, _score_test("m", prediction)) + _metrics_sql("scored", "")


def _names(expr: str = "f") -> str:
    return f"CASE {expr} WHEN 1 THEN 'month' ELSE 'weekday' END"


_IMPURITY = """imp AS (SELECT v.f, coalesce(sum(gain), 0) AS g FROM (VALUES (1), (2)) v(f) LEFT JOIN m_splits s ON s.f = v.f GROUP BY v.f),
  tot AS (SELECT sum(g) AS t FROM imp)"""


def _boost_splits(rounds: int) -> str:
    return "all_splits AS (" + " UNION ALL ".join(f"SELECT * FROM m_t{i}_splits" for i in range(rounds)) + ")"


def _fold_r2(model_ctes, name: str, fold: str, where: str) -> list[str]:
    """``<name>_r2`` (fold, r2): fold k scored by the model of the others."""
    return [_cells(f"{name}_cells", f"SELECT o.k, t.* FROM src t JOIN (SELECT DISTINCT {fold} AS k FROM src) o ON t.{fold} <> o.k {where}"),
            *model_ctes(name, f"{name}_cells"),
            f"""{name}_r2 AS (SELECT t.{fold} AS fold, 1 - sum((t.y - m.p) * (t.y - m.p)) / (var_pop(t.y) * count(*)) AS r2
    FROM src t JOIN {name} m ON t.{fold} = m.k AND t.month = m.f1 AND t.weekday = m.f2 {where} GROUP BY t.{fold})"""]


# ---------------------------------------------------------------- Spark side
def _panel(spark, sf) -> DataFrame:
    return calendar_parts(prep(spark, sf, ["y"]), "day", ("weekday",))


def _spec(name: str, kind: str, params: dict | None = None, **more) -> ModelSpec:
    return ModelSpec(name, kind, CALENDAR, params or {}, scale=False, **more)


def _holdout(spark, sf, spec: ModelSpec) -> DataFrame:
    d = splits.holdout(_panel(spark, sf), 0.3, SEED, "hash")
    m = fit(spec, d.where(~F.col("is_test")))
    return _round_metrics(metrics(m.transform(d.where("is_test")), "y", "prediction"))


@register("decision_tree_calendar", sql=_holdout_sql(_tree("m", "cells", 2, 5)))
def q_decision_tree_calendar(spark, sf):
    return _holdout(spark, sf, _spec("tree", "tree", TREE))


@register("random_forest_calendar", sql=_holdout_sql(_tree("m", "cells", 2)))
def q_random_forest_calendar(spark, sf):
    """Without a bootstrap and with all inputs every tree is the same tree."""
    return _holdout(spark, sf, _spec("forest", "forest", FOREST))


@register("boosting_calendar", sql=_holdout_sql(_boost("m", "cells", 3, 1, 0.1)))
def q_boosting_calendar(spark, sf):
    return _holdout(spark, sf, _spec("boost", "boost", BOOST))


@register("boosting_log_calendar", sql=_holdout_sql(_boost("m", "cells", 3, 1, 0.1), "ln(1 + y)", "exp(p) - 1"))
def q_boosting_log_calendar(spark, sf):
    return _holdout(spark, sf, _spec("boost_log", "boost", BOOST, log_target=True))


@register("voting_calendar", sql=_holdout_sql(
    [*_boost("a", "cells", 3, 1, 0.1), *_tree("b", "cells", 2), "m AS (SELECT k, f1, f2, (a.p + b.p) / 2 AS p FROM a JOIN b USING (k, f1, f2))"]))
def q_voting_calendar(spark, sf):
    return _holdout(spark, sf, _spec("voting", "voting", members=[("boost", BOOST), ("forest", FOREST)]))


_IMPORTANCE_SQL = _with(_SRC, _cells("cells", _ALL), _tree("m", "cells", 2, 5), _IMPURITY)


def _importance(spark, sf, spec) -> DataFrame:
    m = fit(spec, _panel(spark, sf))
    return spark.createDataFrame(tr.impurity_importance(m.members[0], CALENDAR), "feature string, importance double")


@register("tree_importance_calendar", sql=_IMPORTANCE_SQL + f"SELECT {_names()} AS feature, {O.r('g / t')} AS importance FROM imp, tot")
def q_tree_importance_calendar(spark, sf):
    return _importance(spark, sf, _spec("tree", "tree", TREE)).withColumn("importance", R("importance"))


@register("importance_sorted_calendar", sql=_with(_SRC, _cells("cells", _ALL), _tree("m", "cells", 2), _IMPURITY) +
          f"SELECT {_names()} AS feature, {O.r('g / t')} AS importance, CAST(row_number() OVER (ORDER BY g DESC) AS INTEGER) AS position FROM imp, tot")
def q_importance_sorted_calendar(spark, sf):
    return selection.sort_importance(_importance(spark, sf, _spec("forest", "forest", FOREST))).withColumn("importance", R("importance"))


_DEEP = {**BOOST, "max_depth": 2}
_SPLITS_SQL = _with(_SRC, _cells("cells", _ALL), _boost("m", "cells", 3, 2, 0.1), _boost_splits(3))


def _nodes(spark, sf) -> DataFrame:
    m = fit(_spec("boost", "boost", _DEEP), _panel(spark, sf))
    return tr.node_table(spark, m.members[0], scratch_path(spark, f"gbt-{uuid.uuid4().hex}"))


@register("split_importance_calendar", sql=_SPLITS_SQL + f"""SELECT {_names('v.f')} AS feature, CAST(count(s.f) AS DOUBLE) AS importance
  FROM (VALUES (1), (2)) v(f) LEFT JOIN all_splits s ON s.f = v.f GROUP BY v.f""")
def q_split_importance_calendar(spark, sf):
    return tr.split_importance(_nodes(spark, sf), CALENDAR)


@register("gain_importance_calendar", sql=_SPLITS_SQL + f"""SELECT {_names('v.f')} AS feature, {O.r('coalesce(avg(gain / nt), 0)')} AS importance
  FROM (VALUES (1), (2)) v(f) LEFT JOIN all_splits s ON s.f = v.f GROUP BY v.f""")
def q_gain_importance_calendar(spark, sf):
    return tr.gain_importance(_nodes(spark, sf), CALENDAR).withColumn("importance", R("importance"))


SEARCH = {"max_depth": [1, 2], "min_samples_leaf": [1, 900]}
_TREES = [(d, leaf) for d in SEARCH["max_depth"] for leaf in SEARCH["min_samples_leaf"]]


def _board_sql(parts: list[list[str]], names: list[str], cols: list[str], select: str) -> str:
    """Mean, population std and rank of candidates' fold scores; scores equal
    to nine digits keep the candidates' order, on both sides."""
    rows = " UNION ALL ".join(f"SELECT {i} AS candidate, {c}, r2 FROM {n}_r2" for i, (n, c) in enumerate(zip(names, cols)))
    return _with(_SRC, *parts, f"sc AS ({rows})",
                 "b AS (SELECT * EXCLUDE (r2, fold), avg(r2) AS m, stddev_pop(r2) AS s FROM (SELECT *, 0 AS fold FROM sc) GROUP BY ALL)") + select


@register("tree_search_calendar", sql=_board_sql(
    [_fold_r2(lambda n, c, d=d, leaf=leaf: _tree(n, c, d, leaf), f"t{i}", "cv", "WHERE NOT t.is_test") for i, (d, leaf) in enumerate(_TREES)],
    [f"t{i}" for i in range(4)], ["0 AS x"] * 4,
    f"SELECT candidate, {O.r('m')} AS mean_r2, {O.r('s')} AS std_r2, CAST(row_number() OVER (ORDER BY round(m, 9) DESC, candidate) AS INTEGER) AS rank FROM b"))
def q_tree_search_calendar(spark, sf):
    d = splits.kfold(splits.holdout(_panel(spark, sf), 0.3, SEED, "hash").where(~F.col("is_test")), K, SEED, "hash", salt="|cv").persist()
    specs = [_spec(f"c{i}", "tree", {"max_depth": a, "min_samples_leaf": b}) for i, (a, b) in enumerate(_TREES)]
    return _board(compare_scores(specs, d, parallelism=8)).select(F.col("model_order").alias("candidate"), "mean_r2", "std_r2", "rank")


def _board(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("model", "model_order").agg(F.avg("r2").alias("m"), F.stddev_pop("r2").alias("s"))
    return g.select("model", "model_order", R("m").alias("mean_r2"), R("s").alias("std_r2"),
                    F.row_number().over(Window.orderBy(F.round("m", 9).desc(), "model_order")).alias("rank"))


SPACE = {"n_estimators": [2, 4], "learning_rate": [0.1, 0.3], "max_depth": [1]}
_BOOSTS = [(n, r) for n in SPACE["n_estimators"] for r in SPACE["learning_rate"]]


@register("boost_random_search_calendar", sql=_board_sql(
    [_fold_r2(lambda n, c, m=m, rate=rate: _boost(n, c, m, 1, rate), f"t{i}", "fold", "") for i, (m, rate) in enumerate(_BOOSTS)],
    [f"t{i}" for i in range(4)], [f"{m} AS n_estimators, CAST({rate} AS DOUBLE) AS learning_rate" for m, rate in _BOOSTS],
    f"SELECT n_estimators, learning_rate, {O.r('m')} AS mean_r2, {O.r('s')} AS std_r2, CAST(row_number() OVER (ORDER BY round(m, 9) DESC, candidate) AS INTEGER) AS rank FROM b"))
def q_boost_random_search_calendar(spark, sf):
    """As many draws without replacement as the space has points, so the
    oracle needs not repeat the draw's order."""
    draws = splits.param_sample(splits.param_grid(spark, SPACE), 4, SEED).collect()
    d = splits.kfold(_panel(spark, sf), K, SEED, "hash").persist()
    found = sorted(((r["n_estimators"], r["learning_rate"]) for r in draws), key=_BOOSTS.index)
    specs = [_spec(f"{n}|{rate}", "boost", {"n_estimators": n, "learning_rate": rate, "max_depth": 1}) for n, rate in found]
    b = _board(compare_scores(specs, d, parallelism=8))
    p = F.split("model", r"\|")
    return b.select(p[0].cast("int").alias("n_estimators"), p[1].cast("double").alias("learning_rate"), "mean_r2", "std_r2", "rank")


def _ols_cells(name: str, cells: str) -> list[str]:
    """Two-input least squares by the closed form of the other oracles."""
    rows = "SELECT o.k, t.month, t.weekday, t.y FROM src t JOIN (SELECT DISTINCT fold AS k FROM src) o ON t.fold <> o.k"
    return [f"{name}_st AS (SELECT k, {O.stats_cols(CALENDAR)} FROM ({rows}) GROUP BY k)",
            f"{name}_co AS (SELECT k, {O.coef_cols(2)} FROM {name}_st)",
            f"{name} AS (SELECT c.k, m AS f1, w AS f2, b0 + w1 * m + w2 * w AS p FROM {name}_co c, range(1, 13) a(m), range(0, 7) b(w))"]


_COMPARED = [("least_squares", _ols_cells), ("tree", lambda n, c: _tree(n, c, 2, 5)), ("boosting", lambda n, c: _boost(n, c, 3, 1, 0.1))]


@register("compare_models_calendar", sql=_with(_SRC, *[_fold_r2(f, f"m{i}", "fold", "") for i, (_, f) in enumerate(_COMPARED)]) + " UNION ALL ".join(
    f"SELECT '{n}' AS model, {i} AS model_order, fold, {O.r('r2')} AS r2 FROM m{i}_r2" for i, (n, _) in enumerate(_COMPARED)))
def q_compare_models_calendar(spark, sf):
    d = splits.kfold(_panel(spark, sf), K, SEED, "hash").persist()
    specs = [_spec("least_squares", "ols"), _spec("tree", "tree", TREE), _spec("boosting", "boost", BOOST)]
    return compare_scores(specs, d, parallelism=8).select("model", "model_order", "fold", R("r2").alias("r2"))


# ----------------------------------------------------------- two series, lagged
@register("two_series_rows", sql=f"""WITH {O.prep_ctes(None)} SELECT series, day, y, y_prev FROM clean WHERE series IN ('EUROPE', 'ASIA')""")
def q_two_series_rows(spark, sf):
    """The rows of the two-series study: the lag is taken before rows with
    nulls go."""
    from .studies import two_series
    return two_series(spark, sf, ("EUROPE", "ASIA")).select("series", "day", "y", "y_prev")
