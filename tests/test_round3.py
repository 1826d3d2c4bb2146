"""Tasks of the learners follow from their rows."""

import pytest
from pyspark.sql import functions as F

from panelcast.operators import fitting, splits
from panelcast.operators.fitting import ModelSpec, compare_scores, fit

FEATS = ["x_qty", "x_price", "x_size"]
SPECS = [ModelSpec("ols", "ols", FEATS, degree=2),
         ModelSpec("forest", "forest", FEATS, {"n_estimators": 3, "max_depth": 3}),
         ModelSpec("vote", "voting", FEATS, members=[("boost", {"n_estimators": 3, "max_depth": 2, "subsample": 0.8}),
                                                     ("forest", {"n_estimators": 3, "max_depth": 3})], strict=False)]


@pytest.fixture
def rows(panel):
    return splits.kfold(panel.select("series", "day", *FEATS, F.col("y").cast("double").alias("y")).dropna(), 3, 42, "hash")


@pytest.mark.parametrize("per_task", [20_000, 100])
def test_learners_have_tasks_by_their_rows(rows, monkeypatch, per_task):
    parts, one = [], fitting._fit_member
    monkeypatch.setattr(fitting, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(fitting, "_fit_member", lambda est, r: parts.append((r.rdd.getNumPartitions(), r.count())) or one(est, r))
    n = rows.count()
    compare_scores(SPECS, rows.repartition(40), parallelism=2)
    assert [p for p, _ in parts] == [-(-n // per_task)] * 6           # 3 folds of a forest and a boosting
    assert sum(c for _, c in parts) == 2 * 2 * n                      # every row trains in all folds but its own
    parts.clear()
    fit(SPECS[1], rows.repartition(40))
    assert parts == [(-(-n // per_task), n)]


def test_row_samples_do_not_depend_on_partitioning(rows, monkeypatch):
    monkeypatch.setattr(fitting, "ROWS_PER_TASK", 100)
    scores = lambda k: {(r.model, r.fold): (r.n, r.r2, r.mae) for r in compare_scores(SPECS, rows.repartition(k), parallelism=3).collect()}
    a, b = scores(1), scores(13)
    assert a.keys() == b.keys() and len(a) == 9
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9)
