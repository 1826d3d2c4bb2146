"""The registered comparison trains every tree of the reference's models."""

from panelcast.operators import fitting, presets

SF = "/root/testdata/sf0.001"


def test_comparison_trains_the_reference_trees(spark, monkeypatch):
    """What Spark is told in each fit; the fits themselves are cut to one tree here."""
    from panelcast.plans.catalog_models import q_compare_models
    told, one = [], fitting._fit_member

    def first_tree(est, rows):
        n = est.numTrees if est.hasParam("numTrees") else est.maxIter
        told.append((n.name, est.getOrDefault(n), est.getMaxDepth(), est.getStepSize() if est.hasParam("stepSize") else None))
        return one(est.copy({n: 1}), rows)

    monkeypatch.setattr(fitting, "_fit_member", first_tree)
    out = q_compare_models(spark, SF).collect()
    assert sorted(told, key=str) == sorted([("maxIter", 300, 3, 0.01), ("numTrees", 300, 10, None), ("maxIter", 500, 5, 0.05)] * 5, key=str)
    assert sorted((r.model_order, r.fold) for r in out) == [(m, f) for m in range(3) for f in range(presets.FOLDS)]


def test_long_boosting_has_a_checkpoint_folder(spark, panel, monkeypatch):
    """Each round hangs on the one before; Spark cuts that chain only where the
    session has a checkpoint folder."""
    asked, spec = [], lambda n: fitting.ModelSpec("b", "boost", ["x_qty"], {"n_estimators": n, "max_depth": 1})
    monkeypatch.setattr(fitting, "ensure_checkpoint_dir", lambda s: asked.append(s))
    monkeypatch.setattr(fitting, "_fit_member", lambda est, rows, one=fitting._fit_member: one(est.copy({est.maxIter: 1}), rows))
    rows = panel.selectExpr("series", "day", "x_qty", "cast(y as double) AS y").dropna()
    fitting.fit(spec(20), rows)
    assert asked == []
    fitting.fit(spec(500), rows)
    assert asked == [spark]
