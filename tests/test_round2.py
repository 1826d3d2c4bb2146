"""Faults found in review: stale resumes, constant columns, repeated keys,
lags after drops, settings that come to the same model, plans that run jobs."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.expand import Standardizer
from panelcast.functions.metrics import metrics
from panelcast.operators import linear, moments, presets, splits, trees
from panelcast.operators.fitting import ModelSpec, compare, compare_scores, fit, fit_key, fold_scalers
from panelcast.operators.mlp import Mismatch, MLPConfig, NetworkModel, fit_mlp, row_key
from panelcast.operators.pca import pca
from panelcast.plans import studies
from panelcast.plans.common import F_TWO, prep
from panelcast.sources import io
from tests.conftest import SF_SMALL

FEATS = ["x_qty", "x_disc", "x_tax", "y_prev"]


@pytest.fixture(scope="module")
def folded(spark):
    return splits.kfold(prep(spark, SF_SMALL, FEATS + ["y"]), 3, 42, "hash").persist()


def scores(df):
    return {(r.model, r.fold): r.r2 for r in df.collect()}


def test_resume_is_keyed_by_settings_and_rows(folded, tmp_path):
    p = str(tmp_path / "progress")
    one, eight = (ModelSpec("c0", "tree", FEATS, {"max_depth": d}, scale=False) for d in (1, 6))
    a = scores(compare_scores([one], folded, progress=p))
    b = scores(compare_scores([eight], folded, progress=p))
    assert a != b and b == scores(compare_scores([eight], folded))
    assert a == scores(compare_scores([one], folded, progress=p))
    other = folded.withColumn("y", F.col("y") + F.when(F.col("x_qty") > 25, 1).otherwise(0))
    assert scores(compare_scores([eight], other, progress=p)) == scores(compare_scores([eight], other))


def test_resume_reads_what_is_done(folded, tmp_path):
    p = tmp_path / "progress"
    spec = ModelSpec("c0", "tree", FEATS, {"max_depth": 2}, scale=False)
    compare_scores([spec], folded, progress=str(p))
    before = {f: f.stat().st_mtime_ns for f in p.rglob("*.parquet")}
    compare_scores([spec], folded, progress=str(p))
    assert before == {f: f.stat().st_mtime_ns for f in p.rglob("*.parquet")}


def test_scores_of_a_search_equal_those_of_predictions(folded):
    specs = [ModelSpec("ols", "ols", FEATS), ModelSpec("tree", "tree", FEATS, {"max_depth": 3})]
    want = metrics(compare(specs, folded), "y", "prediction", ["model", "fold"])
    a, b = scores(compare_scores(specs, folded)), scores(want)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_fold_scalers_equal_fits_on_the_other_folds(folded):
    for f, sc in fold_scalers(folded, FEATS, "fold").items():
        own = Standardizer(FEATS).fit(folded.where(F.col("fold") != f))
        assert np.allclose(sc.means, own.means) and np.allclose(sc.stds, own.stds)


def test_equal_settings_are_fitted_once():
    forest = {fit_key(ModelSpec("c", "forest", FEATS, c, strict=False)) for c in splits.grid_candidates(presets.FOREST_GRID)}
    boost = {fit_key(ModelSpec("c", "boost", FEATS, c, strict=False)) for c in splits.grid_candidates(presets.BOOST_SPACE)}
    assert len(forest) == 108 and len(boost) == 576


def test_network_resume_refuses_other_settings(folded, tmp_path):
    d = row_key(splits.validation(folded, 0.2, 42)).persist()
    cfg = lambda **k: MLPConfig(**{"hidden": [4], "l2": [0.0], "dropout": [0.0], "epochs": 4, **k})
    snap = str(tmp_path / "snap")
    fit_mlp(d, FEATS[:2], "y", cfg(), snapshot=snap, snapshot_every=1)
    assert len(list(Path(snap).glob("epoch=*/_SUCCESS"))) == 3          # none overwritten
    for feats, c, rows in ((FEATS[:2], cfg(hidden=[5]), d), (FEATS[1:3], cfg(), d), (FEATS[:2], cfg(seed=1), d),
                           (FEATS[:2], cfg(), d.where("x_qty > 20"))):
        with pytest.raises(Mismatch):
            fit_mlp(rows, feats, "y", c, snapshot=snap)


def test_network_beats_least_squares_and_survives_a_save(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    path = str(tmp_path / "network")
    cfg = MLPConfig(hidden=[32, 16], l2=[1e-4, 1e-4], dropout=[0.0, 0.0], learning_rate=3e-3, epochs=15)
    out = studies.network_study(spark, sf, configs=[cfg], model_path=path)
    net = out["metrics"].first().r2
    d = splits.holdout(prep(spark, sf, FEATS + ["y"]), 0.3, 42, "hash")
    ols = metrics(fit(ModelSpec("ols", "ols", F_TWO), d.where(~F.col("is_test"))).transform(d.where("is_test"))).first().r2
    assert net > ols > 0
    assert json.loads(out["best"].first().params)["hidden"] == [32, 16]
    test = studies.network_data(spark, sf)[0].where("is_test")
    a = metrics(io.score_batch(test, path)).first()
    assert abs(a.r2 - net) < 1e-9 and isinstance(io.load_model(path), NetworkModel)
    from panelcast.streaming.scoring import score_stream
    few = test.drop("is_test", "is_valid", "_rowkey")
    few.write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), path, str(tmp_path / "out"), str(tmp_path / "chk"), schema=few.schema,
                 keep=["series", "day", "y"]).awaitTermination()
    assert abs(metrics(spark.read.parquet(str(tmp_path / "out"))).first().r2 - net) < 1e-9


def test_comparison_network_preset_is_a_configuration(folded):
    d = row_key(splits.validation(folded, 0.2, 42)).persist()
    cfg = MLPConfig(**{**presets.COMPARE_NETWORK, "epochs": 1})
    assert len(fit_mlp(d, FEATS[:2], "y", cfg).history) == 1


def test_constant_columns(spark):
    d = spark.range(700, numPartitions=7).selectExpr("cast(id as string) series", "current_date() day", "1000000.1D c", "id * 1.0D x", "id % 3 fold")
    z = Standardizer(["c", "x"]).fit(d).transform(d)
    assert z.agg(F.max(F.abs("c"))).first()[0] < 1e-6
    m = pca(d, ["c", "x"])
    assert m.transform(d).agg(F.max(F.abs("pc2"))).first()[0] < 1e-6
    held = d.withColumn("y", F.when(F.col("fold") == 0, F.lit(1000000.1)).otherwise(F.col("x")))
    gs = linear.GramSet(held, ["x"], "y", by=["fold"])
    found = {s["fold"]: s["r2"] for s in linear.cv_scores(gs, linear.linear_candidates("ols"))}
    assert found[0] is None and found[1] is not None
    assert metrics(held.where("fold = 0").withColumn("prediction", F.lit(1.0))).first().r2 is None


def test_repeated_keys_raise(spark, tmp_path):
    d = spark.range(6000).selectExpr("'a' series", "date'2020-01-01' day", "id y")
    with pytest.raises(ValueError, match="order key"):
        splits.kfold(d, 5, 42, "exact").count()
    d.limit(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="repeated key"):
        io.read_panel(spark, str(tmp_path / "p"), keys=("series", "day"))
    assert io.read_panel(spark, str(tmp_path / "p"), keys=("y",)).count() == 3


def test_two_series_lags_before_dropping(spark):
    """Steps of the study in pandas: previous record's target, then drop."""
    from panelcast.sources.fixture import fixture_panel
    p = fixture_panel(spark, SF_SMALL).drop("y_drop").toPandas().sort_values(["series", "day"])
    p = p[p.series.isin(["EUROPE", "ASIA"])]
    p["y_prev"] = p.groupby("series").y.shift()
    want = {(r.series, r.day): r.y_prev for r in p.dropna().itertuples()}
    got = {(r.series, r.day): r.y_prev for r in studies.two_series(spark, SF_SMALL, ("EUROPE", "ASIA")).collect()}
    assert got == want


def test_depth_and_bins_are_settings():
    with pytest.raises(trees.Unsupported):
        trees.tree({"max_depth": 31})
    est, notes = trees.tree({"max_depth": 31, "max_bins": 200}, strict=False)
    assert est.getMaxDepth() == 30 and est.getMaxBins() == 200 and len(notes) == 2
    assert trees.boost({"min_samples_leaf": 20})[0].getMinInstancesPerNode() == 20
    assert trees.boost({**{k: v[0] for k, v in presets.BOOST_LOG_GRID.items()}, "max_depth": 9})[0].getMaxDepth() == 5


def test_lasso_that_does_not_converge_raises():
    r = np.random.default_rng(0)
    x = r.standard_normal((50, 1)) + 1e-4 * r.standard_normal((50, 6))
    with pytest.raises(linear.NotConverged):
        linear._lasso_cd(x.T @ x, x.T @ r.standard_normal(50), 50, 1e-9, max_sweeps=2)


def test_building_a_gram_plan_starts_no_job(spark, folded):
    cols = [f"t{i}" for i in range(14)]
    wide = folded.select("fold", "y", *[(F.col("x_qty") + i).alias(c) for i, c in enumerate(cols)])
    ids = lambda: set(spark.sparkContext._jsc.sc().statusStore().jobsList(None).size() for _ in (0,))
    before = ids()
    moments.fold_gram(wide, cols, "y", shift=[0.0] * 15)
    assert ids() == before


def test_boost_log_study_scores_the_winner_on_blocks(spark, tmp_path):
    out = studies.boost_log_study(spark, SF_SMALL, str(tmp_path / "m"), {"n_estimators": [2], "max_depth": [2, 30], "num_leaves": [4], "learning_rate": [0.1]})
    assert out["block_scores"].count() == 5 and out["search"].count() == 2


def test_a_vote_shares_its_members(spark, panel, monkeypatch):
    """Learners that a vote has in common with another model are fitted once per
    fold; predictions are those of separate comparisons."""
    from panelcast.operators import fitting
    d = splits.kfold(panel.select("series", "day", "x_qty", "x_tax", "y").dropna(), 2, 42, "hash").persist()
    tree, forest = {"max_depth": 3}, {"n_estimators": 3, "max_depth": 3, "bootstrap": False}
    vote = ModelSpec("vote", "voting", ["x_qty", "x_tax"], members=[("forest", forest), ("tree", tree)], strict=False)
    alone = ModelSpec("tree", "tree", ["x_qty", "x_tax"], tree, strict=False)
    apart = [compare_scores([s], d).select("fold", "r2", "mse").orderBy("fold").collect() for s in (alone, vote)]
    fits = []
    one = fitting._fit_member
    monkeypatch.setattr(fitting, "_fit_member", lambda est, rows: fits.append(type(est).__name__) or one(est, rows))
    got = compare_scores([alone, vote], d, parallelism=4)
    assert len(fits) == 4                                   # two learners on two folds, not three
    for name, want in zip(("tree", "vote"), apart):
        assert got.where(F.col("model") == name).select("fold", "r2", "mse").orderBy("fold").collect() == want
    d.unpersist()
