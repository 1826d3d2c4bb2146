import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.metrics import metrics
from panelcast.operators import linear, splits
from panelcast.operators.fitting import ModelSpec, cross_validate, fit
from panelcast.operators.mlp import MLPConfig, _sizes, _unpack, dropout_mask, grad_sums, init_params
from panelcast.operators.pca import pca
from panelcast.plans.common import F_LINEAR, F_PCA, prep
from tests.conftest import SF_SMALL

FEATS = ["x_qty", "x_disc", "x_tax", "y_prev"]


@pytest.fixture(scope="module")
def folded(spark):
    return splits.kfold(prep(spark, SF_SMALL, FEATS + ["y"]), 5, 42, "hash").persist()


@pytest.fixture(scope="module")
def pdf(folded):
    return folded.select(*FEATS, "y", "fold").toPandas()


def _np_fit(X, y, alpha=0.0):
    mx, my = X.mean(0), y.mean()
    Xc, yc = X - mx, y - my
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    return w, my - mx @ w


def test_ols_and_ridge_match_normal_equations(folded, pdf):
    gs = linear.GramSet(folded, FEATS, "y", by=["fold"])
    X, y = pdf[FEATS].to_numpy(float), pdf["y"].to_numpy(float)
    for kind, alpha in (("ols", 0.0), ("ridge", 10.0)):
        m = gs.fit(kind, alpha)
        w, b = _np_fit(X, y, alpha)
        assert np.allclose(m.coef, w, rtol=1e-8, atol=1e-10)
        assert abs(m.intercept - b) < 1e-8


def test_fold_scores_match_direct(folded, pdf):
    gs = linear.GramSet(folded, FEATS, "y", by=["fold"])
    sc = linear.cv_scores(gs, [{"kind": "ridge", "alpha": 3.0}])
    for s in sc:
        tr, te = pdf[pdf.fold != s["fold"]], pdf[pdf.fold == s["fold"]]
        w, b = _np_fit(tr[FEATS].to_numpy(float), tr.y.to_numpy(float), 3.0)
        pred = te[FEATS].to_numpy(float) @ w + b
        r2 = 1 - ((te.y - pred) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum()
        assert abs(s["r2"] - r2) < 1e-9


def test_lasso_kkt(folded, pdf):
    gs = linear.GramSet(folded, FEATS, "y", by=["fold"])
    X, y = pdf[FEATS].to_numpy(float), pdf["y"].to_numpy(float)
    Xc, yc = X - X.mean(0), y - y.mean()
    n = len(y)
    for alpha in (0.001, 0.05, 0.5):
        m = gs.fit("lasso", alpha)
        w = np.array(m.coef)
        g = Xc.T @ (yc - Xc @ w) / n
        for j in range(len(w)):
            if w[j] != 0:
                assert abs(g[j] - alpha * np.sign(w[j])) < 1e-7
            else:
                assert abs(g[j]) <= alpha + 1e-7


def test_lasso_all_zero_for_large_alpha(folded):
    gs = linear.GramSet(folded, FEATS, "y", by=["fold"])
    m = gs.fit("lasso", 1e6)
    assert all(c == 0 for c in m.coef)
    assert all(not kept for _, kept in linear.lasso_selection(m))


def test_cross_validation_never_trains_on_its_fold(spark, folded):
    spec = ModelSpec("ols", "ols", FEATS, scale=False)
    base = {(r.series, r.day): r.prediction for r in cross_validate(spec, folded).where("fold = 0").collect()}
    poisoned = folded.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * 1000).otherwise(F.col("y")))
    again = {(r.series, r.day): r.prediction for r in cross_validate(spec, poisoned).where("fold = 0").collect()}
    assert base.keys() == again.keys()
    assert max(abs(base[k] - again[k]) for k in base) < 1e-9


def test_ols_single_pass_equals_fold_scoped_pipeline(folded):
    spec = ModelSpec("ols2", "ols", FEATS, degree=2, scale=True)
    fast = {(r.series, r.day): r.prediction for r in cross_validate(spec, folded).collect()}
    spec_r = ModelSpec("ols2", "ridge", FEATS, {"alpha": 0.0}, degree=2, scale=True)
    slow = {(r.series, r.day): r.prediction for r in cross_validate(spec_r, folded, scale_scope="fold").collect()}
    assert max(abs(fast[k] - slow[k]) for k in fast) < 1e-6


def test_saved_pipeline_round_trip(spark, folded, tmp_path):
    from panelcast.sources import io
    m = fit(ModelSpec("s", "ridge", FEATS, {"alpha": 1.0}, degree=2, scale=True), folded)
    path = io.save_model(m.model, str(tmp_path / "model"))
    a = {(r.series, r.day): r.prediction for r in m.transform(folded).collect()}
    b = {(r.series, r.day): r.prediction for r in io.score_batch(folded, path, keep=["series", "day"]).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_metrics_constant_truth_gives_null_r2(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, prediction double")
    r = metrics(df).first()
    assert r.r2 is None and r.mae == 1.0 and r.mse == 1.0


def test_pca_matches_numpy(spark):
    from panelcast.sources.fixture import fixture_panel
    d = fixture_panel(spark, SF_SMALL).dropna(subset=F_PCA)
    m = pca(d, F_PCA)
    X = d.select(*F_PCA).toPandas().to_numpy(float)
    Z = (X - X.mean(0)) / X.std(0)
    vals, vecs = np.linalg.eigh(np.cov(Z.T, bias=True))
    vals = vals[::-1]
    assert np.allclose(m.eigenvalues, vals, atol=1e-9)
    assert abs(m.ratio.sum() - 1) < 1e-12
    for k in range(len(F_PCA)):
        v = vecs[:, ::-1][:, k]
        assert min(np.abs(m.components[k] - v).max(), np.abs(m.components[k] + v).max()) < 1e-6
        assert m.components[k][np.argmax(np.abs(m.components[k]))] > 0


def test_mlp_gradient_matches_finite_differences():
    cfg = MLPConfig(hidden=[5, 3], l2=[0, 0], dropout=[0.3, 0.0])
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(20, 4)), rng.normal(size=20)
    theta = init_params(4, cfg)
    shapes = _sizes(4, cfg)
    key = rng.integers(0, 2 ** 62, size=20).astype(np.uint64)
    masks = [dropout_mask(key, 3, 0, 5, 0.3), dropout_mask(key, 3, 1, 3, 0.0)]
    g, _ = grad_sums(_unpack(theta, shapes), X, y, masks)
    eps = 1e-6
    for i in rng.choice(len(theta), 12, replace=False):
        t1, t2 = theta.copy(), theta.copy()
        t1[i] += eps
        t2[i] -= eps
        f1 = grad_sums(_unpack(t1, shapes), X, y, masks)[1]
        f2 = grad_sums(_unpack(t2, shapes), X, y, masks)[1]
        assert abs((f1 - f2) / (2 * eps) - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_mlp_loss_falls(spark, folded):
    from panelcast.operators.mlp import fit_mlp, row_key
    d = row_key(splits.validation(folded, 0.2, 42)).persist()
    m = fit_mlp(d, FEATS[:3], "y", MLPConfig(hidden=[8], l2=[0.0], dropout=[0.0], learning_rate=0.05, epochs=15))
    assert m.history[-1]["loss"] < m.history[0]["loss"]


def test_unsupported_parameter_fails_loudly():
    from panelcast.operators import trees as tr
    with pytest.raises(tr.Unsupported):
        tr.boost({"reg_alpha": 0.1})
    est, notes = tr.boost({"reg_alpha": 0.1, "num_leaves": 31}, strict=False)
    assert est.getMaxDepth() == 5 and notes


def test_mlp_does_not_depend_on_partitioning(spark, folded):
    from panelcast.operators.mlp import fit_mlp, row_key
    d = row_key(splits.validation(folded, 0.2, 42)).persist()
    cfg = MLPConfig(hidden=[6], l2=[1e-3], dropout=[0.2], learning_rate=0.01, epochs=4)
    a = fit_mlp(d.repartition(1), FEATS[:3], "y", cfg)
    b = fit_mlp(d.repartition(7), FEATS[:3], "y", cfg)
    assert np.allclose(a.theta, b.theta, rtol=1e-8, atol=1e-10)


def test_gram_fit_invariant_to_partitioning(folded):
    a = linear.GramSet(folded.repartition(1), FEATS, "y", by=["fold"]).fit("ridge", 2.0)
    b = linear.GramSet(folded.repartition(13), FEATS, "y", by=["fold"]).fit("ridge", 2.0)
    assert np.allclose(a.coef, b.coef, rtol=1e-10) and abs(a.intercept - b.intercept) < 1e-9


def test_voting_is_mean_of_members_and_importances_sum_to_one(spark, folded):
    from panelcast.operators import trees as tr
    boost = {"n_estimators": 3, "max_depth": 2}
    forest = {"n_estimators": 4, "max_depth": 3}
    vote = fit(ModelSpec("v", "voting", FEATS, members=[("boost", boost), ("forest", forest)]), folded)
    a = fit(ModelSpec("b", "boost", FEATS, boost), folded)
    b = fit(ModelSpec("f", "forest", FEATS, forest), folded)
    key = ["series", "day"]
    pv = {tuple(r[:2]): r[2] for r in vote.transform(folded).select(*key, "prediction").collect()}
    pa = {tuple(r[:2]): r[2] for r in a.transform(folded).select(*key, "prediction").collect()}
    pb = {tuple(r[:2]): r[2] for r in b.transform(folded).select(*key, "prediction").collect()}
    assert max(abs(pv[k] - (pa[k] + pb[k]) / 2) for k in pv) < 1e-9
    imp = tr.impurity_importance(b.members[0], FEATS)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-9


def test_split_counts_match_internal_nodes(spark, folded, tmp_path):
    from panelcast.operators import trees as tr
    m = fit(ModelSpec("t", "tree", FEATS, {"max_depth": 3}, scale=False), folded)
    nodes = tr.node_table(spark, m.members[0], str(tmp_path / "tree"))
    counts = {r.feature: r.importance for r in tr.split_importance(nodes, FEATS).collect()}
    assert sum(counts.values()) == m.members[0].numNodes // 2      # binary tree: internal = (nodes - 1) / 2


def test_compare_resumes_from_progress(spark, folded, tmp_path):
    from panelcast.operators.fitting import compare
    spec = ModelSpec("tree3", "tree", FEATS, {"max_depth": 3}, scale=False)
    prog = str(tmp_path / "progress")
    a = {(r.series, r.day): r.prediction for r in compare([spec], folded, progress=prog).collect()}
    b = {(r.series, r.day): r.prediction for r in compare([spec], folded, progress=prog).collect()}
    assert a == b
    from pathlib import Path
    assert len(list(Path(prog).glob("*/fold=0/_SUCCESS"))) == 1      # one folder for one setting on these rows


def test_mlp_snapshot_resume(spark, folded, tmp_path):
    from panelcast.operators.mlp import fit_mlp, row_key
    d = row_key(splits.validation(folded, 0.2, 42)).persist()
    cfg = MLPConfig(hidden=[4], l2=[0.0], dropout=[0.0], learning_rate=0.01, epochs=6)
    full = fit_mlp(d, FEATS[:2], "y", cfg)
    snap = str(tmp_path / "snap")
    short = MLPConfig(hidden=[4], l2=[0.0], dropout=[0.0], learning_rate=0.01, epochs=4)
    fit_mlp(d, FEATS[:2], "y", short, snapshot=snap, snapshot_every=2)     # leaves a snapshot at epoch 2
    resumed = fit_mlp(d, FEATS[:2], "y", cfg, snapshot=snap, snapshot_every=100)
    assert np.allclose(resumed.theta, full.theta, rtol=1e-9, atol=1e-12)
