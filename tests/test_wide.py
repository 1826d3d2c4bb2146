"""Solvers, components and correlations that don't hold p x p numbers:
against the Gram solver, closed forms and NumPy; wide tables; passes."""

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from panelcast.functions.expand import Standardizer, poly, poly_terms
from panelcast.operators import linear, pca, splits, wide
from panelcast.operators.moments import correlations, pair_moments
from panelcast.plans.common import F_LINEAR, F_PCA, prep


@pytest.fixture(scope="module")
def study(spark):
    """The linear study's 26 interaction terms on scaled inputs, five folds."""
    d = prep(spark, SF_SMALL, F_LINEAR + ["y_prev", "y"])
    z = Standardizer(F_LINEAR).fit(d).transform(d)
    x = poly(z, F_LINEAR, 3, interaction_only=True, bias=True, prefix="t")
    terms = poly_terms(len(F_LINEAR), 3, True, True)
    return splits.kfold(x, 5, 42, "hash").persist(), [f"t{i}" for i in range(len(terms))], wide.Columns(tuple(F_LINEAR), tuple(terms))


def test_squares_equal_the_gram_solver(study):
    df, terms, columns = study
    gs = linear.GramSet(df, terms, "y", by=["fold"])
    cands = linear.linear_candidates("ols") + linear.linear_candidates("ridge", [1.0])
    s = wide.Systems(df, columns, "y", "fold")
    for cand, (w, b) in zip(cands, wide.solve_wide(s, cands)):
        for i, f in enumerate(s.folds):
            fit = gs.fit(cand["kind"], cand["alpha"], keep=lambda k: str(k[0]) != f)
            assert np.abs(w[:, i] - fit.coef).max() < 1e-8 and abs(b[i] - fit.intercept) < 1e-8
    # iterations, not columns x folds x candidates, decide the number of passes
    assert s.passes < 40 * len(cands)


def test_lasso_equals_the_gram_solver(study):
    df, terms, columns = study
    gs = linear.GramSet(df, terms, "y", by=["fold"])
    s = wide.Systems(df, columns, "y", "fold")
    largest = float((np.abs(s.rhs) * s.length / s.n).max())         # from here up all coefficients are zero
    alphas = [0.7 * largest, 0.5 * largest, 2 * largest]
    path = wide.solve_lasso_path(s, alphas)
    assert (path[alphas[0]] != 0).any() and not path[alphas[2]].any()
    for a in alphas:
        w, b = s.coefficients(path[a])
        for i, f in enumerate(s.folds):
            fit = gs.fit("lasso", a, keep=lambda k: str(k[0]) != f)
            assert np.abs(w[:, i] - fit.coef).max() < 1e-8 and abs(b[i] - fit.intercept) < 1e-8
            assert ((w[:, i] != 0) == (np.abs(fit.coef) > 1e-12)).all()


def test_scores_equal_the_gram_scores(study):
    df, terms, columns = study
    cands = [{"kind": "ridge", "alpha": 1.0}, {"kind": "ols", "alpha": 0.0}]
    got = wide.cv_scores_wide(df, columns, "y", cands)
    want = linear.cv_scores(linear.GramSet(df, terms, "y"), cands)
    assert [(r["candidate"], r["fold"], r["n"]) for r in got] == [(r["candidate"], r["fold"], r["n"]) for r in want]
    for g, w in zip(got, want):
        assert all(abs(g[k] - w[k]) < 1e-8 * max(1, abs(w[k])) for k in ("sse", "sst", "mse", "rmse", "r2"))


def matrix_frame(spark, x, y, parts=2):
    folder = tempfile.mkdtemp(prefix="wide-", dir="/tmp")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"fold": pa.array(np.arange(len(x)) % 3, pa.int32()), "v": lists, "y": pa.array(y.astype(float))}), f"{folder}/x.parquet")
    return spark.read.parquet(folder).repartition(parts).persist()


def centred(x, y):
    return x - x.mean(0), y - y.mean()


def test_three_thousand_columns(spark):
    r = np.random.default_rng(7)
    n, p = 400, 3000
    x = r.standard_normal((n, p)) * r.uniform(0.5, 3, p) + r.uniform(-5, 5, p)
    true = np.zeros(p)
    true[r.choice(p, 8, replace=False)] = r.uniform(1, 3, 8)
    y = x @ true + r.standard_normal(n)
    df, columns = matrix_frame(spark, x, y), wide.Columns((), array="v", width=p)
    with pytest.raises(ValueError, match="columns"):
        from panelcast.operators.moments import fold_gram
        fold_gram(df.select("y", *[F.lit(0.0).alias(f"c{i}") for i in range(3)]), [f"c{i}" for i in range(p)], "y", ())
    xc, yc = centred(x, y)
    alpha = 5000.0
    fit = wide.fit_wide(df, columns, "y", "ridge", alpha)
    want = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(n), yc)         # the dual form
    assert np.abs(np.array(fit.coef) - want).max() < 1e-7
    assert abs(fit.intercept - (y.mean() - x.mean(0) @ want)) < 1e-5
    # more columns than rows: the minimum-norm fit in unit-length coordinates
    d = np.sqrt((xc ** 2).sum(0))
    fit = wide.fit_wide(df, columns, "y", "ols")
    want = np.linalg.lstsq(xc / d, yc, rcond=None)[0] / d
    assert np.abs(np.array(fit.coef) - want).max() < 1e-7
    # the Lasso's optimality conditions over all columns
    alpha = 2.0
    w = np.array(wide.fit_wide(df, columns, "y", "lasso", alpha).coef)
    g = xc.T @ (yc - xc @ w) / n
    on = w != 0
    assert 4 <= on.sum() < 50
    assert np.abs(g[on] - alpha * np.sign(w[on])).max() < 1e-7 and np.abs(g[~on]).max() <= alpha * (1 + 1e-7)
    df.unpersist()


def test_screening_is_checked(spark, monkeypatch):
    """Columns that the strong rule leaves out but the conditions ask for come
    back: with a rule that leaves out nearly all, the solution is the same."""
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 12)) @ (np.eye(12) + 0.1)
    y = x[:, :4].sum(1) + r.standard_normal(300)
    df, columns = matrix_frame(spark, x, y, parts=1), wide.Columns((), array="v", width=12)
    s, alpha = wide.Systems(df, columns, "y"), 0.6
    want = wide.solve_lasso_path(s, [alpha])[alpha]
    solve = wide._solve_chosen
    seen = []

    def stingy(s, u, limit, chosen, most):
        if not seen:
            chosen &= np.arange(12)[:, None] == np.abs(s.rhs).argmax(0)
        seen.append(int(chosen.sum()))
        return solve(s, u, limit, chosen, most)

    monkeypatch.setattr(wide, "_solve_chosen", stingy)
    assert np.abs(wide.solve_lasso_path(s, [alpha])[alpha] - want).max() < 1e-8 and len(seen) > 1 and seen[0] == 1


def test_constant_columns_and_large_means(spark):
    r = np.random.default_rng(5)
    x = np.column_stack([np.full(200, 7.1), r.standard_normal(200) + 1e6, r.standard_normal(200), np.zeros(200)])
    y = 3 * x[:, 1] - x[:, 2] + r.standard_normal(200)
    df, columns = matrix_frame(spark, x, y), wide.Columns((), array="v", width=4)
    for kind, alpha in (("ols", 0.0), ("ridge", 2.0), ("lasso", 0.1)):
        w = wide.fit_wide(df, columns, "y", kind, alpha).coef
        xc, yc = centred(x, y)
        s = xc[:, 1:3]
        if kind != "lasso":
            assert np.abs(np.array(w[1:3]) - np.linalg.solve(s.T @ s + alpha * np.eye(2), s.T @ yc)).max() < 1e-6
        else:
            assert np.abs(s.T @ (yc - s @ w[1:3]) / 200 - 0.1 * np.sign(w[1:3])).max() < 1e-7
        assert w[0] == w[3] == 0.0


def test_no_rows_raise(spark):
    df = spark.createDataFrame([], "a double, y double")
    with pytest.raises(ValueError, match="no rows"):
        wide.fit_wide(df, wide.Columns(("a",)), "y")
    with pytest.raises(ValueError, match="no rows"):
        pca.pca_subspace(df, ["a"], 1)


# --- components ---

def test_subspace_equals_eigh(spark, panel):
    d = panel.dropna(subset=F_PCA).persist()
    whole = pca.pca(d, F_PCA)
    for k in (2, 8):
        m = pca.pca_subspace(d, F_PCA, k)
        assert np.abs(m.eigenvalues - whole.eigenvalues[:k]).max() < 1e-9
        assert np.abs(np.abs(m.components) - np.abs(whole.components[:k])).max() < 1e-6
        assert abs(m.total - whole.total) < 1e-9 and (m.residuals < 1e-7).all()
        assert m.transform(d).columns[-k:] == [f"pc{i + 1}" for i in range(k)]
    d.unpersist()


def test_subspace_of_a_wide_table(spark):
    r = np.random.default_rng(11)
    n, p, k = 500, 3000, 4
    x = r.standard_normal((n, k)) * [9, 7, 5, 4] @ r.standard_normal((k, p)) + r.standard_normal((n, p)) * 3 + r.uniform(-9, 9, p)
    x[:, 17] = 2.5                                        # a constant column has no part
    df = matrix_frame(spark, x, np.zeros(n), parts=20)    # two levels of the QR tree
    m = pca.pca_subspace(df, wide.Columns((), array="v", width=p), k)
    sd = np.where(np.arange(p) == 17, 1.0, x.std(0))
    z = (x - x.mean(0)) / sd
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.abs(m.eigenvalues / (s[:k] ** 2 / n) - 1).max() < 1e-9
    assert np.abs(np.abs(m.components) - np.abs(vt[:k])).max() < 1e-6 and m.total == p - 1
    assert (m.residuals <= 1e-8 * m.eigenvalues[0]).all() and m.passes < 40
    df.unpersist()


def test_tree_qr_is_that_of_the_rows(spark):
    r = np.random.default_rng(2)
    blocks = [r.standard_normal((int(r.integers(0, 9)), 5)) for _ in range(40)]
    rows = spark.createDataFrame([(i, b.ravel().tolist()) for i, b in enumerate(blocks)], "leaf int, r array<double>").repartition(40, "leaf")
    got = pca.tree_qr(rows, 5)
    x = np.concatenate(blocks)
    assert np.abs(got.T @ got - x.T @ x).max() < 1e-9


# --- correlations ---

def test_correlations_in_one_scan(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((900, 44)) @ (np.eye(44) + 0.1) * 0.01 + 1e6 * (np.arange(44) % 2)
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.3
    x[:450, 6], x[450:, 7] = np.nan, np.nan               # no row has both
    pdf = pd.DataFrame(x, columns=[f"v{i}" for i in range(44)])
    df = spark.createDataFrame(pdf).repartition(6).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if i % 3 else F.col(c) for i, c in enumerate(pdf)])
    out = correlations(df, list(pdf))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Scan") <= 1
    got = {(a, b): c for a, b, c in out.collect()}
    want = pdf.corr(min_periods=2)
    assert len(got) == 946
    for (a, b), c in got.items():
        w = want.loc[a, b]
        assert (c is None and (np.isnan(w) or "v5" in (a, b))) or abs(c - w) < 1e-6, (a, b, c, w)
    assert got["v6", "v7"] is None and got["v0", "v5"] is None


def test_correlations_of_small_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0)], "a double, b double, c double")
    assert {tuple(r) for r in correlations(df, ["a", "b", "c"]).collect()} == {("a", "b", 1.0), ("a", "c", None), ("b", "c", None)}
    assert {r["corr"] for r in correlations(df.where("a > 9"), ["a", "b"]).collect()} <= {None}


def test_pair_moments_shift():
    x = pd.DataFrame({"a": [1e9 + 1, 1e9 + 2, 1e9 + 4], "b": [np.nan, 1.0, 2.0]})
    r = next(pair_moments(iter([x]), ["a", "b"])).iloc[0]
    assert (r.n, r.cxx, r.cxy, r.cyy) == (2, 2.0, 1.0, 0.5) and r.mx == 1e9 + 3


# --- solves on the executors ---

def test_solves_on_executors_equal_the_driver(spark, study, tmp_path):
    df, terms, columns = study
    df = splits.kfold(df, 4, 42, "hash", out="inner", salt="|in")
    blocks, shift = linear.gram_table(df, terms, "y", ["fold", "inner"], str(tmp_path / "gram"), base=list(columns.base), monomials=list(columns.monomials))
    q, cands = len(terms) + 2, linear.linear_candidates("lasso", [0.3, 0.02, 0.002])
    gs = linear.GramSet(df, terms, "y", by=["fold", "inner"], shift=shift)
    near = lambda a, b: abs(a - b) < 1e-8 * max(1, abs(b))
    got = {(r.fold, r.candidate): r for r in linear.table_scores(blocks, q, cands).collect()}
    want = linear.cv_scores(gs, cands)
    assert len(got) == len(want) == 15
    for r in want:
        g = got[r["fold"], r["candidate"]]
        assert g.n == r["n"] and all(near(g[k], r[k]) for k in ("sse", "sst", "mse", "rmse", "r2"))
    got = {r.fold: r for r in linear.table_nested(blocks, q, cands).collect()}
    for r in linear.nested_cv(gs, "lasso", [0.3, 0.02, 0.002]):
        g = got[r["fold"]]
        assert cands[g.candidate]["alpha"] == r["alpha"] and near(g.inner_score, r["inner_score"]) and near(g.r2, r["r2"]) and g.n == r["n"]


def test_the_driver_gets_scores_only(spark, study, tmp_path, monkeypatch):
    df, terms, columns = study
    blocks, _ = linear.gram_table(df, terms, "y", ["fold"], str(tmp_path / "gram"))
    taken = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(self.columns) or collect(self))
    monkeypatch.setattr(linear, "gram_matrices", None)          # no matrix is assembled on the driver
    out = linear.table_scores(blocks, len(terms) + 2, linear.linear_candidates("ridge", [1.0]))
    assert len(out.collect()) == 5
    assert taken == [["fold"], ["fold", "candidate", "n", "sse", "sst", "mse", "rmse", "r2"]]
