def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) >= {"fold", "r2", "mae", "rmse"}


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_selection_ties_keep_declared_order(spark):
    from panelcast.operators import selection
    t = spark.createDataFrame([("b", 1, 0, 0.5), ("a", 0, 0, 0.5), ("c", 2, 0, 0.7)],
                              "model string, model_order int, fold int, r2 double")
    r = {x.model: x.rank for x in selection.rank_models(t).collect()}
    assert r == {"c": 1, "a": 2, "b": 3}
    b = {x.model: x.position for x in selection.leaderboard(t).collect()}
    assert b["a"] < b["b"]


def test_two_series_and_pca_studies(spark, tmp_path):
    from panelcast.plans import studies
    r = studies.two_series_study(spark, "/root/testdata/sf0.001")
    assert r["metrics"].count() == 1
    p = studies.pca_study(spark, "/root/testdata/sf0.001")
    v = p["variance"].orderBy("component").collect()
    assert abs(v[-1].cumulative - 1.0) < 1e-9 and v[-1].label == "100.0%"


def test_tree_and_boost_studies_small(spark):
    from panelcast.plans import studies
    t = studies.tree_study(spark, "/root/testdata/sf0.001", "tree", {"max_depth": [3, None], "min_samples_leaf": [5]})
    assert t["search"].count() == 2 and t["importance"].count() == 7
    b = studies.boost_search_study(spark, "/root/testdata/sf0.001",
                                   {"n_estimators": [3, 5], "max_depth": [2], "reg_lambda": [1, 2]}, draws=2)
    assert b["fold_r2"].count() == 5 and b["stability"].first().status in ("OK", "CHECK")


def test_presets_have_reference_sizes():
    from panelcast.operators import presets, splits
    assert len(splits.grid_candidates(presets.TREE_GRID)) == 20
    assert len(splits.grid_candidates(presets.FOREST_GRID)) == 324
    assert len(splits.grid_candidates(presets.BOOST_LOG_GRID)) == 192
    assert len(splits.grid_candidates(presets.BOOST_SPACE)) == 5184


def test_runs_from_a_bare_session_in_another_folder(tmp_path):
    """Workers must not depend on the driver's working folder."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.showConsoleProgress', 'false').getOrCreate()\n"
        "s.sparkContext.setLogLevel('ERROR')\n"
        "import __spark_entry__ as e\n"
        "print('ENTRY', len(e.entry(s).collect()))\n"
        "print('MLP', e.queries()['mlp_regression'](s, '/root/testdata/sf0.001').count())\n" % repo)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ENTRY 5" in out.stdout and "MLP 1" in out.stdout, out.stderr[-2000:]
