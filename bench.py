"""Headline timings.  Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from panelcast.session import get_session
    spark = get_session(f"local[{cpus}]", app="panelcast-bench", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    from panelcast.session import ship_package
    ship_package(spark)

    from panelcast.functions.metrics import metrics
    from panelcast.operators import linear, splits
    from panelcast.operators.fitting import ModelSpec, cross_validate
    from panelcast.plans.common import F_COMPARE, prep
    from panelcast.plans.registry import all_queries
    from panelcast.plans.studies import flagship

    qs = all_queries()

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def supplier_ols_cv():
        # the flagship on the supplier panel: 44-term expansion, 5 folds, one Gram pass
        d = splits.kfold(prep(spark, sf, F_COMPARE + ["y"], key="supplier"), 5, 42, "hash")
        spec = ModelSpec("ols_degree2", "ols", F_COMPARE, degree=2)
        return metrics(cross_validate(spec, d), "y", "prediction", ["fold"])

    def supplier_ridge_lasso_grid():
        # 2 families x 10 penalties x 5 folds from one Gram pass over the supplier panel
        d = splits.kfold(prep(spark, sf, F_COMPARE + ["y"], key="supplier"), 5, 42, "hash")
        from panelcast.functions.expand import Standardizer, poly, poly_terms
        z = Standardizer(F_COMPARE).fit(d).transform(d)
        x = poly(z, F_COMPARE, 2, prefix="t")
        terms = [f"t{i}" for i in range(44)]
        gs = linear.GramSet(x, terms, "y", by=["fold"], base=F_COMPARE, monomials=poly_terms(8, 2))
        rows = []
        for kind in ("ridge", "lasso"):
            cands = linear.linear_candidates(kind, linear.REFERENCE_ALPHAS)
            for s in linear.cv_scores(gs, cands):
                rows.append((kind, s["candidate"], s["fold"], s["r2"]))
        return spark.createDataFrame(rows, "kind string, candidate int, fold int, r2 double")

    def supplier_exact_folds():
        return splits.kfold(prep(spark, sf, ["y"], key="supplier"), 5, 42, "exact").groupBy("fold").count()

    from panelcast.operators.fitting import fit
    from panelcast.plans.common import F_TREE
    region = {}

    def region_panel():
        if "d" not in region:
            region["d"] = prep(spark, sf, F_TREE + ["y"])
            region["d"].count()
        return region["d"]

    def fit_only(spec):
        # the baseline's sizing probe: fit time on the prepared region panel
        d = region_panel()
        return fit(spec, d).transform(d).select("prediction")

    plan = [
        ("supplier_panel", lambda: qs["supplier_panel"](spark, sf)),
        ("supplier_exact_folds", supplier_exact_folds),
        ("supplier_ols_cv", supplier_ols_cv),
        ("supplier_ridge_lasso_grid", supplier_ridge_lasso_grid),
        ("flagship_region", lambda: flagship(spark, sf)),
        ("fold_metrics", lambda: qs["fold_metrics"](spark, sf)),
        ("union_series", lambda: qs["union_series"](spark, sf)),
        ("nested_cv", lambda: qs["nested_cv"](spark, sf)),
        ("grid_search", lambda: qs["grid_search"](spark, sf)),
        ("decision_tree", lambda: qs["decision_tree"](spark, sf)),
        ("random_forest", lambda: qs["random_forest"](spark, sf)),
        ("boosting", lambda: qs["boosting"](spark, sf)),
        ("pca", lambda: qs["pca"](spark, sf)),
        ("mlp_regression", lambda: qs["mlp_regression"](spark, sf)),
        ("network_search", lambda: qs["network_search"](spark, sf)),
        ("tree_search", lambda: qs["tree_search"](spark, sf)),
        ("compare_models", lambda: qs["compare_models"](spark, sf)),
        ("fit_tree_depth10", lambda: fit_only(ModelSpec("t", "tree", F_TREE, {"max_depth": 10}, scale=False))),
        ("fit_forest20_depth10", lambda: fit_only(ModelSpec("f", "forest", F_TREE,
                                                            {"n_estimators": 20, "max_depth": 10}, scale=False))),
        ("fit_boost20_depth3", lambda: fit_only(ModelSpec("b", "boost", F_TREE,
                                                          {"n_estimators": 20, "max_depth": 3}, scale=False))),
    ]
    # warm the JVM and the Python workers once (not part of any query)
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(10).mapInPandas(lambda it: it, "id long").collect()
    times = {}
    for name, fn in plan:
        if not name.startswith("fit_"):
            spark.catalog.clearCache()
            region.clear()
        elif "d" not in region:
            region_panel()          # prepared once, outside the timed fit
        t0 = time.time()
        run(fn())
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
