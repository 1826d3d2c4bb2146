import math

from pyspark.sql import functions as F

from panelcast.operators import splits


def _prep(panel):
    return panel.select("series", "day", "y")


def test_exact_holdout_size(panel):
    d = _prep(panel)
    n = d.count()
    h = splits.holdout(d, 0.3, 42, "exact")
    assert h.where("is_test").count() == math.ceil(0.3 * n)


def test_exact_folds_ntile_sizes_and_partition(panel):
    d = _prep(panel)
    n = d.count()
    f = splits.kfold(d, 5, 42, "exact")
    sizes = sorted((r.fold, r["count"]) for r in f.groupBy("fold").count().collect())
    q, big = divmod(n, 5)
    assert [c for _, c in sizes] == [q + 1 if i < big else q for i in range(5)]
    assert f.count() == n and f.where("fold IS NULL").count() == 0


def test_blocks_are_chronological(panel):
    f = splits.kfold(_prep(panel), 5, 42, "blocks")
    spans = sorted((r.fold, r.lo, r.hi) for r in f.groupBy("fold").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).collect())
    for (a, _, hi), (b, lo, _) in zip(spans, spans[1:]):
        assert hi <= lo


def test_split_does_not_depend_on_partitioning(panel):
    d = _prep(panel)
    a = {(r.series, r.day): r.fold for r in splits.kfold(d.repartition(1), 5, 42, "exact").collect()}
    b = {(r.series, r.day): r.fold for r in splits.kfold(d.repartition(7), 5, 42, "exact").collect()}
    c = {(r.series, r.day): r.fold for r in splits.kfold(d.repartition(64), 5, 42, "hash").collect()}
    c2 = {(r.series, r.day): r.fold for r in splits.kfold(d.repartition(3), 5, 42, "hash").collect()}
    assert a == b and c == c2


def test_small_bucket_threshold_exercises_descent(panel):
    d = splits.with_hash(_prep(panel), 42)
    order = [splits.HASH, "series", "day"]
    n = d.count()
    pos = [1, n // 3, n]
    got = splits.exact_cuts(d, order, splits._hash_levels(), pos, small=2)
    allrows = sorted(tuple(r) for r in d.select(*order).collect())
    assert [got[p] for p in pos] == [allrows[p - 1] for p in pos]


def test_n_smaller_than_k(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2020, 1, i), i) for i in range(1, 4)], "series string, day date, y long")
    f = splits.kfold(df, 5, 42, "exact")
    assert sorted(r.fold for r in f.collect()) == [0, 1, 2]


def test_param_grid_and_sample(spark):
    g = splits.param_grid(spark, {"max_depth": [5, None], "leaf": [1, 2, 5]})
    assert g.count() == 6
    assert g.where("max_depth IS NULL").count() == 3
    s = splits.param_sample(g, 4, 42)
    assert s.count() == 4 and s.select("candidate").distinct().count() == 4


def test_exact_folds_need_no_row_exchange(spark, panel):
    local = spark.createDataFrame(_prep(panel).collect(), _prep(panel).schema)   # a plain scan below the split
    f = splits.kfold(local, 5, 42, "exact")
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
