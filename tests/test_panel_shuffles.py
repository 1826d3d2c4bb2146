"""The panel's shuffles carry only what is read."""

import pytest

from panelcast.plans.common import F_PCA

from conftest import SF_SMALL


@pytest.mark.parametrize("query", ["pca", "pca_loadings", "explained_variance", "pca_subspace"])
def test_components_shuffle_no_orders(spark, monkeypatch, query):
    """No count of distinct orders behind the cached panel."""
    from panelcast.operators import pca as pca_op
    from panelcast.plans.registry import all_queries
    seen = []
    for name in ("pca", "pca_subspace"):
        one = getattr(pca_op, name)
        monkeypatch.setattr(pca_op, name, lambda d, *a, one=one: seen.append(d) or one(d, *a))
    all_queries()[query](spark, SF_SMALL)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and set(F_PCA) <= set(seen[0].columns)


@pytest.mark.parametrize("bound, shuffled", [(None, False), (0, True)])
def test_suppliers_are_broadcast_within_a_bound(spark, monkeypatch, bound, shuffled):
    from panelcast.sources import fixture
    if bound is not None:
        monkeypatch.setattr(fixture, "BROADCAST_ROWS", bound)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = fixture.fixture_panel(spark, SF_SMALL).select("series", "day", "x_size")
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning(l_suppkey" in plan) == shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lineitem_is_not_shuffled_by_part(spark, monkeypatch):
    """However low the planner's own threshold is, up to the bound; the rows are
    the same above it."""
    from panelcast.sources import fixture
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def panel():
            d = fixture.fixture_panel(spark, "/root/testdata/sf0.001").select("series", "day", "y", "x_size")
            return d._jdf.queryExecution().executedPlan().toString(), sorted((r.series, r.day, r.y, round(r.x_size, 9)) for r in d.collect())
        plan, rows = panel()
        monkeypatch.setattr(fixture, "PART_ROWS", 0)
        above, same = panel()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(l_partkey" not in plan and "hashpartitioning(l_partkey" in above
    assert rows == same
