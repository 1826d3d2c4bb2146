"""Successive halving: rows dealt once, networks as fitted apart, resumed at a
rung."""

import json
from dataclasses import replace

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from panelcast.operators import mlp
from panelcast.plans.studies import network_data


@pytest.fixture(scope="module")
def rows(spark):
    d, pre, terms, _ = network_data(spark, SF_SMALL)
    return pre.transform(d.where(~F.col("is_test"))).persist(), terms


CONFIGS = [replace(c, epochs=9, shards=3) for c in mlp.sample_configs(5, seed=3, space={
    "units_1": [8, 16], "extra_layers": [0, 1], "units_extra": [4, 8], "l2": [1e-4, 1e-3], "dropout": [0.0, 0.2], "learning_rate": [1e-3, 1e-2]})]


def test_budgets():
    assert mlp.budgets(15, 400) == [15, 45, 135, 400] and mlp.budgets(400, 400) == [400] and mlp.budgets(2, 9, 2) == [2, 4, 8, 9]


def test_networks_equal_separate_fits(spark, rows, monkeypatch):
    df, terms = rows
    dealt, passes = [], []
    begin, epoch = mlp.Dealt.__init__, mlp.run_epoch
    monkeypatch.setattr(mlp.Dealt, "__init__", lambda self, *a, **k: dealt.append(1) or begin(self, *a, **k))
    monkeypatch.setattr(mlp, "run_epoch", lambda d, nets: passes.append(len(nets)) or epoch(d, nets))
    found = mlp.halving_search(df, terms, "y", CONFIGS, first=1)
    assert found.budgets == [1, 3, 9] and len(dealt) == 1               # one shuffle of the rows for the search
    assert passes == [5] + [1] * 8                                      # five trials, the best third (1) goes on
    assert sorted(found.rungs) == [0, 0, 0, 0, 2] and found.rungs[found.best] == 2
    for i, fit in enumerate(found.fits):
        n = len(fit.history)
        apart = mlp.fit_mlp(df, terms, "y", replace(CONFIGS[i], epochs=n))
        assert n == (9 if i == found.best else 1)
        assert [h["val_loss"] for h in fit.history] == [h["val_loss"] for h in apart.history]
        assert np.array_equal(fit.theta, apart.theta)


def test_networks_share_passes_within_the_bound(monkeypatch):
    nets = [mlp.Training.begin(4, c, 0.0) for c in CONFIGS]
    size = [3 * len(n.theta) for n in nets]
    monkeypatch.setattr(mlp, "PASS_NUMBERS", size[0] + size[1])
    parts = mlp.groups(nets)
    assert [n for g in parts for n in g] == nets and all(len(g) == 1 or sum(3 * len(n.theta) for n in g) <= mlp.PASS_NUMBERS for g in parts)
    assert len(parts[0]) == 2


def test_a_search_resumes_at_a_rung(spark, rows, tmp_path, monkeypatch):
    df, terms = rows
    folder = str(tmp_path / "search")
    want = mlp.halving_search(df, terms, "y", CONFIGS[:3], first=1, factor=2)
    epoch, left = mlp.run_epoch, [3]

    def failing(d, nets):
        left[0] -= 1
        if left[0] < 0:
            raise RuntimeError("lost")
        epoch(d, nets)

    monkeypatch.setattr(mlp, "run_epoch", failing)
    with pytest.raises(RuntimeError, match="lost"):
        mlp.halving_search(df, terms, "y", CONFIGS[:3], first=1, factor=2, progress=folder)
    count = []
    monkeypatch.setattr(mlp, "run_epoch", lambda d, nets: count.append(1) or epoch(d, nets))
    got = mlp.halving_search(df, terms, "y", CONFIGS[:3], first=1, factor=2, progress=folder)
    assert got.rungs == want.rungs and got.best == want.best and len(count) == 9 - 2      # rungs of 1 and 2 epochs were done
    assert all(np.array_equal(a.theta, b.theta) for a, b in zip(got.fits, want.fits))
    with pytest.raises(mlp.Mismatch):
        mlp.halving_search(df, terms, "y", CONFIGS[1:4], first=1, factor=2, progress=folder)


def test_training_state_round_trip():
    net = mlp.Training.begin(3, CONFIGS[0], 1.5)
    net.judge(2.0)
    net.judge(3.0)
    back = mlp.Training.resume(CONFIGS[0], json.loads(json.dumps(net.state())))
    assert back.best == 2.0 and back.since_best == 1 and np.array_equal(back.theta, net.theta)
    assert mlp.Training.resume(CONFIGS[0], json.loads(json.dumps(mlp.Training.begin(3, CONFIGS[0], 0.0).state()))).best == np.inf


def test_shards_follow_from_the_rows(spark, rows, monkeypatch):
    df, terms = rows
    monkeypatch.setattr(mlp, "SHARD_ROWS", 100)
    n = df.count()
    fit = mlp.fit_mlp(df, terms, "y", replace(CONFIGS[0], shards=0, epochs=1))
    assert fit.config.shards == max(8, -(-n // 100)) > 8            # recorded with the fit
    with pytest.raises(ValueError, match="shards"):
        mlp.halving_search(df, terms, "y", [CONFIGS[0], replace(CONFIGS[1], shards=4)])
