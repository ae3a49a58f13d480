"""Models fitted by sums over partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import fitting as ft, learning as ml


def table(spark, x, y=None, w=None):
    y, w = (np.zeros(len(x), int) if y is None else y), (np.ones(len(x)) if w is None else w)
    return spark.createDataFrame([(list(map(float, a)), int(b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, y int, w double").repartition(5).cache()


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0, 0], [6, 0, 1], [0, 7, -2]])
    y = rng.integers(0, 3, 900)
    return centres[y] + rng.normal(size=(900, 3)) * [1.0, 0.5, 1.5], y


def test_mixture_climbs_and_finds_the_groups(spark, blobs):
    x, y = blobs
    model = ft.fit_mixture(table(spark, x), [x[[0, 1, 2]], x[[5, 50, 500]]])
    steps = np.diff(model.likelihoods)
    assert (steps > -1e-9).all() and len(steps) > 1 and model.floor == ft.FLOORS[0]
    found = model.posteriors(x)
    np.testing.assert_allclose(found.sum(axis=1), 1)
    groups = found.argmax(axis=1)
    assert len({(a, b) for a, b in zip(groups, y)}) <= 6 and max(np.mean(groups[y == c] == np.bincount(groups[y == c]).argmax()) for c in range(3)) > 0.99
    order = np.argsort(model.weights)
    np.testing.assert_allclose(np.sort(model.weights), np.sort(np.bincount(y) / 900), atol=0.01)
    assert model.variances[order].shape == (3, 3) and (abs(np.sort(model.variances[:, 1]) - 0.25) < 0.08).all()


def test_degenerate_mixture_is_refused(spark):
    with pytest.raises(ValueError, match="degenerates"):
        ft.fit_mixture(table(spark, np.array([[0.0, 0.0]] * 50)), [np.array([[0.0, 0.0], [1e6, 1e6]])])


def test_network_slope_is_the_difference(spark, blobs):
    x, y = blobs
    df = table(spark, x[:60], y[:60], np.linspace(0.1, 3, 60))
    rng = np.random.default_rng(1)
    net = ft.Network([3, 5, 4, 3], rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3))
    loss, slope = ft._slope(df, net, 1e-3)
    for i in (0, 17, 30, 50, len(slope) - 1):
        step = np.zeros(len(slope))
        step[i] = 1e-6
        up, down = (ft._slope(df, ft.Network(net.sizes, net.values + s * step), 1e-3)[0] for s in (1, -1))
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_network_honours_weights_of_any_ratio(spark):
    """Two classes in one place, 500 to 1: with equal total weight the rare one is seen."""
    rng = np.random.default_rng(2)
    y = np.array([0] * 1000 + [1] * 2)
    x = np.vstack([rng.normal(size=(1000, 1)), [[0.0], [0.1]]])
    net = ft.fit_network(table(spark, x, y, np.where(y == 1, 500.0, 1.0)), [1, 4, 2], iterations=15)
    assert all(b <= a for a, b in zip(net.losses, net.losses[1:]))
    assert net.probabilities(np.array([[0.0]]))[0, 1] > 0.3
    plain = ft.fit_network(table(spark, x, y), [1, 4, 2], iterations=15)
    assert plain.probabilities(np.array([[0.0]]))[0, 1] < 0.1


def test_boosting_lowers_the_loss_and_adds_up_to_one(spark, blobs):
    x, y = blobs
    df = table(spark, x, y, np.where(y == 0, 2.0, 1.0))
    model = ft.fit_boosted(df, 3, 3, rounds=6, depth=3, rate=0.4, seed=3)
    assert len(model.losses) == 6 and (np.diff(model.losses) < 0).all()
    p = model.probabilities(x)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    assert np.mean(p.argmax(axis=1) == y) > 0.97
    again = ft.fit_boosted(df, 3, 3, rounds=2, depth=2, subsample=0.5, column_sample=0.4, seed=3)
    assert all((t.feature >= 0).sum() and len(set(t.feature[t.feature >= 0])) == 1 for trees in again.rounds for t in trees)
    rows = df.select(model.column("x").alias("p")).collect()
    assert len(rows) == 900 and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)


def test_rows_belong_to_their_nearest_leaf(spark, blobs):
    x, y = blobs
    leaves = ft.fit_leaves(table(spark, x), 3, 3, most=60)
    assert len(leaves.centres) <= 60 and set(leaves.cluster) == {0, 1, 2}
    d = leaves.near(x)
    nearest = leaves.cluster[((x[:, None, :] - leaves.centres[None]) ** 2).sum(axis=2).argmin(axis=1)]
    assert (d.argmin(axis=1) == nearest).all()
    for c in range(3):
        assert np.mean(nearest[y == c] == np.bincount(nearest[y == c]).argmax()) > 0.95
    with pytest.raises(ValueError, match="fewer distinct"):
        ft.fit_leaves(table(spark, np.ones((20, 2))), 3, 2)


@pytest.mark.parametrize("algorithm", ["hierarchical", "mixture"])
def test_cluster_contract(spark, blobs, algorithm):
    x, _ = blobs
    rows = [(i, float(a), None if i % 90 == 0 else float(b), i % 10 == 0) for i, (a, b, _) in enumerate(x)]
    df = spark.createDataFrame(rows, "point_id long, a double, b double, is_ground boolean")
    out = ml.cluster(df, ["a", "b"], 3, algorithm, ground="is_ground").collect()
    assert len(out) == 900 and {r.cluster_id for r in out if r.is_ground} == {0} and {r.cluster_id for r in out if not r.is_ground} == {1, 2, 3}
    assert all(0 <= r.cluster_confidence <= 1 for r in out)
