"""The pyramid of cells against the pair engine, and against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import features as fe, neighbours as nb, pyramid
from pulseframe.plans.views import points_view

PLAIN = tuple(d for d in fe.DESCRIPTORS if d not in fe.QUANTILES)


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))


def assert_same(left, right, skip=()):
    a, b = ({r.point_id: r.asDict() for r in df.collect()} for df in (left, right))
    assert a.keys() == b.keys() and a
    for i, row in a.items():
        for name, value in row.items():
            if not name.startswith(tuple(skip) or ("\0",)):
                assert close(value, b[i][name]), (i, name, value, b[i][name])


@pytest.fixture(scope="module")
def heaps(spark):
    """Dense places, coincident points, a lonely point and far coordinates."""
    rng = np.random.default_rng(11)
    dense = np.column_stack([rng.random((3000, 2)) * 1.5, rng.random(3000) * 0.3])
    wide = np.column_stack([rng.random((400, 2)) * 30, rng.random(400) * 8])
    xyz = np.vstack([dense, wide, np.tile([[20.0, 20.0, 1.0]], (150, 1)), [[500.0, -400.0, 90.0]]]) + [300_000.0, 5_000_000.0, 100.0]
    value = np.where(rng.random(len(xyz)) < 0.1, np.nan, rng.integers(0, 50, len(xyz)))
    rows = [(i, *map(float, p), None if i % 17 == 0 else float(v)) for i, (p, v) in enumerate(zip(xyz, value))]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, value double").cache()


def test_equals_pairs_on_the_given_points(spark):
    p = points_view(spark, "/root/testdata/sf0.001")
    names = [d for d in PLAIN if d not in fe.CURVATURE]
    both = [fe.compute_features(p, [0.5, 1.0, 2.0], names, sources={"intensity": fe.SOURCE_STATS}, engine=e) for e in ("pairs", "pyramid")]
    # Directions of neighbourhoods in a line or plane turn on rounding; so does the cube root of a product that is nothing.
    assert_same(*both, skip=("normal_", "dip", "verticality", "roughness", "signed", "moment", "omnivariance"))


def test_equals_pairs_in_dense_places(spark, heaps):
    stats = {"value": fe.SOURCE_STATS}
    names = [d for d in PLAIN if d not in fe.CURVATURE]
    pairs = fe.compute_features(heaps, [0.3, 0.9], names, sources=stats, engine="pairs")
    assert_same(pairs, fe.compute_features(heaps, [0.3, 0.9], names, sources=stats, engine="pyramid"), skip=("moment",))
    # Units divided by place give the same.
    assert_same(pairs, fe.compute_features(heaps, [0.3, 0.9], names, sources=stats, engine="pyramid", max_block_rows=200), skip=("moment",))


def test_curvature_equals_pairs(spark, heaps):
    both = [fe.compute_features(heaps.where("x < 300002"), [0.2, 0.4], fe.CURVATURE, engine=e) for e in ("pairs", "pyramid")]
    assert_same(*both)


def test_ranks_equal_sorted_lists(spark, heaps):
    stats = ("source_count", "source_minimum", "source_maximum", *fe.SOURCE_QUANTILES)
    f = fe.compute_features(heaps, [0.15, 1.0], tuple(fe.QUANTILES), sources={"value": stats}, core=F.col("point_id") % 40 == 0)
    rows = [tuple(r) for r in heaps.collect()]
    xyz = np.array([r[1:4] for r in rows])
    value = np.array([np.nan if r[4] is None else r[4] for r in rows])
    for row in f.collect():
        q = next(i for i, r in enumerate(rows) if r[0] == row.point_id)
        d = xyz - xyz[q]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        for r, text in ((0.15, "0p15"), (1.0, "1")):
            near = (d2 <= r * r) & (np.arange(len(rows)) != q)
            z, v = xyz[near, 2], value[near & np.isfinite(value)]
            for name, p in fe.QUANTILES.items():
                assert close(row[f"{name}_r{text}"], float(np.quantile(z, p)) if len(z) else None)
            found = {k: row[k] for k in row.asDict() if k.endswith(f"_r{text}") and "source" not in k}
            assert found
            for name, p in fe.SOURCE_QUANTILES.items():
                key = next(k for k in row.asDict() if k == fe.feature_column(name, r, "value"))
                assert close(row[key], float(np.quantile(v, p)) if len(v) else None)


def test_no_lists_and_two_shuffles(spark, heaps):
    f = fe.compute_features(heaps, [0.5, 1.0], tuple(fe.QUANTILES), sources={"value": tuple(fe.SOURCE_QUANTILES)})
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroups" in plan and plan.count("Exchange hash") == 2


def test_dense_neighbourhoods_choose_the_pyramid(spark, heaps):
    plan = fe.compute_features(heaps.where("x < 300002"), [1.0], fe.SHAPE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan
    sparse = fe.compute_features(heaps.where("point_id >= 3000"), [1.0], fe.SHAPE)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in sparse


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_only_the_border_is_walked(n):
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.random((n, 2)) * 4, np.zeros(n)])
    built = pyramid.Pyramid(points, np.zeros((n, 0)), 1.0)
    tile = points[np.argsort(((points - [2, 2, 0]) ** 2).sum(axis=1))[:100]]
    whole, walk = built.descend(tile.min(axis=0), tile.max(axis=0), np.array([1.0]), False)
    taken = sum(built.levels[d].sums[c, 0].sum() for d, c, _ in whole)
    inside = (((points - tile.mean(axis=0)) ** 2).sum(axis=1) <= 1).sum()
    assert 0.4 * inside < taken <= inside
    # Four times the points: about twice the border.
    assert len(walk) < 40 * math.sqrt(n)


def test_queries_apart_from_support(spark, heaps):
    support = heaps.where("point_id % 2 = 0")
    with_own = fe.compute_features(heaps.where("point_id % 2 = 1 OR point_id < 100"), [0.5], ("neighbor_count", "z_median"), support=support)
    rows = {r.point_id: r for r in with_own.collect()}
    xyz = {r.point_id: (r.x, r.y, r.z) for r in heaps.collect()}
    for i in list(rows)[::400]:
        near = sum(1 for j, p in xyz.items() if j % 2 == 0 and j != i and math.dist(p, xyz[i]) <= 0.5)
        assert rows[i].neighbor_count_r0p5 == near


def test_tiles_equal_joined_pairs(spark):
    """Sparse neighbourhoods: many pairs in all are walked tile by tile, each query's own point left out, and never joined."""
    rng = np.random.default_rng(31)
    xyz = np.vstack([rng.random((1200, 3)) * [12, 9, 1] + [440000, 4130000, 580], [[440002, 4130002, 580.5]] * 3, [[440100, 4130100, 580]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double")
    names = (*fe.SHAPE, *fe.NORMAL, *fe.HEIGHT, "neighbor_count", "moment_order_1", "barycenter_offset_ratio")
    pairs, tiles = (fe.compute_features(df, [0.4, 1.0], names, engine=e) for e in ("pairs", "tiles"))
    assert_same(pairs, tiles, skip=("normal_", "dip", "verticality", "roughness", "signed", "moment", "omnivariance"))
    assert_same(*(fe.compute_features(df, [1.0], fe.CURVATURE, engine=e, core=F.col("point_id") % 3 > 0) for e in ("pairs", "tiles")))
    # Divided places.
    assert_same(*(fe.compute_features(df, [1.0], ("neighbor_count", "planarity", "z_range"), engine=e, max_block_rows=60, carry=("x", "y")) for e in ("pairs", "tiles")))
    points = points_view(spark, "/root/testdata/sf0.01")
    for radii, names in (([1.5], fe.CURVATURE), ([0.5, 1.0], ("planarity", "z_range"))):
        plan = fe.compute_features(points, radii, names)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "ShuffledHashJoin" not in plan
    with pytest.raises(ValueError):
        fe.compute_features(df, [1.0], ("z_median",), engine="tiles")
