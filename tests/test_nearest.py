"""Nearest neighbours through the count pyramid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import neighbours as nb


def frame(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "point_id long, x double, y double, z double").cache()


def plain(xyz, q, k, positive=False):
    d = xyz - xyz[q]
    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
    ids = [i for i in np.lexsort((np.arange(len(xyz)), d2)) if i != q and (d2[i] > 0 or not positive)][:k]
    return [(i, d2[i]) for i in ids]


@pytest.fixture(scope="module")
def uneven():
    """Dense heaps, a thin field, copies, and points far from everything."""
    rng = np.random.default_rng(8)
    return np.vstack([rng.random((2500, 3)) * [2, 2, 0.2], rng.random((300, 3)) * [80, 80, 5], np.tile([[40.0, 40.0, 2.0]], (60, 1)),
                      [[900.0, -700.0, 50.0], [901.0, -700.0, 50.0], [-5000.0, 10.0, 0.0]]])


@pytest.mark.parametrize("crowded, positive", [(nb.CROWDED, False), (nb.CROWDED, True), (10, False), (10, True)])
def test_equal_to_all_distances(spark, uneven, crowded, positive):
    df = frame(spark, uneven)
    found = {}
    for r in nb.knn_join(df, df, 4, positive_only=positive, crowded=crowded).collect():
        found.setdefault(r.q_id, []).append((r["rank"], r.s_id, r.d2))
    assert set(found) == set(range(len(uneven)))
    for q in [*range(0, 2500, 97), *range(2500, len(uneven), 7), *range(len(uneven) - 3, len(uneven))]:
        assert [(i, d) for _, i, d in sorted(found[q])] == plain(uneven, q, 4, positive)


def test_a_far_point_looks_at_few(spark):
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.random((20_000, 3)) * [50, 50, 1], [[3000.0, 25.0, 0.5]]])
    df = frame(spark, xyz)
    corner, side, levels = {a: float(xyz[:, i].min()) for i, a in enumerate("xyz")}, 0.5, 14
    pyramid = nb.count_pyramid(df, corner, side, levels)
    assert pyramid.where(f"level = {levels}").first().n == len(xyz)
    candidates = nb._descended(df.where("x > 2000"), df, pyramid, corner, side, levels, 6).collect()
    assert 5 < len(candidates) < 500
    nearest = sorted((c.d2, c.s_id) for c in candidates if c.s_id != 20_000)[:5]
    assert [(i, d) for d, i in nearest] == plain(xyz, 20_000, 5)


def test_queries_apart_and_few_points(spark, uneven):
    df = frame(spark, uneven)
    apart = df.where("point_id >= 2500").withColumns({"point_id": F.col("point_id") + 100_000, "x": F.col("x") + 7.0})
    found = {(r.q_id, r["rank"]): r.d2 for r in nb.knn_join(apart, df, 2).collect()}
    assert len(found) == 2 * apart.count()
    for q in (102_500, 102_700, 102_862):
        d = uneven - (uneven[q - 100_000] + [7.0, 0, 0])
        assert found[q, 1] == pytest.approx(np.sort((d * d).sum(axis=1))[0])
    few = frame(spark, uneven[:3])
    assert nb.knn_join(few, few, 5).count() == 6


def test_queries_of_a_cell_share_the_cells_around(spark, uneven):
    """The 27 cells are listed once for each cell, not for each query's own finest cell, and hold what they should."""
    df = frame(spark, uneven[:2800])
    corner, side, levels = {a: float(uneven[:2800, i].min()) for i, a in enumerate("xyz")}, 0.05, 12
    own = nb._own_levels(df, nb.count_pyramid(df, corner, side, levels), corner, side, levels, 5)
    plan = own._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Generate explode" in line and "[k#" in line)
    assert "Aggregate [up" in plan[at + 1]
    cells = np.floor((uneven[:2800] - [corner[a] for a in "xyz"]) / side).astype(int)
    for r in own.where("point_id % 211 = 0").collect():
        up = cells >> (r.level + 1)
        assert r.near == (np.abs(up - up[r.point_id]).max(axis=1) <= 1).sum()
        assert (cells >> r.level == cells[r.point_id] >> r.level).all(axis=1).sum() >= 5
