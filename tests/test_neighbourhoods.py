"""Radius joins and features against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import features as fe, neighbours as nb, tiling as ti
from pulseframe.plans.views import points_view
from pulseframe.schema import feature_column

SF = "/root/testdata/sf0.001"


def cloud(spark, xyz, **more):
    rows = [(i, *map(float, p), *[v[i] for v in more.values()]) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double" + "".join(f", {k} double" for k in more))


@pytest.fixture(scope="module")
def survey(spark):
    """1,500 points at survey coordinates, five of them coincident."""
    rng = np.random.default_rng(849)
    xyz = rng.random((1500, 3)) * [8, 8, 0.3] + [440000, 4130000, 580]
    xyz[10:15] = xyz[9]
    return xyz, cloud(spark, xyz).cache()


def brute_pairs(xyz, radius):
    d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    return d2, d2 <= radius * radius


@pytest.mark.parametrize("options", [{}, {"dims": 2}, {"dims": 3}, {"max_block_rows": 60}, {"dims": 3, "max_block_rows": 60}])
def test_pairs_equal_brute_force(spark, survey, options):
    xyz, df = survey
    _, hit = brute_pairs(xyz, 0.6)
    got = {(r.q_id, r.s_id) for r in nb.radius_join(df, df, 0.6, **options).select("q_id", "s_id").collect()}
    assert got == set(zip(*map(list, np.nonzero(hit))))


def test_dense_cells_are_kept_in_pieces(spark, survey, monkeypatch):
    xyz, df = survey
    monkeypatch.setattr(nb, "CELL_ROW_POINTS", 5)
    plan = nb.plan_neighbourhood(df, 0.6)
    assert plan.pieces > 1
    _, hit = brute_pairs(xyz, 0.6)
    assert nb.radius_join(df, df, 0.6, plan=plan).count() == hit.sum()


def test_coincident_points_pair_and_self_does_not(spark):
    df = cloud(spark, [(0, 0, 0), (0, 0, 0), (5, 5, 5)])
    assert sorted((r.q_id, r.s_id) for r in nb.radius_join(df, df, 1.0).collect()) == [(0, 1), (1, 0)]
    counts = {r.point_id: r.neighbor_count_r1 for r in fe.compute_features(df, [1.0], ("neighbor_count",)).collect()}
    assert counts == {0: 1.0, 1: 1.0, 2: 0.0}


def test_distance_bound_is_inclusive(spark):
    df = cloud(spark, [(0, 0, 0), (0.5, 0, 0), (0, 0.75, 0), (-0.5, 0, 0)])
    got = {(r.q_id, r.s_id) for r in nb.radius_join(df, df, 0.5).collect()}
    assert got == {(0, 1), (1, 0), (0, 3), (3, 0)}


def test_too_dense_is_refused(spark):
    df = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") * 1e-4).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    with pytest.raises(nb.NeighbourhoodTooDense):
        nb.radius_join(df, df, 10.0, max_candidates=2000)


def test_knn_equals_brute_force(spark, survey):
    xyz, df = survey
    d2, _ = brute_pairs(xyz, 1.0)
    got = {}
    for row in nb.knn_join(df, df, 3, start_radius=0.05).collect():
        got.setdefault(row.q_id, []).append((row.rank, row.s_id))
    for i in range(len(xyz)):
        want = sorted(range(len(xyz)), key=lambda j: (d2[i, j], j))[:3]
        assert [s for _, s in sorted(got[i])] == want


def test_knn_with_one_crowded_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.random((300, 3)) * 0.01, rng.random((60, 3)) * 100])
    monkeypatch.setattr(nb, "CROWDED", 50)
    df = cloud(spark, xyz)
    d2, _ = brute_pairs(xyz, 1.0)
    got = {}
    for row in nb.knn_join(df, df, 2).collect():
        got.setdefault(row.q_id, []).append((row.rank, row.s_id))
    for i in range(len(xyz)):
        assert [s for _, s in sorted(got[i])] == sorted(range(len(xyz)), key=lambda j: (d2[i, j], j))[:2]


def test_knn_returns_all_when_support_is_small(spark):
    df = cloud(spark, [(0, 0, 0), (100, 0, 0), (0, 300, 0)])
    assert nb.knn_join(df, df, 5).count() == 6


def reference_features(xyz, i, hit, radius):
    pts = xyz[hit[i]]
    out = {"neighbor_count": len(pts)}
    if len(pts) < 6:
        return out
    c = pts.mean(0)
    values, vectors = np.linalg.eigh(np.cov((pts - c).T, bias=True))
    l3, l2, l1 = values
    n = vectors[:, 0] * (1 if vectors[2, 0] >= 0 else -1)
    out.update(linearity=(l1 - l2) / l1, planarity=(l2 - l3) / l1, sphericity=l3 / l1, eigenvalues_sum=values.sum(),
               normal_z=n[2], signed_roughness=(xyz[i] - c) @ n, z_median=np.median(pts[:, 2]),
               z_percentile_90=np.quantile(pts[:, 2], 0.9), z_standard_deviation=pts[:, 2].std(), z_range=np.ptp(pts[:, 2]),
               barycenter_offset_ratio=np.linalg.norm(xyz[i] - c) / radius)
    p = (pts - xyz[i]) @ vectors[:, 1]
    out["moment_order_1"] = p.sum() ** 2 / (p ** 2).sum()
    height = int(np.argmax(np.abs(n)))
    u, v, w = ((pts - c)[:, a] for a in ((height + 1) % 3, (height + 2) % 3, height))
    a = np.column_stack([np.ones_like(u), u, v, u * u, u * v, v * v])
    k = np.linalg.lstsq(a, w, rcond=None)[0]
    q = (xyz[i] - c)
    x, y = q[(height + 1) % 3], q[(height + 2) % 3]
    fx, fy, fxx, fxy, fyy = k[1] + 2 * k[3] * x + k[4] * y, k[2] + k[4] * x + 2 * k[5] * y, 2 * k[3], k[4], 2 * k[5]
    s = 1 + fx * fx + fy * fy
    if np.linalg.matrix_rank(a) == 6:
        out["gaussian_curvature"] = abs(fxx * fyy - fxy ** 2) / s ** 2
        out["mean_curvature"] = abs((1 + fx * fx) * fyy - 2 * fx * fy * fxy + (1 + fy * fy) * fxx) / (2 * s ** 1.5)
    return out


def test_features_equal_numpy(spark, survey):
    xyz, df = survey
    rows = {r.point_id: r for r in fe.compute_features(df, [0.8, 1.2]).collect()}
    assert len(rows) == len(xyz)
    for radius in (0.8, 1.2):
        _, hit = brute_pairs(xyz, radius)
        for i in range(0, len(xyz), 7):
            for name, want in reference_features(xyz, i, hit, radius).items():
                got = rows[i][feature_column(name, radius)]
                assert got == pytest.approx(want, rel=1e-3, abs=2e-5), (i, name, radius)


def test_fewer_than_three_neighbours_give_no_shape(spark):
    df = cloud(spark, [(0, 0, 0), (0.1, 0, 0), (9, 9, 9)])
    rows = {r.point_id: r for r in fe.compute_features(df, [1.0], ("neighbor_count", "planarity", "z_mean", "dip", "z_median")).collect()}
    assert rows[0].planarity_r1 is None and rows[0].dip_r1 is None and rows[0].z_mean_r1 == 0.0
    assert rows[2].neighbor_count_r1 == 0 and rows[2].z_mean_r1 is None and rows[2].z_median_r1 is None


def test_degenerate_neighbourhoods_are_repeatable(spark):
    line = cloud(spark, [(i * 0.1, 0, 0) for i in range(12)])
    rows = fe.compute_features(line, [2.0], ("linearity", "normal_z", "roughness")).collect()
    assert all(r.linearity_r2 == pytest.approx(1.0) and r.normal_z_r2 == pytest.approx(1.0) and r.roughness_r2 == pytest.approx(0.0, abs=1e-9) for r in rows)


def test_lattice(spark):
    g = np.stack(np.meshgrid(*[np.arange(6) * 0.01] * 3), -1).reshape(-1, 3)
    df = cloud(spark, g)
    rows = {r.point_id: r for r in fe.compute_features(df, [0.015], ("neighbor_count", "z_median"), core=F.col("point_id") % 3 == 0).collect()}
    assert len(rows) == 72
    _, hit = brute_pairs(g, 0.015)
    assert all(r.neighbor_count_r0p015 == hit[i].sum() for i, r in rows.items())


def test_tiled_equals_whole(spark, survey):
    xyz, df = survey
    whole = {r.point_id: r.planarity_r1p2 for r in fe.compute_features(df, [1.2], ("planarity",)).collect()}
    grid = ti.TileGrid.over(df, 4.0)
    tiled = ti.replicate_halo(df, grid, ti.tile_with_radius(1.2))
    got = {}
    for t in tiled.select("tile_col", "tile_row").distinct().collect():
        one = tiled.where((F.col("tile_col") == t[0]) & (F.col("tile_row") == t[1]))
        for r in fe.compute_features(one, [1.2], ("planarity",), core=F.col("is_core")).collect():
            assert r.point_id not in got
            got[r.point_id] = r.planarity_r1p2
    assert got.keys() == whole.keys()
    assert all(got[i] == pytest.approx(whole[i], abs=2e-5) for i in whole)


def test_pairs_are_joined_without_moving_the_expansion(spark):
    p = points_view(spark, SF)
    f = fe.compute_features(p, [0.5, 1.0], fe.SHAPE)
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "ShuffledHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_adaptive_leaves_partition_the_points(spark, survey):
    xyz, df = survey
    leaves = ti.adaptive_tiles(df, ti.TileGrid.over(df, 8.0), 400, 0.5).collect()
    assert sum(r.core_points for r in leaves) == len(xyz) and all(r.context_points <= 400 for r in leaves)
    with pytest.raises(ValueError):
        ti.adaptive_tiles(df, ti.TileGrid.over(df, 8.0), 3, 2.0)
