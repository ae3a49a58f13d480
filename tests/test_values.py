"""Hand cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import scalar as fn
from pulseframe.operators import grid as gr, learning as ml, ledger as le, metrics as me, profile as pr, ranking, rules as ru, selection as se, structures as st, terrain as te
from pulseframe.sources import points as src, sinks
from pulseframe.streaming import progress, tiles as stt


def points(spark, rows, extra=""):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "point_id long, x double, y double, z double" + extra)


def test_field_statistics(spark):
    df = spark.createDataFrame([(v, float("nan")) for v in (1.0, 2.0, float("nan"), 3.0, 4.0, float("inf"))], "v double, e double")
    rows = {r.field: r for r in pr.field_stats(df, ["v", "e"]).collect()}
    assert (rows["v"].finite, rows["v"].missing, rows["v"].minimum, rows["v"].maximum, rows["v"].mean) == (4, 2, 1.0, 4.0, 2.5)
    assert rows["e"].finite == 0 and rows["e"].mean is None
    s = pr.feature_statistics(df, ["v"]).first()
    assert s.standard_deviation == pytest.approx(math.sqrt(1.25)) and s.median == 2.5


def test_ground_filter_flat_with_shrub(spark):
    df = points(spark, [(float(x), float(y), 0.0) for x in range(5) for y in range(5)] + [(2.0, 2.0, 2.0)])
    out = {r.point_id: r.is_ground for r in te.pmf_ground(df, (1.5, 3.0), (0.2, 0.5)).collect()}
    assert sum(out.values()) == 25 and not out[25]
    for bad in (((3.0,), (0.1, 0.2)), ((3.0, 2.0), (0.1, 0.2)), ((), ()), ((3.0,), (-1.0,))):
        with pytest.raises(ValueError):
            te.pmf_ground(df, *bad)


def test_ground_raster_keeps_the_requested_cell(spark):
    far = points(spark, [(0.0, 0.0, 0.0), (5000.0, 5000.0, 0.0)])
    raster = te.pmf_raster(far, (3.0, 6.0), (0.5, 0.8))
    assert raster.step == 0.5 and raster.cells > 8_000_000
    assert te.pmf_raster(far, (3.0,), (0.5,), 0.25).step == 0.25


def test_bilinear_corners_and_gaps(spark):
    raster = te.Raster(0.0, 0.0, 1.0, 2, 2, True)
    grid = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0)], "col int, row int, height double")
    df = points(spark, [(0.5, 0.5, 0.0), (1.0, 1.0, 0.0), (1.01, 0.5, 0.0), (-0.1, 0.0, 0.0), (0.0, 0.0, 0.0)])
    assert [r.terrain for r in te.dtm_lookup(df, grid, raster).orderBy("point_id").collect()] == [2.5, 4.0, None, None, 1.0]
    assert [r.terrain for r in te.dtm_lookup(df, grid.where("height < 4"), raster).collect()] == [None] * 5


def test_polygon_boundary_concave_and_empty(spark):
    df = points(spark, [(0.0, 0.0, 0.0), (1.0, 0.5, 0.0), (0.5, 0.5, 0.0), (1.5, 1.5, 0.0), (2.0, 0.5, 0.0), (3.0, 3.0, 0.0)])
    square = {r.point_id for r in se.in_polygon(df, [(0, 0), (1, 0), (1, 1), (0, 1)]).collect()}
    assert square == {0, 1, 2}
    ell = {r.point_id for r in se.in_polygon(df, [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]).collect()}
    assert ell == {0, 1, 2, 4}
    assert se.in_polygon(df, [(0, 0), (1, 1)]).count() == 0


def test_slab_equals_brute_force(spark):
    values = [((i * 317) % 10003) * 0.013 - 15 for i in range(10003)]
    df = spark.createDataFrame(list(enumerate(values)), "point_id long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    got = {r.point_id for r in se.section_slab(df, (1.0, 0.0, 0.0), 3.0, 4.0).collect()}
    assert got == {i for i, v in enumerate(values) if abs(v - 3.0) <= 2.0}


def test_range_review(spark):
    df = spark.createDataFrame([(c == 2, v) for c, v in zip((2, 6, 6, 6, 6), (float("nan"), 0.25, 0.5, 0.75, float("nan")))], "is_ground boolean, f double")
    assert [r.review_status for r in se.range_review(df, {"f": (0.25, 0.5)}).collect()] == [0, 0, 0, 1, 1]
    assert {r.review_status for r in se.range_review(df, {}).collect()} == {0}


PLANE, VOLUME = (30.0, 0.85, 0.01, 0.005, 0.005), (30.0, 0.1, 0.5, 0.15, 0.2)
FEW = (5.0, 0.1, 0.5, 0.15, 0.2)


@pytest.mark.parametrize("scale, ground, code, hag, want", [
    (VOLUME, False, 1, 3.0, ru.VEGETATION), (VOLUME, True, 1, 3.0, ru.GROUND), (VOLUME, False, 1, 0.1, ru.UNCERTAIN),
    (VOLUME, False, 1, -1.0, ru.UNCERTAIN), (VOLUME, False, 7, 3.0, ru.EXCLUDED), (FEW, False, 1, 3.0, ru.UNCERTAIN),
    (VOLUME, False, 1, None, ru.VEGETATION), (PLANE, False, 1, 3.0, ru.OTHER_SURFACE)])
def test_vegetation_rules(spark, scale, ground, code, hag, want):
    kind = "array<struct<count:double,planarity:double,scattering:double,variation:double,roughness_ratio:double>>"
    df = spark.createDataFrame([([scale] * 3, ground, code, hag)], f"scales {kind}, is_ground boolean, classification int, hag double")
    t = dict(planar=0.5, scattering=0.12, variation=0.04, roughness_ratio=0.06, near_ground=0.25, minimum_neighbors=12, preset=0)
    assert ru.vegetation_decide(df, t).first().category == want


def test_score_threshold(spark):
    df = spark.createDataFrame([(i == 0, 1, s) for i, s in enumerate((float("nan"), 0.9, 0.2, 0.8, float("nan")))], "is_ground boolean, classification int, score double")
    assert [r.score_class for r in ru.score_threshold(df, 0.5).collect()] == [3, 1, 0, 1, 0]


def test_return_fractions(spark):
    rows = [(0.1 * i, float(j), 0.0, 2 if k < 100 else 4, 1, k % 2) for k, (i, j) in enumerate((i, j) for i in range(15) for j in range(15))]
    df = points(spark, rows, ", classification int, return_number int, number_of_returns int")
    assert pr.cloud_profile(df).first().valid_return_fraction < 0.51
    assert {r.code: r.n for r in pr.return_histograms(df).where("kind = 'class_code'").collect()} == {2: 100, 4: 125}


def test_void_filling_guards(spark):
    raster = te.Raster(0.0, 0.0, 1.0, 5, 5, True)
    ring = [(c, r, 10.0 + 0.01 * c) for c in range(5) for r in range(5) if (c, r) not in ((2, 2), (0, 0))]
    grid = spark.createDataFrame(ring, "col int, row int, height double")
    options = te.FillOptions(radius=1.5)
    out = {(r.col, r.row): r for r in te.fill_voids(grid, raster, "mean", options).collect()}
    assert out[2, 2].outcome == "filled" and out[2, 2].height == pytest.approx(10.02) and out[0, 0].outcome == "insufficient"
    krige = {(r.col, r.row): r for r in te.fill_voids(grid, raster, "kriging", options, te.Variogram("spherical", 0.0, 1.0, 4.0)).collect()}
    assert krige[2, 2].outcome == "filled" and krige[2, 2].height == pytest.approx(10.02, abs=1e-6)
    steep = grid.withColumn("height", F.when(F.col("col") > 2, 20.0).otherwise(10.0))
    assert {r.outcome for r in te.fill_voids(steep, raster, "idw", options).where("col = 2 AND row = 2").collect()} == {"discontinuity"}
    with pytest.raises(ValueError):
        te.fill_voids(grid, raster, "mean", te.FillOptions(radius=100.0))


def test_kriging_equals_direct_solution(spark):
    rng = np.random.default_rng(3)
    raster = te.Raster(0.0, 0.0, 0.5, 7, 7, True)
    heights = {(c, r): float(rng.random() * 0.1) for c in range(7) for r in range(7) if (c, r) != (3, 3)}
    grid = spark.createDataFrame([(c, r, h) for (c, r), h in heights.items()], "col int, row int, height double")
    model = te.Variogram("exponential", 0.02, 0.5, 2.0)
    options = te.FillOptions(radius=1.0, maximum_support=8)
    got = te.fill_voids(grid, raster, "kriging", options, model).where("state = 2").first().height
    near = sorted(((c - 3) ** 2 + (r - 3) ** 2, r * 7 + c, c - 3, r - 3) for c, r in heights)[:8]
    xy = np.array([(dx, dy) for _, _, dx, dy in near]) * 0.5
    z = np.array([heights[dx + 3, dy + 3] for _, _, dx, dy in near])
    a = np.ones((9, 9))
    a[:8, :8] = model.gamma(np.linalg.norm(xy[:, None] - xy[None], axis=-1))
    a[8, 8] = 0
    b = np.append(model.gamma(np.linalg.norm(xy, axis=1)), 1.0)
    assert got == pytest.approx(np.linalg.solve(a, b)[:8] @ z)


def test_opening_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    g = rng.random((9, 12))
    g[rng.random(g.shape) < 0.3] = np.nan
    df = spark.createDataFrame([(c, r, float(g[r, c])) for r in range(9) for c in range(12) if np.isfinite(g[r, c])], "col int, row int, v double")
    dense = gr.densify(df, 12, 9)

    def sweep(a, best, k):
        out = np.full(a.shape, np.nan)
        for r in range(a.shape[0]):
            for c in range(a.shape[1]):
                w = a[max(0, r - k):r + k + 1, max(0, c - k):c + k + 1]
                if np.isfinite(w).any():
                    out[r, c] = best(w)
        return out

    want = sweep(sweep(g, np.nanmin, 2), np.nanmax, 2)
    for row in gr.opening(dense, "v", 2).collect():
        assert row.opened == pytest.approx(want[row.row, row.col])


def test_exact_quantiles_with_heavy_ties(spark):
    values = [5.0] * 4000 + [float(v) for v in range(3000)] + [float("nan"), 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("w", F.lit(None).cast("double"))
    finite = np.sort([v for v in values if np.isfinite(v)])
    probabilities = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    rows = {r.field: r for r in ranking.exact_quantiles(df, ["v", "w"], probabilities, small=50).collect()}
    assert [rows["v"][f"q{i}"] for i in range(6)] == pytest.approx(np.quantile(finite, probabilities).tolist())
    assert rows["w"].valid == 0 and rows["w"].q0 is None
    near = ranking.exact_quantiles(df, ["v"], [0.5], method="nearest", small=50).first()
    assert near.q0 == finite[math.floor(0.5 * (len(finite) - 1) + 0.5)]


def test_smallest_per_group_with_one_dominant_group(spark):
    df = spark.range(20000).select(F.col("id").alias("point_id"), F.when(F.col("id") % 100 == 0, 2).otherwise(6).alias("c")).withColumn("m", se.mix("point_id"))
    got = ranking.smallest_per_group(df, ["c"], "m", "point_id", 700, buckets=16).collect()
    rows = df.collect()
    for c in (2, 6):
        want = {r.point_id for r in sorted((r for r in rows if r.c == c), key=lambda r: (r.m, r.point_id))[:700]}
        assert {r.point_id for r in got if r.c == c} == want


def test_thinning_is_exact(spark):
    for n, percent in ((10, 37), (101, 50), (7, 1), (5, 100)):
        df = spark.range(n).select(F.col("id").alias("point_id"))
        assert se.thin_percent(df, percent).count() == math.ceil(n * percent / 100)


def test_components_of_a_long_chain_and_islands(spark):
    chain = [(i, 0, 0) for i in range(200)] + [(500 + (i // 3), i % 3, 7) for i in range(30)] + [(-9, -9, -9)]
    df = spark.createDataFrame(chain, "vx long, vy long, vz long")
    sizes = sorted(r["count"] for r in st.components(df).groupBy("component").count().collect())
    assert sizes == [1, 30, 200]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(" 3,5 ", 0.07), ("1,2.5", 0.0), ("x", 600.0), ("-2.5e1", 1.0)], "t string, v double")
    rows = df.select(fn.parse_number_locale("t").alias("n"), fn.preferred_125("v").alias("p"), fn.decode_field_key(fn.encode_field_key("t")).alias("back"), "t").collect()
    assert [r.n for r in rows] == [3.5, None, None, -25.0]
    assert [r.p for r in rows] == pytest.approx([0.1, 0.0, 1000.0, 1.0])
    assert all(r.back == r.t for r in rows)


def test_ledger_durable_undo_redo(spark, tmp_path):
    base = le.init_labels(spark.createDataFrame([(i, 2 if i < 3 else 5) for i in range(6)], "point_id long, classification int"))
    book = le.Ledger(base, str(tmp_path / "ledger"))
    ids = spark.createDataFrame([(4,), (5,)], "point_id long")
    assert book.append(le.manual_edits(book.state(), ids, 2, book.next_version()), "manual", code=2) == 6
    assert book.append(le.manual_edits(book.state(), ids, 2, book.next_version()), "manual") == 0
    assert {r.point_id for r in book.state().where("is_ground").collect()} == {4, 5}
    assert book.undo() and book.state().where("working_class = 2").count() == 3 and not book.undo()
    assert book.redo() and book.state().where("trusted_class = 2").count() == 2
    book.undo()
    book.append(le.manual_edits(book.state(), ids, 6, book.next_version()), "manual", code=6)
    assert not book.redo() and [r.operation for r in book.history().collect()] == ["manual", "undo", "redo", "undo", "manual"]
    with pytest.raises(le.StaleResult):
        le.check_revision(1, 2)
    with pytest.raises(ValueError):
        le.drop_fields(base, ["working_class"])
    with pytest.raises(Exception):
        le.auto_edits(base, ids.withColumn("proposal", F.lit(2)), 9).collect()


def test_ground_revision_is_read_from_the_log(spark, tmp_path):
    base = le.init_labels(points(spark, [(float(i), 0.0, 0.0) for i in range(6)]).withColumns({"classification": F.lit(1), "preview": F.lit(1.0)}))
    book = le.Ledger(base, str(tmp_path / "book"))
    assert book.ground_revision == 0
    book.append(le.ground_edits(book.state(), "preview", book.next_version(), selection=base.where("point_id < 3")), "ground")
    assert book.ground_revision == 1 and book.state().where("is_ground").count() == 3
    book.undo()
    assert book.ground_revision == 2
    again = le.Ledger(base, str(tmp_path / "book"))
    assert again.ground_revision == 2 and again.redo() and again.ground_revision == 3
    assert [r.operation for r in again.history().collect()] == ["ground", "undo", "redo"]
    with pytest.raises(le.StaleResult):
        le.check_revision(1, again.ground_revision)


def test_kriging_solves_at_any_sill_and_support(spark):
    rng = np.random.default_rng(1)
    grid = [(c, r, float(rng.normal(0, 0.05))) for c in range(15) for r in range(15) if (c, r) != (7, 7)]
    raster = te.Raster(0.0, 0.0, 1.0, 15, 15, True)
    df = spark.createDataFrame(grid, "col int, row int, height double")
    for sill in (1e-4, 1.0, 1e2):
        for k in (16, 64):
            v = te.Variogram("spherical", 0.0, sill, 5.0)
            options = te.FillOptions(radius=6.0, maximum_range=9.0, maximum_deviation=9.0, minimum_support=4, maximum_support=k, surrounding=False)
            cell = te.fill_voids(df, raster, "kriging", options, v).where("col = 7 AND row = 7").first()
            assert cell.outcome == "filled", (sill, k)
            near = sorted(((c - 7) ** 2 + (r - 7) ** 2, r, c, z) for c, r, z in grid)
            top = [n for n in near if n[0] <= near[k - 1][0]]
            if len(top) == k:  # no tie at the edge: the support is the same
                xy, z = np.array([(n[2], n[1]) for n in top], float), np.array([n[3] for n in top])
                a = np.ones((k + 1, k + 1))
                a[:k, :k] = v.gamma(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)))
                a[k, k] = 0
                b = np.append(v.gamma(np.sqrt(((xy - 7.0) ** 2).sum(-1))), 1.0)
                assert cell.height == pytest.approx(float(np.linalg.solve(a, b)[:k] @ z), abs=1e-6)
    with pytest.raises(ValueError):
        te.fill_voids(df, raster, "kriging", te.FillOptions(radius=6.0, maximum_support=128), te.Variogram("spherical", 0.0, 1.0, 5.0))


def test_seeds_give_other_orders(spark):
    from pulseframe.operators.selection import MIX_DOMAIN, mix
    df = spark.range(5000)
    orders = {s: [r.id for r in df.orderBy(mix("id", seed=s), "id").collect()] for s in (0, 1)}
    place = {i: n for n, i in enumerate(orders[1])}
    shifts = {(place[i] - n) % 5000 for n, i in enumerate(orders[0])}
    assert len(shifts) > 2500
    values = [r[0] for r in df.select(mix("id", seed=1)).collect()]
    assert all(0 <= v < MIX_DOMAIN for v in values) and len({b - a for a, b in zip(values, values[1:])}) > 4900


def test_tiles_resume_and_refuse_other_configuration(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 4).cast("int").alias("tile_col"), F.lit(0).alias("tile_row"))
    path, seen = str(tmp_path / "job"), []

    def compute(rows):
        seen.append(rows.select("tile_col").distinct().count())
        return rows.withColumn("v", F.col("point_id") * 2)

    part = df.where("tile_col < 2").select("tile_col", "tile_row").distinct()
    assert stt.process_tiles(df, compute, path, {"a": 1}, only=part) == 2
    assert stt.process_tiles(df, compute, path, {"a": 1}) == 2 and seen == [2, 2]
    assert stt.process_tiles(df, compute, path, {"a": 1}) == 0
    assert spark.read.parquet(f"{path}/tiles").count() == 1000 and stt.verify_tiles(spark, path).count() == 0
    # Late rows make their tile pending again; it is computed from all its rows.
    late = df.unionByName(spark.range(1000, 1010).select(F.col("id").alias("point_id"), F.lit(1).alias("tile_col"), F.lit(0).alias("tile_row")))
    assert stt.process_tiles(late, compute, path, {"a": 1}) == 1
    assert spark.read.parquet(f"{path}/tiles").count() == 1010 and stt.verify_tiles(spark, path).count() == 0
    assert {r.tile_col: r.points for r in stt.read_ledger(spark, path).collect()} == {0: 250, 1: 260, 2: 250, 3: 250}
    with pytest.raises(ValueError):
        stt.process_tiles(df, compute, path, {"a": 2})


def test_ledger_of_tiles_feeds_the_remaining_time(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("point_id"), (F.col("id") % 2).cast("int").alias("tile_col"), F.lit(0).alias("tile_row"),
                                    (F.col("id") % 100).cast("double").alias("x"), (F.col("id") % 50).cast("double").alias("y"))
    stt.process_tiles(df, lambda d: d, str(tmp_path / "job"), {})
    row = stt.eta(stt.read_ledger(spark, str(tmp_path / "job")), 1e9).first()
    assert row.samples == 2 and row.seconds_per_work > 0 and row.remaining_low < row.remaining < row.remaining_high


def test_streams(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    (events / "a.json").write_text('{"command":"train","phase":"fit","progress":0.4,"timestamp":"2024-01-01T00:00:01Z"}\n'
                                   '{"command":"train","phase":"sample","progress":0.1,"timestamp":"2024-01-01T00:00:00Z"}\n'
                                   '{"command":"predict","phase":"done","progress":1.7,"timestamp":"2024-01-01T00:00:05Z"}\n')
    progress.start_progress(progress.read_events(spark, str(events)), "latest", str(tmp_path / "c1")).awaitTermination()
    assert {r.command: (r.phase, r.progress) for r in spark.table("latest").collect()} == {"train": ("fit", 0.4), "predict": ("done", 1.0)}
    store = lambda: progress.store_progress(progress.read_events(spark, str(events)), str(tmp_path / "kept"), str(tmp_path / "c3")).awaitTermination()
    store()
    (events / "b.json").write_text('{"command":"train","phase":"done","progress":1.0,"timestamp":"2024-01-01T00:00:09Z"}\n')
    store()
    kept = {r.command: (r.phase, r.progress, r.events) for r in progress.stored_progress(spark, str(tmp_path / "kept")).collect()}
    assert kept == {"train": ("done", 1.0, 3), "predict": ("done", 1.0, 1)}
    source = str(tmp_path / "in")
    df = spark.range(300).select(F.col("id").alias("point_id"), (F.col("id") % 3).cast("int").alias("tile_col"), F.lit(0).alias("tile_row"))
    df.repartition(1).write.parquet(source)
    job = lambda: stt.stream_tiles(spark, source, df.schema, lambda d: d, str(tmp_path / "out"), {"k": 1}, str(tmp_path / "c2")).awaitTermination()
    job()
    job()
    assert spark.read.parquet(str(tmp_path / "out/tiles")).count() == 300 and stt.read_ledger(spark, str(tmp_path / "out")).count() == 3
    # A second arrival for two of the tiles.
    df.where("tile_col < 2").withColumn("point_id", F.col("point_id") + 1000).repartition(1).write.mode("append").parquet(source)
    job()
    assert spark.read.parquet(str(tmp_path / "out/tiles")).count() == 500 and stt.verify_tiles(spark, str(tmp_path / "out")).count() == 0
    assert sorted(r.points for r in stt.read_ledger(spark, str(tmp_path / "out")).collect()) == [100, 200, 200]


def test_fixed_records_and_sinks(spark, tmp_path):
    np.array([[1, 2], [3, np.nan], [5, 6]], "<f8").tofile(tmp_path / "xy.f64")
    np.array([2, 6, 5], "<u1").tofile(tmp_path / "label.u1")
    df = src.read_fixed_records(spark, str(tmp_path), {"xy.f64": ("<f8", 2), "label.u1": ("<u1", 1)}, 3)
    assert sorted(map(tuple, df.collect())) == [(0, 1.0, 2.0, 2), (1, 3.0, None, 6), (2, 5.0, 6.0, 5)]
    with pytest.raises(ValueError):
        src.read_fixed_records(spark, str(tmp_path), {"label.u1": ("<u1", 1)}, 4)
    # A prime number of rows can't be divided into equal records; 1,200 can.
    for n in (1201, 1200):
        np.arange(2 * n, dtype="<i4").reshape(n, 2).tofile(tmp_path / f"n{n}.i4")
        many = src.read_fixed_records(spark, str(tmp_path), {f"n{n}.i4": ("<i4", 2)}, n)
        assert sorted(map(tuple, many.collect())) == [(i, 2 * i, 2 * i + 1) for i in range(n)]
    cloud = points(spark, [(float(i), 0.0, 0.0) for i in range(20)]).withColumns({"tile_col": (F.col("x") / 10).cast("int"), "tile_row": F.lit(0)})
    assert sinks.write_tiles(cloud, str(tmp_path / "tiles"), rows_per_file=4) == 20
    assert len(list((tmp_path / "tiles" / "tile_col=0" / "tile_row=0").glob("*.parquet"))) >= 1
    back = src.read_points(spark, str(tmp_path / "tiles"), ("tile_col",))
    assert back.count() == 20
    folders = sinks.write_report_tables({"confusion": me.confusion(spark.createDataFrame([(2, 2), (2, 5)], "true_class int, pred_class int"))}, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(folders[0]).count() == 2 and spark.read.json(folders[1]).count() == 2
    over = points(spark, [(0.0, 0.0, 0.0)]).withColumn("classification", F.lit(1))
    with pytest.raises(Exception):
        sinks.export_classified(over, spark.createDataFrame([(0, 40)], "point_id long, pred_class int"), limit=31).collect()
    with pytest.raises(ValueError):
        sinks.export_features(over, [over.select("point_id"), over.select("point_id")])


def test_fingerprint_sees_changes_only(spark):
    a = points(spark, [(0.0, 1.0, float("nan")), (2.0, -3.0, 4.0)])
    b = a.withColumn("x", F.when(F.col("x") == 0, F.lit(-0.0)).otherwise(F.col("x"))).orderBy(F.desc("point_id"))
    c = a.withColumn("y", F.col("y") + 1e-9)
    names = ["point_id", "x", "y", "z"]
    assert me.content_fingerprint(a, names).first() == me.content_fingerprint(b, names).first() != me.content_fingerprint(c, names).first()


def test_split_keeps_classes_and_respects_the_buffer(spark):
    rng = np.random.default_rng(777)
    xy = rng.random((5000, 2)) * 100
    df = spark.createDataFrame([(i, float(x), float(y), int((2, 4, 6, 7)[i % 4])) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double, classification int")
    split = ml.spatial_split(df, block_size=20.0, fraction=0.25, buffer=3.0, candidates=16)
    train, test = split.train.collect(), split.test.collect()
    assert {r.classification for r in train} == {2, 4, 6, 7} == {r.classification for r in test}
    low = xy.min(0)
    for b in split.test_blocks.collect():
        lo = low + np.array([b.block_col, b.block_row]) * 20.0
        for r in train:
            gap = np.maximum(np.maximum(lo - (r.x, r.y), (r.x, r.y) - (lo + 20.0)), 0)
            assert (gap ** 2).sum() > 9.0
    with pytest.raises(ValueError):
        ml.spatial_split(df.where("x < 1 AND y < 1"), block_size=50.0)


def test_training_and_clustering(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        c = (2, 5, 6)[i % 3]
        rows.append((i, float(rng.normal(c, 0.2)), float(rng.normal(-c, 0.2)) if i % 50 else None, c))
    df = spark.createDataFrame(rows, "point_id long, a double, b double, classification int")
    model = ml.train_classifier(df, ["a", "b"], impute=True, trees=5, depth=4)
    assert ml.evaluate(model, df).first().accuracy > 0.95
    strict = ml.train_classifier(df.where("b IS NOT NULL"), ["a", "b"], trees=5, depth=4)
    out = {r.point_id: r for r in ml.predict(strict, df).collect()}
    assert len(out) == 600 and out[0].pred_class == -1 and out[0].confidence is None and out[1].confidence > 0.5
    with pytest.raises(ValueError):
        ml.predict(strict, df, ["b", "a"])
    clusters = ml.cluster(df.withColumn("g", F.col("classification") == 2), ["a", "b"], 2, ground="g")
    by = {(r.classification, r.cluster_id) for r in clusters.groupBy("classification", "cluster_id").count().where("count > 20").collect()}
    assert (2, 0) in by and len({k for c, k in by if c != 2}) == 2 and clusters.columns == df.columns + ["g", "cluster_id", "cluster_confidence"]
