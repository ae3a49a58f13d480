"""Disjoint sets in blocks and running extremes in tiles, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import grid as gr, structures as st


def flooded(cells):
    todo, seen, out = set(cells), {}, []
    while todo:
        start = todo.pop()
        group, front = {start}, [start]
        while front:
            k, x, y, z = front.pop()
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    for h in (-1, 0, 1):
                        n = (k, x + i, y + j, z + h)
                        if n in todo:
                            todo.discard(n)
                            group.add(n)
                            front.append(n)
        out.append(frozenset(group))
    return set(out)


@pytest.mark.parametrize("block", [2, 5, 32])
def test_components_equal_a_flood(spark, block):
    rng = np.random.default_rng(block)
    cells = {(int(k), *map(int, p)) for k in (0, 1) for p in rng.integers(-12, 12, (900, 3))}
    cells |= {(0, i, 50, i % 2) for i in range(-60, 60)} | {(1, 200 + i, -i, 3) for i in range(70)}  # long chains over many blocks
    df = spark.createDataFrame(sorted(cells), "k int, vx long, vy long, vz long")
    groups = {}
    for r in st.components(df.unionByName(df.limit(50)), "k", block=block).collect():
        groups.setdefault(r.component, set()).add((r.k, r.vx, r.vy, r.vz))
    assert {frozenset(g) for g in groups.values()} == flooded(cells)
    single = st.components(df.where("k = 0").drop("k"), block=block)
    assert single.columns == ["vx", "vy", "vz", "component"] and single.count() == sum(c[0] == 0 for c in cells)


def test_no_contraction_inside_one_block(spark):
    df = spark.createDataFrame([(x, y, 0) for x in range(30) for y in range(30)], "vx long, vy long, vz long")
    found = st.components(df)
    assert found.select("component").distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert st.components(df.limit(0)).count() == 0


def test_disjoint_sets():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    root = list(range(500))
    changed = True
    while changed:
        changed = False
        for x, y in zip(a, b):
            low = min(root[x], root[y])
            changed |= root[x] != low or root[y] != low
            root[x] = root[y] = low
    assert st.joined_sets(500, a, b).tolist() == root


def squares(image, radius, best):
    out = np.full(image.shape, np.nan)
    for i, j in np.ndindex(image.shape):
        part = image[max(0, i - radius):i + radius + 1, max(0, j - radius):j + radius + 1]
        if np.isfinite(part).any():
            out[i, j] = best(part[np.isfinite(part)])
    return out


@pytest.mark.parametrize("radius, tile, wide", [(0, 512, 512), (1, 4, 512), (3, 8, 512), (40, 16, 512), (3, 8, 0), (7, 4, 0)])
def test_running_extremes(spark, monkeypatch, radius, tile, wide):
    monkeypatch.setattr(gr, "TILE", tile)
    monkeypatch.setattr(gr, "WIDE", wide)
    monkeypatch.setattr(gr, "STRIP_ROWS", 5)
    rng = np.random.default_rng(radius)
    image = rng.integers(-50, 50, (23, 31)).astype(float)
    image[rng.random(image.shape) < 0.4] = np.nan
    image[:8, :9] = np.nan
    rows = [(j, i, None if np.isnan(v) else float(v), f"{i}.{j}") for (i, j), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "col int, row int, v double, name string")
    low = squares(image, radius, np.min)
    for made, want in ((gr.sliding_min(df, "v", radius, "o"), low), (gr.sliding_max(df, "v", radius, "o"), squares(image, radius, np.max)),
                       (gr.opening(df, "v", radius, "o"), squares(low, radius, np.max))):
        assert made.columns == ["col", "row", "v", "name", "o"]
        got = np.full(image.shape, np.inf)
        for r in made.collect():
            got[r.row, r.col] = np.nan if r.o is None else r.o
            assert r.name == f"{r.row}.{r.col}"
        np.testing.assert_array_equal(got, want)


def test_the_radius_costs_nothing():
    values = np.random.default_rng(0).random((4, 4096))
    for radius in (1, 100, 2000):
        np.testing.assert_array_equal(gr.running(values, radius, np.minimum, np.inf, 1)[:, 2100], values[:, max(0, 2100 - radius):2100 + radius + 1].min(axis=1))


def test_one_shuffle_for_an_opening(spark):
    df = spark.range(100).select((F.col("id") % 10).cast("int").alias("col"), F.expr("int(id div 10)").alias("row"), F.col("id").cast("double").alias("v"))
    plan = gr.opening(df, "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
