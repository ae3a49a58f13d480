"""What joins write: copies of rows, partitions, repeated searches."""

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import neighbours as nb
from tests.test_neighbourhoods import brute_pairs, cloud


def test_a_low_limit_everywhere_makes_blocks_small(spark):
    """Every block of 16 cells is over the limit: smaller blocks, not single cells, and no task for each of them."""
    xyz = np.random.default_rng(5).random((2000, 3)) * [8, 8, 0.3]
    df = cloud(spark, xyz)
    plan = nb.plan_neighbourhood(df, 0.6, max_block_rows=90)
    assert plan.block_cells == nb.SMALL_BLOCK and plan.hot_cells is None and plan.partitions is None
    copies = nb._place_support(nb.as_support(df).withColumns({f"scell_{a}": nb.cell_index(f"s_{a}", plan.side) for a in "xy"}), plan).count()
    assert copies < 4.5 * len(xyz)
    got = {(r.q_id, r.s_id) for r in nb.radius_join(df, df, 0.6, plan=plan).select("q_id", "s_id").collect()}
    assert got == set(zip(*map(list, np.nonzero(brute_pairs(xyz, 0.6)[1]))))


def test_a_dense_place_alone_is_still_divided(spark):
    rng = np.random.default_rng(6)
    xyz = np.vstack([rng.random((1500, 3)) * [40, 40, 0.3], rng.random((200, 3)) * [0.9, 0.9, 0.3] + [20, 20, 0]])
    df = cloud(spark, xyz)
    plan = nb.plan_neighbourhood(df, 0.6, max_block_rows=100)
    assert plan.hot_cells is not None and plan.hot_cells.agg(F.max("splits")).first()[0] > 1
    got = {(r.q_id, r.s_id) for r in nb.radius_join(df, df, 0.6, plan=plan).select("q_id", "s_id").collect()}
    assert got == set(zip(*map(list, np.nonzero(brute_pairs(xyz, 0.6)[1]))))


def test_the_first_search_says_which_queries_are_done(spark, monkeypatch):
    """It is written as Parquet and needs no join with itself."""
    rng = np.random.default_rng(7)
    xyz = np.vstack([rng.random((400, 3)) * [10, 10, 0.2], rng.random((20, 3)) * [10, 10, 0.2] + [60, 60, 0]])
    df = cloud(spark, xyz)
    seen, plain = [], nb.stored
    monkeypatch.setattr(nb, "stored", lambda rows: seen.append(rows.columns) or plain(rows))
    found = nb.knn_join(df, df, 4)
    assert seen == [["q_id", "s_id", "d2", "rank", "done"]] and found.columns == ["q_id", "s_id", "d2", "rank"]
    d2 = brute_pairs(xyz, 1)[0]
    want = {(q, int(s), r + 1) for q in range(len(xyz)) for r, s in enumerate(np.lexsort((np.arange(len(xyz)), d2[q]))[:4])}
    assert {(r.q_id, r.s_id, r["rank"]) for r in found.collect()} == want


def test_tiles_are_read_back_once(spark, monkeypatch):
    """Every folder is listed and opened once: the check of the rows and the counts of the query are one reading."""
    from pyspark.sql.readwriter import DataFrameReader

    from pulseframe.plans.catalog import QUERIES
    reads, plain = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: reads.append(paths[0]) or plain(self, *paths, **options))
    found = QUERIES["tile_write_counts"](spark, "/root/testdata/sf0.001")
    assert found.agg(F.sum("n")).first()[0] == 6000 and found.columns == ["tile_col", "tile_row", "n"]
    assert sum("written-" in path for path in reads) == 1
