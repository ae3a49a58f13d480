"""Nearest neighbours found unit by unit."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import nearest as ne, neighbours as nb
from pulseframe.plans.catalog import ORACLES, QUERIES
from tests.test_nearest import frame, plain


def thin_orders(spark, path):
    """Orders so far apart that few returns have four others within three metres."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").where("o_orderkey % 400 < 4")
    orders.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_the_query_ends_where_its_sql_ends(spark, tmp_path):
    folder = thin_orders(spark, tmp_path)
    found = {tuple(r) for r in QUERIES["knn_join"](spark, folder).collect()}
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    want = set(engine.execute(ORACLES["knn_join"]).fetchall())
    assert found == want and 100 < len(want) < 4 * 590


@pytest.mark.parametrize("final, positive", [(False, False), (True, False), (True, True)])
def test_a_unit_finds_what_all_distances_find(final, positive):
    rng = np.random.default_rng(11)
    xyz = np.vstack([rng.random((300, 3)) * 1e-3, rng.random((400, 3)) * [30, 30, 5], np.tile([[3.0, 3.0, 3.0]], (40, 1)), [[7.0, 7.0, 1e15]]])
    ids = np.arange(len(xyz))
    row, found, d2, rank, done = ne.nearest(xyz, ids, xyz, ids, 4, 2.5, positive_only=positive, final=final)
    for q in range(0, len(xyz), 7):
        want = [(i, d) for i, d in plain(xyz, q, 4, positive) if d <= 6.25]
        mine = row == q
        assert done[q] == (final or len(want) == 4)
        assert list(zip(found[mine], d2[mine])) == (want if done[q] else []) and rank[mine].tolist() == list(range(1, mine.sum() + 1))


def test_a_table_searched_in_itself_is_dealt_once(spark):
    xyz = np.random.default_rng(12).random((3000, 3)) * [40, 40, 0.3]
    df = frame(spark, xyz)
    plan = nb.plan_neighbourhood(df, 1.0, 2, None, nb.NEAREST_ROWS, nb.NEAREST_PAIRS, True)
    rows = nb._searched(df, df, plan, 4)
    assert str(rows._jdf.queryExecution().optimizedPlan()).count("Repartition") == 1
    assert rows.where("NOT done").select("q_id").distinct().count() + rows.where("rank = 4").count() == 3000


def test_no_neighbour_is_written(spark, monkeypatch):
    """The outliers of a cloud and its spacing need a row per query, not one per neighbour or place."""
    from pulseframe.operators import profile as pr, terrain as te
    rng = np.random.default_rng(13)
    xyz = np.vstack([rng.random((1500, 3)) * [20, 20, 0.3], np.tile([[5.0, 5.0, 0.1]], (3, 1)), [[60.0, 60.0, 0.0]]])
    df, seen, plain_stored = frame(spark, xyz), [], nb.stored
    monkeypatch.setattr(nb, "stored", lambda rows: seen.append(rows.columns) or plain_stored(rows))
    flagged = {r.point_id: r for r in te.outliers_sor(df, 6, 1.0).collect()}
    assert len(flagged) == len(xyz)
    means = {q: np.mean(np.sqrt([d for _, d in plain(xyz, q, 6)])) for q in [*range(0, 1500, 71), 1500, 1503]}
    assert all(flagged[q].mean_distance == pytest.approx(m) for q, m in means.items())
    assert flagged[1503].is_outlier and not flagged[1500].is_outlier
    one = pr.spacing(df, 1.5).first()
    queries = pr.spacing_queries(df, 1.5).collect()
    nearest = [np.sqrt(plain(xyz, r.point_id, 1, True)[0][1]) for r in queries]
    assert one.sampled == len(queries) and one.unresolved_samples == 0 and one["mean"] == pytest.approx(np.mean(nearest)) and one.maximum == pytest.approx(max(nearest))
    assert one.duplicate_samples == sum(r.point_id in (1500, 1501, 1502) for r in queries)
    assert seen == [["q_id", "mean_distance", "coincident", "done"]] * 2
