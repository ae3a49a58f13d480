"""Passes over the rows of a fit, and what they compute again."""

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import fitting as ft, ranking
from tests.test_fitting import table


def test_starts_of_a_mixture_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(150, 2)) + 4])
    passes, plain = [], ft.summed
    monkeypatch.setattr(ft, "summed", lambda *a: passes.append(1) or plain(*a))
    model = ft.fit_mixture(table(spark, x), [x[[0, 200]], x[[3, 290]], x[[149, 150]]], iterations=6, tolerance=-np.inf)
    assert len(model.likelihoods) == 6 and len(passes) == 7


def test_a_round_of_boosting_does_not_start_from_the_first_tree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 2)) + y[:, None]
    fit = lambda: ft.fit_boosted(table(spark, x, y), 2, 2, rounds=7, depth=2, rate=0.3)
    with monkeypatch.context() as patch:
        patch.setattr(ft.Boosted, "probabilities", None)
        model = fit()
    monkeypatch.setattr(ft, "STORED_ROUNDS", 100)
    np.testing.assert_array_equal(model.raw(x), fit().raw(x))
    assert (np.diff(model.losses) < 0).all()


def test_few_large_groups_do_not_meet_in_as_few_tasks(spark):
    df = spark.range(0, 3000, 1, 4).select(F.col("id").alias("point_id"), (F.col("id") % 3).alias("c"), (F.col("id") * 37 % 1009).alias("m"))
    found = ranking.smallest_per_group(df, ["c"], "m", "point_id", 50, domain=1009, edge_rows=100)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    want = {c: sorted((i * 37 % 1009, i) for i in range(3000) if i % 3 == c)[:50] for c in range(3)}
    got = found.collect()
    assert {c: sorted((r.m, r.point_id) for r in got if r.c == c) for c in range(3)} == want
