"""Copies of blocks are never broadcast, however small Spark takes them to be."""

import numpy as np

from pulseframe.llm import hard_negatives as hn, vector_search as vs


def joins_of(df):
    return [line.strip() for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]


def test_tiles_of_the_search_are_merged(spark):
    v = np.random.default_rng(1).integers(-9, 9, (400, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    found = vs.top_k(vectors.where("id % 20 = 0"), vectors, 3, block_rows=64)
    assert any("strategy=merge" in line for line in joins_of(found))
    for r in found.where("rank = 1").collect():
        scores = v @ v[r.query_id]
        scores[r.query_id] = -10_000
        assert (r.vec_id, r.score) == (int(scores.argmax()), int(scores.max()))


def test_tiles_of_hard_negatives_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, label = rng.integers(-9, 9, (300, 8)), rng.integers(0, 3, 300)
    rows = spark.createDataFrame([(i, int(c), [float(x) for x in r]) for i, (c, r) in enumerate(zip(label, v))], "id long, label long, v array<double>")
    seen, plain = [], hn.searched
    monkeypatch.setattr(hn, "searched", lambda tiles, look, *a: seen.append((look, joins_of(tiles))) or plain(tiles, look, *a))
    hn.mine(rows, rows.where("id % 30 = 0"), block_rows=64, anchor_rows=8).count()
    negatives = [joins for look, joins in seen if look is hn.look_for_negatives]
    assert len(negatives) == 2 and all(any("lane" in j and "strategy=merge" in j for j in joins) for joins in negatives)
