"""Hard negatives against all products."""

import random

import numpy as np
import pytest

from pulseframe.llm import hard_negatives as hn


def by_hand(rows, step, n_positives=5, n_negatives=3):
    out = []
    for a, label, v in sorted(set(rows)):
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a]
        positives = sorted(s[:2] for s in scored if s[2] == label)[:n_positives]
        for minus, p in positives:
            fits = sorted(s[:2] for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus)[:n_negatives]
            out += [(a, p, r + 1, i, int(-minus), int(-s)) for r, (s, i) in enumerate(fits)]
    return sorted(out)


def table(rng, n, dim, labels):
    def vector():
        kind = rng.random()
        if kind < 0.1:
            return tuple([0.0] * dim)
        if kind < 0.3:
            return tuple([3.0] * dim)  # copies
        return tuple(float(rng.randint(-9, 30) * rng.choice([1, 1, 5])) for _ in range(dim))
    return [(i, 0 if rng.random() < 0.4 else rng.randrange(labels), vector()) for i in range(n)]


@pytest.mark.parametrize("block_rows, anchor_rows, focus", [(4096, 1024, 3), (16, 4, 2), (7, 3, 1)])
def test_equal_brute_force(spark, block_rows, anchor_rows, focus):
    rows = table(random.Random(4), 240, 6, 4)
    rows += rows[:3] + [(12, 1, (1.0,) * 6), (12, 1, (9.0,) * 6), (300, 9, (5.0,) * 6)]  # repeated rows, one id with several vectors, a label of one row
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    found = hn.mine(df, df.where("id % 12 = 0"), block_rows=block_rows, anchor_rows=anchor_rows, focus=focus)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, 12)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [0.5, 0.25], 1), (7, [0.5, 0.25], 1), (1, [0.5, 0.2], 1), (2, [0.3, 0.1], 2), (None, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, 1.0], None), (6, [], 1),
             (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, [None, 1.0], 2)]
    df = spark.createDataFrame([(*r, 5, 1.0, "x", 2) for r in table], "vec_id long, embedding array<double>, label int, id int, length double, tile string, block int")
    rows = hn.relabelled(hn.labelled_vectors(df, 256), 7, 10)
    assert {(r.id, r.label) for r in rows.collect()} == {(0, 2), (7, 2), (1, 1), (2, 2)}
    plain = [(r.id, r.label, tuple(r.v)) for r in rows.collect()]
    assert sorted(map(tuple, hn.mine(rows, rows).collect())) == by_hand(plain, 1)
    assert hn.mine(rows.limit(0), rows.limit(0)).count() == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [1.0, 1.0])], "id long, label long, v array<double>")
    with pytest.raises(Exception, match="different lengths"):
        hn.mine(df, df).collect()


def test_pruning_keeps_all_and_leaves_out_most():
    import pyarrow as pa
    rng = np.random.default_rng(1)
    m = rng.normal(size=(4000, 8))
    m = np.floor(256 * m / np.sqrt((m * m).sum(axis=1))[:, None])  # one bucket: about one length
    bucket = hn.Bucket(pa.StructArray.from_arrays([pa.array(np.arange(4000)), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "v"]))
    kept = 0
    for a in m[:50]:
        scores = m @ a
        least = float(np.sort(scores)[-20])
        found = bucket.candidates(a, least)
        assert set(np.flatnonzero(scores >= least)) <= set(found)
        kept += len(found)
    assert kept < 0.6 * 50 * 4000
