"""Steps of the near-copy stage: links of fingerprints, and sketches that tell texts apart."""

import random

import numpy as np

from pulseframe.llm import near_copies as nc


def test_fingerprints_alone_link_the_closest_copies(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(900)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prefixes = nc.prefixes
    monkeypatch.setattr(nc, "prefixes", lambda *a: prefixes(*a).limit(0))
    assert {r.doc_id: r.component for r in nc.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 2}


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(9)
    for n in (1, 5, 60, 3000):
        a = rng.integers(-2 ** 63, 2 ** 63 - 1, n)
        b = np.concatenate([a[: n - n // 8], rng.integers(-2 ** 63, 2 ** 63 - 1, n // 8)])
        apart = np.bitwise_count(nc.sketch_of(a) ^ nc.sketch_of(b)).sum()
        assert apart <= 2 * (n // 8)


def test_a_large_group_gives_few_pairs():
    """400 texts of 146 shingles that share half: no pair is close, and none is left to look at; two copies among them are."""
    rng = np.random.default_rng(10)
    common = rng.integers(-2 ** 63, 2 ** 63 - 1, 73)
    sets = [np.concatenate([common, rng.integers(-2 ** 63, 2 ** 63 - 1, 73)]) for _ in range(400)]
    sets.append(np.concatenate([sets[0][:-3], rng.integers(-2 ** 63, 2 ** 63 - 1, 3)]))
    m = len(sets)
    words = np.array([nc.sketch_of(h) for h in sets]).view(np.uint64)
    for closest in (True, False):
        a, b = nc.crossing(np.full(m, 146), np.zeros(m, int), np.arange(m), np.zeros(m, int), np.arange(m), np.zeros(m, int), np.ones(m, bool), words, closest)
        assert (0, m - 1) in set(zip(a.tolist(), b.tolist())) and len(a) < 5
