"""Near-copies of the pipeline's stage against brute-force Jaccard similarity."""

import random

import corpus_pipeline
from pulseframe.llm import near_copies


def brute_force(texts):
    """Smallest id of each group, by all pairs of five-word shingle sets."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")


def test_groups_are_those_of_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    texts = []
    for size in (3, 5, 9, 30, 100, 400):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 2, 4):
                copy = list(base)
                for _ in range(edits * size // 100 + (edits > 0)):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(copy + (passage if rng.random() < 0.3 else [])))
    texts += [None, "", " ", "One", "one", *[" ".join(passage)] * 3]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    expected = brute_force(texts)
    docs = table(spark, texts)
    assert {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()} == expected
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(expected.values())
    assert len(set(expected.values())) < len(set(texts.values())) - 20  # near copies, not exact ones only
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_frequent_shingles_change_the_order_only(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(copy)
    assert {r.doc_id: r.component for r in near_copies.near_copies(table(spark, texts)).collect()} == brute_force(texts)
