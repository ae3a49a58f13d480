"""Top-k search and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from pulseframe.llm import simhash, vector_search
from pulseframe.llm.common import connected_groups


def best(rows, k, step):
    out = []
    for q, a in rows:
        if q % step == 0:
            found = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in rows if v != q))[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(found)]
    return sorted(set(out))


@pytest.mark.parametrize("block_rows, fan", [(4096, 32), (16, 2)])
def test_tiles_find_the_best(spark, block_rows, fan):
    rng = random.Random(1)
    table = [(i, [rng.choice([-0.51, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(150)]  # many ties
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in table + bad], "vec_id long, embedding array<float>, id int, block string, score int")
    vectors = vector_search.integer_vectors(df, 256)
    found = vector_search.top_k(vectors.where("id % 5 = 0"), vectors, 5, block_rows=block_rows, fan=fan)
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in table]
    assert sorted(map(tuple, found.collect())) == best(whole, 5, 5)


def test_fewer_candidates_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    v = vector_search.integer_vectors(df, 256)
    assert vector_search.top_k(v.where("id = 0"), v, 5).collect()[0][:] == (0, 1, 1, 512 * 256)
    assert vector_search.top_k(v.limit(0), v, 5).count() == 0
    assert vector_search.top_k(v.limit(0), v.limit(0), 5).count() == 0


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, distance=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_groups_of_messy_rows(spark, messy):
    got = {(r.doc_id, r.fp % 2 ** 64, r.component) for r in simhash.near_groups(messy).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in messy.collect() if r.doc_id is not None}
    names = groups_of(prints)
    assert got == {(i, prints[i], names[i]) for i in prints}
    assert simhash.near_groups(messy.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [1024, 8])
def test_links_join_what_three_bits_join(spark, bucket_rows):
    """With buckets of 8 every deeper level is reached: many prints share a segment."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(200)}
    for c in centres:
        for _ in range(60):
            p = c
            for b in rng.sample(range(32 if rng.random() < 0.5 else 64), rng.randint(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    entries = spark.createDataFrame([(p - 2 ** 64 if p >= 2 ** 63 else p, "x") for p in prints], "fp long, path string")
    links = simhash.link(entries, bucket_rows=bucket_rows).collect()
    assert all((r.a ^ r.b) & (2 ** 64 - 1) and bin((r.a ^ r.b) & (2 ** 64 - 1)).count("1") <= 3 for r in links)
    expected = groups_of(dict(enumerate(prints)))
    place = {(p - 2 ** 64 if p >= 2 ** 63 else p): i for i, p in enumerate(prints)}
    root = {i: i for i in range(len(prints))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        a, b = sorted((find(place[r.a]), find(place[r.b])))
        root[b] = a
    assert {i: find(i) for i in root} == expected


def test_connected_groups_of_a_chain_and_a_star(spark):
    nodes = spark.range(0, 60).withColumnRenamed("id", "node")
    edges = [(i, i + 1) for i in range(0, 19)] + [(59, i) for i in range(30, 59)] + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in connected_groups(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i < 20 else 30 if i >= 30 else i for i in range(60)}
    empty = connected_groups(nodes, spark.createDataFrame([], "a long, b long"))
    assert empty.where("node <> root").count() == 0 and empty.count() == 60


def test_one_id_with_several_vectors(spark):
    """Each row of a repeated query id has a list of its own; equal rows have one."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 3.0]), (3, [1.0, 3.0])]
    v = vector_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1)
    found = sorted(map(tuple, vector_search.top_k(v.where("id = 0"), v, 2, block_rows=2, fan=2).collect()))
    assert found == [(0, 1, 2, 2), (0, 1, 3, 3), (0, 2, 3, 1), (0, 2, 3, 3)]
