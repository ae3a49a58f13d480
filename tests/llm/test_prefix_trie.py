"""The prefix trie against dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from pulseframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, block int, t1 string, e1 long, words string, depth int, pos int"


def by_hand(rows, shared=True):
    """Nodes of plain ``(conv_id, turn, role, text)`` rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        paths[c] = tuple(turns.get(c - c % 20, [])[:h] + mine[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len([w for w in re.split("[\x20\x09-\x0d]+", path[-1][1]) if w]) if path else 0
        leaves[path] = sum(leaves[k] for k in children.get(path, [])) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in children.get(path, []))
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if paths[c] == p)))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3, "y", 1, 2) for r in rows], SCHEMA)


def found(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def key(row):
    return row[:2]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\n c", "", None, " x y"])) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", f"same {t % 3}") for c in (100, 101, 102) for t in range(150 + c)]  # longer than sixteen blocks
    rows += [(103, t, "user", f"same {t % 3}" if t < 130 else f"other {t}") for t in range(140)]
    rows += [(c, t, "system", "hello") for c in range(200, 300) for t in range(8)]  # one node with a hundred ends
    rows += [(400, None, "user", "first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, 0, "user", "a"), (None, 0, "user", "x"), (401, 5, None, None)]
    rng.shuffle(rows)
    return rows


def test_shared_openings_equal_brute_force(spark, rows):
    turns = prefix_trie.numbered_turns(table(spark, rows), prefix_trie.shared_path(spark, "test"))
    assert found(prefix_trie.trie(*prefix_trie.with_shared_openings(turns))) == sorted(by_hand(rows), key=key)


def test_as_they_stand_and_small_segments(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    assert found(prefix_trie.conversation_trie(table(spark, rows))) == sorted(by_hand(rows, shared=False), key=key)


def test_empty_table_and_root_only(spark):
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0
    short = next(c for c in range(1, 500) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    turns = prefix_trie.numbered_turns(table(spark, [(short, 0, "user", "x")]), prefix_trie.shared_path(spark, "test"))
    assert found(prefix_trie.trie(*prefix_trie.with_shared_openings(turns))) == by_hand([(short, 0, "user", "x")]) != []
    assert by_hand([(short, 0, "user", "x")])[0][1] == 0


def test_members_in_many_pieces(spark):
    ends = spark.range(1000).selectExpr("id % 3 AS k1", "0L AS k2", "id AS conv")
    want = {(k, 0): hashlib.sha256(",".join(map(str, range(k, 1000, 3))).encode()).hexdigest() for k in range(3)}
    assert {r[:2]: r[2] for r in map(tuple, prefix_trie.member_digests(ends, chunk=10).collect())} == want
