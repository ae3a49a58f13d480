"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation becomes one row per block of eight turns: the key of the node where the block
begins and eight turn ids, null past its end.  One ``GROUP BY start, ROLLUP(t1..t8)`` then aggregates
all prefixes of all blocks together; ``grouping_id`` tells the depth within the block.  A node's key is
the exclusive-or of two 64-bit hashes of (position, turn id) over its path, so a block's start is known
without looking at the blocks before it, and conversations of any length are aggregated at once.

A second ROLLUP over the nodes sums subtrees within blocks.  Sums of the blocks below come
from pointer doubling over the tree of blocks, in rounds that grow with the logarithm of the longest
conversation.  No conversation, node or group of members is gathered: positions come from range
partitions, a digest of members is made from sorted runs that pass through a task as a stream.

Turns are ordered by turn (null first), then role and text; null roles and texts are empty; rows with a
null conversation id are left out.  Repeated rows are turns of their own.  Conversations
without turns belong to the root.  No conversation gives no row, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseframe.llm.common import prepare, shared_path, stored

BLOCK = 8
SEGMENT = 512  # blocks whose keys are added up in one window
CHUNK = 1 << 20  # bytes of a run of members
TURNS = [f"t{i}" for i in range(1, BLOCK + 1)]
WORDS = [f"w{i}" for i in range(1, BLOCK + 1)]
START = ["e1", "e2", "block"]
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, path: str) -> DataFrame:
    """``conv, pos, turn_id, words``: turns numbered from 1 within their conversation.

    Rows are range partitioned, so one conversation may spread over many tasks; only ids and
    counts are kept.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = (conversations.where("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").isNotNull().alias("late"), "turn", role.alias("role"), text.alias("text")))
    order = ["conv", "late", "turn", "role", "text"]
    ids = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
           .select("conv", F.monotonically_increasing_id().alias("at"),
                   F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("turn_id"),
                   F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")))
    ids = stored(ids, "turn-ids", path)
    part = F.shiftright("at", 33)
    # One row per task that holds rows of a conversation.
    runs = ids.groupBy("conv", part.alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv", "part", "low", before.alias("before"))
    return (ids.withColumn("part", part).join(runs, ["conv", "part"])
            .select("conv", (F.col("before") + F.col("at") - F.col("low") + 1).alias("pos"), "turn_id", "words"))


def step_hashes(pos: Column, turn: Column) -> list[Column]:
    """What a turn adds to the two halves of a node's key; nothing where it is null."""
    return [F.when(turn.isNotNull(), h).otherwise(F.lit(0).cast("long")) for h in (F.xxhash64(pos, turn), F.xxhash64(turn, F.lit("2"), pos))]


def path_key(half: int, size: int = BLOCK, without: Column | None = None) -> Column:
    """One half of the key at the end of the row's turn columns; ``without`` leaves out one place."""
    key = F.col(f"e{half + 1}")
    for i in range(1, size + 1):
        step = step_hashes(F.col("block") * BLOCK + i, F.col(f"t{i}"))[half]
        key = key.bitwiseXOR(step if without is None else F.when(without == i, F.lit(0).cast("long")).otherwise(step))
    return key


def turn_blocks(turns: DataFrame, conversations: DataFrame, path: str) -> DataFrame:
    """``conv, block, e1, e2, t1..t8, w1..w8, last``: each conversation's blocks and the keys they begin at.

    ``turns(conv, pos, turn_id, words)``, ``conversations(conv, n_turns)``; one without turns has one empty block.
    """
    at = lambda c, i: F.try_element_at(F.filter("turns", lambda x: x["i"] == i), F.lit(1))[c].alias(f"{c[0]}{i}")
    place = F.struct(((F.col("pos") - 1) % BLOCK + 1).alias("i"), "turn_id", "words")
    blocks = (turns.groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("block")).agg(F.collect_list(place).alias("turns"))
              .select("conv", "block", *[at(c, i) for c in ("turn_id", "words") for i in range(1, BLOCK + 1)]))
    none = conversations.where("n_turns = 0").select("conv", F.lit(0).cast("long").alias("block"))
    blocks = stored(blocks.unionByName(none, allowMissingColumns=True), "turn-blocks", path)
    zero = F.lit(0).cast("long")
    own = blocks.withColumns({"e1": zero, "e2": zero})
    steps = own.select("conv", "block", F.floor(F.col("block") / SEGMENT).alias("segment"), *[path_key(h).alias(f"x{h + 1}") for h in (0, 1)])
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), zero)
    inside = steps.select("conv", "block", "segment", *[xor(f"x{h}", earlier("conv", "segment").orderBy("block")).alias(f"i{h}") for h in (1, 2)],
                          F.max("block").over(Window.partitionBy("conv", "segment")).alias("end"))
    sums = steps.groupBy("conv", "segment").agg(*[F.bit_xor(f"x{h}").alias(f"x{h}") for h in (1, 2)])
    outside = sums.select("conv", "segment", *[xor(f"x{h}", earlier("conv").orderBy("segment")).alias(f"o{h}") for h in (1, 2)],
                          F.lead("segment").over(Window.partitionBy("conv").orderBy("segment")).isNull().alias("final"))
    starts = inside.join(outside, ["conv", "segment"]).select(
        "conv", "block", *[F.col(f"i{h}").bitwiseXOR(F.col(f"o{h}")).alias(f"e{h}") for h in (1, 2)],
        (F.col("final") & (F.col("block") == F.col("end"))).alias("last"))
    return blocks.join(starts, ["conv", "block"])


def rolled_up(rows: DataFrame, **sums: str) -> DataFrame:
    """Aggregates of every prefix of the rows' turn columns: ``e1, e2, block, t1..t8, d`` and ``sums``."""
    aggregates = ", ".join(f"{a} AS {k}" for k, a in sums.items())
    out = rows.sparkSession.sql(f"SELECT {', '.join(START + TURNS)}, grouping_id() AS g, {aggregates} FROM {{rows}} "
                                f"GROUP BY {', '.join(START)}, ROLLUP({', '.join(TURNS)})", rows=rows)
    d = F.lit(BLOCK) - F.bit_count("g")
    reached = F.coalesce(*[F.when(d == i, F.col(f"t{i}").isNotNull()) for i in range(1, BLOCK + 1)], F.lit(True))
    return out.withColumn("d", d).where(reached).drop("g")


def member_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``k1, k2, ends_sha256``: digest of each node's members in ascending order, joined by commas.

    Sorted runs of members become pieces of text where they lie, whichever node they belong to; then a node's
    pieces pass through its digest one after another.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        out: list[tuple] = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["k1", "k2", "first", "piece"])

        total = 0
        for batch in batches:
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (k1, k2) != key or size > chunk:
                    if held:
                        out.append((*key, first, ",".join(held).encode()))
                        total += size
                        if total > chunk or len(out) > 10_000:
                            yield made()
                            out, total = [], 0
                    key, first, held, size = (k1, k2), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            out.append((*key, first, ",".join(held).encode()))
        if out:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, piece in zip(*(x.to_pylist() for x in batch.columns)):
                if (k1, k2) == key:
                    digest.update(b",")
                else:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(piece)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), r)) for r in out])
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends_sha256"), (*key, digest.hexdigest())))])

    order = ["k1", "k2", "conv"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(pieces, "k1 long, k2 long, first long, piece binary")
    return (runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "piece")
            .mapInArrow(digests, "k1 long, k2 long, ends_sha256 string"))


def block_totals(own: DataFrame, starts: DataFrame, path: str, longest: int) -> DataFrame:
    """``k1, k2, below_leaves, below_saved``: for each node that blocks continue, the sums of all nodes further down.

    ``own(e1, e2, leaves, saved)`` are the blocks' own sums, ``starts(e1, e2, a1, a2)`` the block above each, null above the
    second blocks.  Each round doubles the distance that a pointer spans.
    """
    state = stored(own.join(starts, ["e1", "e2"]), "block-totals", f"{path}/totals-0")
    for i in range(1, max(1, longest).bit_length() + 1):
        moved = state.where("a1 IS NOT NULL").groupBy("a1", "a2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = state.select(F.col("e1").alias("a1"), F.col("e2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        state = (state.join(moved.withColumnsRenamed({"a1": "e1", "a2": "e2"}), ["e1", "e2"], "left").join(jump, ["a1", "a2"], "left")
                 .select("e1", "e2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                         (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        state = stored(state, "block-totals", f"{path}/totals-{i}")
    return state.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, words``.

    ``turns(conv, pos, turn_id, words)`` with positions from 1, ``conversations(conv, n_turns)``.
    """
    spark = turns.sparkSession
    prepare(spark)
    path = shared_path(spark, "prefix-trie")
    blocks = turn_blocks(turns, conversations, f"{path}/blocks")
    keyed = stored(blocks, "prefix-trie", f"{path}/keyed")
    ends = keyed.where("last").select("conv", *[path_key(h).alias(f"k{h + 1}") for h in (0, 1)])

    found = rolled_up(keyed, n_convs="count(*)", conv_id="min(conv)", **{w: f"max({w})" for w in WORDS})
    found = found.where("d > 0 OR block = 0")
    words = F.coalesce(*[F.when(F.col("d") == i, F.col(f"w{i}")) for i in range(1, BLOCK + 1)], F.lit(0))
    parent = [F.when(F.col("d") > 0, path_key(h, without=F.col("d"))).alias(f"p{h + 1}") for h in (0, 1)]
    nodes = stored(found.select(*START, *TURNS, "d", "n_convs", "conv_id", words.alias("words"), *[path_key(h).alias(f"k{h + 1}") for h in (0, 1)], *parent),
                   "prefix-trie", f"{path}/nodes")
    kids = nodes.where("d > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = (nodes.join(kids, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
             .withColumns({"leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words"),
                           "n_children": F.coalesce("n_children", F.lit(0))}))
    nodes = stored(nodes, "prefix-trie", f"{path}/valued")

    longest = nodes.agg(F.max("block")).first()[0] or 0
    if longest:
        own = nodes.where("block > 0").groupBy("e1", "e2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # The block above is the one whose last level holds the start.
        above = F.when(F.col("block") > 0, F.col("e1")), F.when(F.col("block") > 0, F.col("e2"))
        starts = nodes.where(f"d = {BLOCK}").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), above[0].alias("a1"), above[1].alias("a2"))
        below = block_totals(own, starts, path, longest)
        nodes = nodes.join(below, ["k1", "k2"], "left").withColumns({
            "leaves": F.col("leaves") + F.coalesce("below_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("below_saved", F.lit(0))})
    sums = rolled_up(nodes.withColumnRenamed("d", "level"), n_leaves="sum(leaves)", saved_tokens="sum(saved)",
                     # The top of a subtree is its row of the least level.
                     **{c: f"min_by({c}, level)" for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "words")})
    sums = sums.where("d > 0 OR block = 0").select(
        "conv_id", (F.col("block") * BLOCK + F.col("d")).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "words", *[path_key(h).alias(f"k{h + 1}") for h in (0, 1)])
    return (sums.join(member_digests(ends), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)))
            .drop("k1", "k2").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "words"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they stand."""
    turns = numbered_turns(conversations, shared_path(conversations.sparkSession, "turn-ids"))
    return trie(turns, turns.groupBy("conv").agg(F.count("*").alias("n_turns")))


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations, each conversation opening as the first of its twenty: its own first h turns give way to that one's.

    ``h`` is the unsigned crc32 of the decimal id, modulo 4.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = (turns.where("conv % 20 = 0 AND pos <= 3").groupBy(F.col("conv").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("head")))
    plan = (sizes.withColumns({"h": F.crc32(F.col("conv").cast("string")) % 4, "base": F.col("conv") - F.col("conv") % 20})
            .join(heads, "base", "left")
            .withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,turn_id:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
            .select("conv", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    plan = stored(plan, "openings")
    own = (turns.join(plan.select("conv", "h", F.size("head").alias("opening")), "conv").where("pos > h")
           .select("conv", (F.col("pos") - F.col("h") + F.col("opening")).alias("pos"), "turn_id", "words"))
    opening = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.pos", "t.turn_id", "t.words")
    return own.unionByName(opening), plan.select("conv", "n_turns")


ORACLE = r"""
WITH bits AS (SELECT DISTINCT conv_id AS c, flatten([[ord(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(x AS BIGINT) FOR x IN b]),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 4 AS h FROM bits),
t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT i.c, t.p, t.role, t.text FROM ids i JOIN t ON t.c = i.c - i.c % 20 AND t.p <= i.h
  UNION ALL SELECT i.c, t.p + 3, t.role, t.text FROM ids i JOIN t ON t.c = i.c AND t.p > i.h),
q AS (SELECT c, list(md5(length(role) || ':' || role || text) ORDER BY p) AS path,
  list(CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) ORDER BY p) AS w FROM r GROUP BY c),
f AS (SELECT i.c, coalesce(path, []) AS path, coalesce(w, []) AS w FROM ids i LEFT JOIN q ON q.c = i.c),
e AS (SELECT c, path, w, unnest(range(0, len(path) + 1)) AS d FROM f),
n AS (SELECT d, array_to_string(path[1:d], ',') AS k, array_to_string(path[1:greatest(d - 1, 0)], ',') AS pk, min(c) AS conv_id, count(*) AS n_convs,
  max(coalesce(w[d], 0)) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends_sha256 FROM e GROUP BY 1, 2, 3),
kids AS (SELECT pk, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.pk = n.k AND kids.d = n.d),
up AS (SELECT unnest(range(0, d + 1)) AS d, string_split(k, ',') AS path, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM v),
s AS (SELECT d, CASE WHEN d = 0 THEN '' ELSE array_to_string(path[1:d], ',') END AS k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256, CAST(v.words AS BIGINT) AS words
FROM v JOIN s ON s.d = v.d AND s.k = v.k LEFT JOIN n p ON p.d = v.d - 1 AND p.k = v.pk
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations with shared openings."""
    turns = numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_path(spark, "turn-ids"))
    return trie(*with_shared_openings(turns))
