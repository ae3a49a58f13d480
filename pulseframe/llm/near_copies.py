"""Near-copies by exact Jaccard similarity of word shingles, for the pipeline's stage.

Two texts are near-copies if the sets of their five-word shingles have a similarity of 4/5 or more;
groups are what such pairs connect.  All pairs are found: under one order of all shingles a text's
first n - ceil(4n/5) + 1 shingles must share one with those of any near-copy; of the smaller of two near-copies the first
n - ceil(8n/9) + 1 are enough.  Texts meet by those shingles only, the smaller by its shorter list, and are confirmed on their words.  Any order is exact; this one puts shingles that
a sample of texts shows to be frequent last, so that common passages seldom make texts meet.

The first links are those of op4's method (``simhash``): fingerprints, here of five-word shingles, that deletion variants bring together within three
bits, confirmed on the words.  Such fingerprints hold few of the pairs at 4/5, so shingles find the others.
Within the texts that meet by a shingle each is first compared with the smallest only.  Pairs
are compared only where groups so found differ, first each text with its closest, so a large group of copies isn't compared pair by pair.
Before texts meet, sketches of 512 parities tell most pairs apart that are not similar: they differ in no more bits than the texts in shingles.

Texts equal in their lower-cased words are one entry.  Texts with fewer words than a shingle are one
shingle; null and empty texts are copies of each other; rows with a null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.llm import simhash
from pulseframe.llm.common import connected_groups, prepare, remove, shared_path, stored, text_or_empty

SHINGLE = 5
TOP, BOTTOM = 4, 5  # similarity as a fraction of whole numbers
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 200_000
BITS = 1 << 26  # of the map of texts to be confirmed
NODE = ["d1", "d2"]
WORDS = 8  # of 64 bits in a text's sketch
CHUNK = 4096  # texts of a common shingle side by side in a tile
# A shingle of the shorter list: near-copies no smaller share at least ceil(8n/9) shingles with the text.
INDEXED = f"i <= n - (({2 * TOP} * n + {TOP + BOTTOM - 1}) div {TOP + BOTTOM})"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def node_of(words: list[bytes]) -> tuple[int, int]:
    """A text's words as two signed 64-bit integers."""
    d = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingles_of(words: list[bytes], shingle: int = SHINGLE) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(shingle)))) or {tuple(words)}


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return BOTTOM * both >= TOP * (len(a) + len(b) - both)


class Hasher:
    """Hashes of a text's different shingles, from hashes of its words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - shingle + 1) if len(h) else 0
        out = np.zeros(n, np.uint64)
        for i in range(min(shingle, len(h))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32))).view(np.int64)


def by_row(docs: DataFrame, text: str, make, schema: str, key: str | None = None) -> DataFrame:
    """Rows that ``make(key, text)`` gives as arrays of columns, in small batches."""
    prepare(docs.sparkSession)
    rows = docs.select(*([F.col(key).alias("k")] if key else []), text_or_empty(text).alias("t"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in batches:
            out, n = [], 0
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                new = made(*row)
                if new is not None:
                    out.append(new)
                    n += len(new[0])
                if n > 100_000:
                    yield joined(out)
                    out, n = [], 0
            if out:
                yield joined(out)

    def joined(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part], f.type)
                                           for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def seen_before():
    """Whether this task had a text already; the memory is bounded, what it forgets is only repeated."""
    had: set = set()

    def seen(node) -> bool:
        if node in had:
            return True
        if len(had) > 200_000:
            had.clear()
        had.add(node)
        return False

    return seen


def frequent_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles frequent in a sample of texts; they only set the order."""
    def make():
        hashed, seen = Hasher(), seen_before()

        def rows(t):
            words = words_of(t)
            node = node_of(words)
            if node[0] % SAMPLE or not words or seen(node):
                return None
            h = hashed(words)
            return h, np.full(len(h), node[1])
        return rows

    counts = by_row(docs, text, make, "s long, d long").groupBy("s").agg(F.count("*").alias("n")).where(f"n > {FREQUENT}")
    found = counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefixes(docs: DataFrame, text: str) -> DataFrame:
    """``s, d1, d2, n, i``: the first shingles of each text in the common order, its number of shingles, the place."""
    hashes, counts = frequent_shingles(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, counts))

    def make():
        hashed, seen, (often, times) = Hasher(), seen_before(), sent.value

        def rows(t):
            words = words_of(t)
            node = node_of(words)
            if not words or seen(node):
                return None
            h = hashed(words)
            n = len(h)
            if len(often):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                h = h[np.lexsort((h, np.where(often[at] == h, times[at], 0)))]
            first = h[:n + (-TOP * n // BOTTOM) + 1]
            m = len(first)
            return first, np.full(m, node[0]), np.full(m, node[1]), np.full(m, n, np.int32), np.arange(m, dtype=np.int32)
        return rows

    return by_row(docs, text, make, "s long, d1 long, d2 long, n int, i int")


def may_be_similar(a: str, b: str):
    """By sizes and places: what shingles may still be shared from here on."""
    n = {x: F.col(f"{x}.n").cast("long") for x in (a, b)}
    left = 1 + F.least(*[n[x] - 1 - F.col(f"{x}.i") for x in (a, b)])
    return (left * (TOP + BOTTOM) >= TOP * (n[a] + n[b]))


def confirmed(docs: DataFrame, text: str, pairs: DataFrame, path: str) -> DataFrame:
    """Those of ``pairs(a1, a2, b1, b2)`` that are near-copies, by their words."""
    place = lambda c: F.pmod(F.col(c), F.lit(BITS)).alias("p")
    bits = np.zeros(BITS // 8, np.uint8)
    needed = pairs.select(place("a1")).unionByName(pairs.select(place("b1"))).distinct()
    for batch in needed.groupBy(F.shiftright("p", 3).cast("int").alias("at")).agg(F.expr("CAST(sum(shiftleft(1, CAST(p & 7 AS INT))) AS INT) AS v")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        seen, there = seen_before(), sent.value

        def rows(t):
            words = words_of(t)
            node = node_of(words)
            p = node[0] % BITS
            if not there[p >> 3] >> (p & 7) & 1 or seen(node):
                return None
            return [node[0]], [node[1]], [b" ".join(words)]
        return rows

    texts = stored(by_row(docs, text, make, "d1 long, d2 long, t binary").groupBy("d1", "d2").agg(F.first("t").alias("t")), "near-copy-texts", path)
    side = lambda x: texts.select(F.col("d1").alias(f"{x}1"), F.col("d2").alias(f"{x}2"), F.col("t").alias(f"{x}t"))
    both = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).select("a1", "a2", "b1", "b2", "at", "bt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(4), batch.column(5)):
                a = a.as_py()
                if a != last:
                    last, held = a, shingles_of(a.split())
                keep.append(similar(held, shingles_of(b.as_py().split())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], names=["a1", "a2", "b1", "b2"])

    return both.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their low bits: two texts' sketches differ in no more bits than their shingles do."""
    bits = np.bincount(hashes & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def may_share(a: str, b: str):
    """By sketches: near-copies differ in a ninth of both texts' shingles at most."""
    apart = " + ".join(f"bit_count({a}w{j} ^ {b}w{j})" for j in range(WORDS))
    return F.expr(f"{TOP + BOTTOM} * ({apart}) <= CAST({a}n AS BIGINT) + {b}n")


def crossing(n, i, d1, d2, root, chunk, indexed, words, closest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across groups, among the texts that meet by a shingle, that may be similar; with ``closest`` one for each text at most."""
    order = np.lexsort((i, d2, d1, n))
    n, i, root, chunk, indexed, words = (v[order] for v in (n, i, root, chunk, indexed, words))
    tiled, least, most = len(np.unique(chunk)) > 1, [], []
    for start in range(0, len(n), 256):
        x = start + np.flatnonzero(indexed[start:start + 256])
        x = x[x + 1 < len(n)]
        if not len(x):
            continue
        ok = (x[:, None] < np.arange(len(n))) & (root[x, None] != root)
        if tiled:
            ok &= chunk[x, None] != chunk
        both = n[x, None] + n
        ok &= (1 + np.minimum((n - 1 - i)[x, None], n - 1 - i)) * (TOP + BOTTOM) >= TOP * both
        apart = sum(np.bitwise_count(words[x, j, None] ^ words[None, :, j]).astype(np.int64) for j in range(WORDS))
        ok &= apart * (TOP + BOTTOM) <= both
        if closest:
            at = np.where(ok, apart, 1 << 30).argmin(axis=1)
            row = np.flatnonzero(ok[np.arange(len(x)), at])
            at = at[row]
        else:
            row, at = np.nonzero(ok)
        least.append(x[row])
        most.append(at)
    pick = lambda v: order[np.concatenate(v)] if v else np.zeros(0, np.int64)
    return pick(least), pick(most)


def across(opened: DataFrame, closest: bool) -> DataFrame:
    """``a1, a2, b1, b2`` of texts that meet by a shingle and aren't one group yet: ``opened(s, m, d1, d2, n, i, indexed, root, w*)``.

    What meets by a very common shingle is dealt to tiles of chunk x chunk; a tile streams through a task and gives pairs only.
    """
    chunks = F.ceil(F.col("m") / F.lit(float(CHUNK))).cast("int")
    tiles = (opened.withColumn("c", F.pmod(F.xxhash64("d1", "d2"), chunks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .withColumns({"p": F.least("c", "o"), "q": F.greatest("c", "o")}))
    names = ["s", "p", "q", "c", "n", "i", "d1", "d2", "indexed", "root", *[f"w{j}" for j in range(WORDS)]]
    dealt = tiles.repartition("s", "p", "q").sortWithinPartitions("s", "p", "q").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def closed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            c = {x: t.column(x).to_numpy().astype(np.int64) for x in ("c", "n", "i", "d1", "d2", *names[10:])}
            root = np.asarray(t.column("root").combine_chunks().dictionary_encode().indices)
            words = np.column_stack([c[f"w{j}"] for j in range(WORDS)]).view(np.uint64)
            a, b = crossing(c["n"], c["i"], c["d1"], c["d2"], root, c["c"], t.column("indexed").to_numpy().astype(bool), words, closest)
            return pa.RecordBatch.from_arrays([pa.array(c[d][at]) for at in (a, b) for d in NODE], names=["a1", "a2", "b1", "b2"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(j).to_numpy() for j in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for x, y in zip(cuts, cuts[1:]):
                if tuple(keys[x]) != key:
                    if held:
                        yield closed()
                    key, held = tuple(keys[x]), []
                held.append(batch.slice(x, y - x))
        if held:
            yield closed()

    return dealt.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long").distinct()


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, component``: of each row with an id the smallest id of its group of near-copies."""
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull())
    kind = docs.schema[key].dataType.simpleString()
    path = shared_path(spark, "near-copies")
    sketch = [f"w{j}" for j in range(WORDS)]
    ends = lambda x, y: [F.col(f"{x}.d{i}").alias(f"{y}{i}") for i in (1, 2)]

    def make():
        hashed = Hasher()

        def rows(k, t):
            words = words_of(t)
            node, h = node_of(words), hashed(words)
            return [k], [node[0]], [node[1]], [simhash.fingerprint(t, SHINGLE)], [len(h)], *[[w] for w in sketch_of(h).tolist()]
        return rows

    columns = ", ".join(f"{w} long" for w in sketch)
    prints = stored(by_row(docs, text, make, f"k {kind}, d1 long, d2 long, fp long, n int, {columns}", key), "near-copies", f"{path}/prints")
    entries = stored(prints.groupBy(*NODE).agg(F.min("k").alias("node"), *[F.first(c).alias(c) for c in ("fp", "n", *sketch)]), "near-copies", f"{path}/entries")
    nodes, links, rounds = entries.select("node"), None, 0

    def grouped() -> DataFrame:
        """Entries with the root of their group so far."""
        if links is None:
            return entries.withColumn("root", F.col("node"))
        return stored(entries.join(connected_groups(nodes, links), "node"), "near-copies", f"{path}/groups{rounds}")

    def link(pairs: DataFrame, groups: DataFrame) -> bool:
        """Takes in those of ``pairs(a1, a2, b1, b2)`` that are near-copies of another group; whether there are any."""
        nonlocal links, rounds
        side = lambda x: groups.select(*[F.col(c).alias(f"{x}{c.removeprefix('d')}") for c in (*NODE, "node", "root", "n", *sketch)])
        named = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).where("aroot <> broot").where(may_share("a", "b"))
        named = stored(named.select("a1", "a2", "b1", "b2", F.col("anode").alias("a"), F.col("bnode").alias("b")), "near-copies", f"{path}/pairs{rounds}")
        kept = confirmed(docs, text, named.drop("a", "b"), f"{path}/texts{rounds}")
        found = stored(named.join(kept, ["a1", "a2", "b1", "b2"]).select("a", "b"), "near-copies", f"{path}/links{rounds}")
        for done in ("pairs", "texts"):
            remove(spark, f"{path}/{done}{rounds}")
        links, rounds = found if links is None else links.unionByName(found), rounds + 1
        return not found.isEmpty()

    # First by fingerprints: equal ones, and those that deletion variants bring together.
    alone = stored(entries.groupBy("fp").agg(F.min(F.struct(*NODE)).alias("r")), "near-copies", f"{path}/fingerprints")
    equal = entries.join(alone, "fp").withColumn("x", F.struct(*NODE)).where("x <> r").select(*ends("r", "a"), *ends("x", "b"))
    end = lambda x, y: alone.select(F.col("fp").alias(x), *ends("r", y))
    near = simhash.link(alone).join(end("a", "x"), "a").join(end("b", "y"), "b").select(*[F.col(f"{x}{i}").alias(f"{y}{i}") for x, y in (("x", "a"), ("y", "b")) for i in (1, 2)])
    link(equal.unionByName(near), grouped())

    # Then what shares first shingles, each with the smallest.
    alike = Window.partitionBy("s")
    one = F.struct("n", *NODE, "i")
    met = (prefixes(docs, text).repartition("s").dropDuplicates()
           .withColumns({"x": one, "indexed": F.expr(INDEXED)})
           .withColumns({"first": F.min(F.when(F.col("indexed"), F.col("x"))).over(alike), "m": F.count("*").over(alike)})
           .where("m > 1 AND first IS NOT NULL").select("s", "x", "indexed", "first", "m"))
    met = stored(met, "near-copies", f"{path}/met")
    stars = met.where(F.col("first") < F.col("x")).where(may_be_similar("first", "x")).select(*ends("first", "a"), *ends("x", "b")).distinct()
    link(stars, grouped())

    # Where what meets by a shingle isn't one group yet, pairs across groups: each text's closest, then all.
    for closest in (True, False):
        groups = grouped()
        rooted = (met.where("m > 2").select("s", "m", F.col("x.d1").alias("d1"), F.col("x.d2").alias("d2"), F.col("x.i").alias("i"), (F.col("indexed") & (F.col("x") != F.col("first"))).alias("indexed"))
                  .join(groups.select(*NODE, "n", "root", *sketch), NODE))
        opened = rooted.withColumns({"low": F.min("root").over(alike), "high": F.max("root").over(alike)}).where("low <> high").drop("low", "high")
        if not link(across(opened, closest), groups) and not closest:
            break
    groups = grouped()
    for done in ("met", "fingerprints"):
        remove(spark, f"{path}/{done}")
    return prints.select("k", *NODE).join(groups.select(*NODE, "root"), NODE).select(F.col("k").alias(key), F.col("root").alias("component"))
