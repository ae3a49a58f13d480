"""Near-duplicates by SimHash with deletion-variant signatures.

Fingerprints of 64 bits come from word shingles.  To find all pairs that differ in at most
``distance`` = 3 bits a fingerprint is cut into two segments only, one of which then differs in
at most one bit.  Each segment is indexed under its one-wildcard variants (a position, and the
other bits); equal variants meet in one bucket, where whole fingerprints are compared.

Equal fingerprints are one entry.  Buckets stream through a task in key order; a bucket gives
links that connect what it connects (at most its size, less one), never all pairs.  A bucket of
more than ``bucket_rows`` entries is not compared but cut again: its remaining 32 bits into halves of
16, then of 8, under the same rule, after which a bucket holds at most 1,024 different entries.
So no bucket is dropped, and none is gathered beyond a fixed size.

Null and empty texts (no words) have the fingerprint zero and link like any other; a text with
fewer words than a shingle is one shingle; rows with a null id are left out; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm.common import connected_groups, by_batch, prepare, shared_path, stored, text_or_empty

DISTANCE = 3
BUCKET_ROWS = 1024
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the hashes of the text's shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    pieces = [b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)))] or [b" ".join(words)]
    total, n = np.zeros(64, np.int64), len(pieces)
    for at in range(0, n, 65536):
        hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in pieces[at:at + 65536]], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key, fp``: the fingerprint as a signed 64-bit integer."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return by_batch(rows, lambda c: {"k": c["k"], "fp": [fingerprint(t, shingle) for t in c["t"]]},
                    f"k {kind}, fp long").withColumnRenamed("k", key)


def variants(level: int) -> list[tuple[int, int, int]]:
    """Segments of a level as (number, first bit, width): 32 bits, then 16 and 8 of the bits left."""
    width = (32, 16, 8)[level]
    return [(i, i * width, width) for i in range(64 // width)]


def signatures(entries: DataFrame, level: int) -> DataFrame:
    """``path, key, seen, fp``: one row for each wildcard variant of each segment still to be cut.

    ``entries(path, seen, fp)``; ``seen`` is the mask of bits that earlier levels have compared.
    ``path`` identifies the bucket so far, ``key`` the new one within it.
    """
    rows = []
    for number, first, width in variants(level):
        mask = (1 << width) - 1
        for wild in range(width):
            keep = (mask & ~(1 << wild)) << first
            rows.append((number * 64 + wild, signed(keep), signed(mask << first)))
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(keep).alias("keep"), F.lit(whole).alias("whole")) for n, keep, whole in rows])
    cut = F.col("cut")
    made = entries.withColumn("cut", F.explode(cuts)).where(F.col("seen").bitwiseAND(cut["whole"]) == 0)
    value = F.col("fp").bitwiseAND(cut["keep"])
    path = F.xxhash64("path", cut["n"], value) if level else F.shiftleft(F.col("path"), 0)
    # The bucket is the pair of numbers (path, key): at level 0 exact, deeper a hash that whole comparison makes harmless.
    key = value if level == 0 else path
    return made.select((cut["n"].cast("long") if level == 0 else F.lit(0).cast("long")).alias("path"), key.alias("key"),
                       F.col("seen").bitwiseOR(cut["whole"]).alias("seen"), "fp")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links_within(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all entries within ``distance`` of each other: at most one fewer than entries."""
    found, left = [], np.ones(len(fps), bool)
    while left.any():  # breadth first from the first entry not yet reached
        first = int(np.argmax(left))
        left[first] = False
        queue = [first]
        while queue:
            a = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[a]) <= distance))
            left[near] = False
            queue.extend(near.tolist())
            found.extend((int(fps[a]), int(fps[b])) for b in near.tolist())
    return found


def compare_buckets(signed_rows: DataFrame, distance: int, bucket_rows: int | None) -> DataFrame:
    """``a, b, path, seen``: links; and entries of buckets too large to compare, with ``b`` null."""
    names = ["a", "b", "path", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, [], False
        out: list[tuple] = []

        def close():
            if key is not None and not large and len(held) > 1:
                fps = np.unique(np.array(held, np.int64)).view(np.uint64)
                if len(fps) > 1:
                    out.extend((np.uint64(a).astype(np.int64).item(), np.uint64(b).astype(np.int64).item(), None, None)
                               for a, b in links_within(fps, distance))

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=names)

        for batch in batches:
            path, new, seen, fp = (c.to_numpy() for c in batch.columns)
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(path) != 0) | (np.diff(new) != 0)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            # Buckets of one entry inside the batch need no look.
            for i in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp))).tolist():
                a, b = int(starts[i]), int(ends[i])
                here = (int(path[a]), int(new[a]))
                if here != key:
                    close()
                    key, held, large = here, [], False
                values = fp[a:b].tolist()
                if not large:
                    held.extend(values)
                    if bucket_rows and len(held) > bucket_rows:
                        large, values, held = True, held, []
                if large:
                    mark = hash((here[0], here[1])) & 0x7FFFFFFFFFFFFFFF
                    out.extend((v, None, mark, int(seen[a])) for v in values)
                if len(out) > 20000:
                    yield made()
                    out = []
        close()
        if out:
            yield made()

    dealt = signed_rows.repartition("path", "key").sortWithinPartitions("path", "key").select("path", "key", "seen", "fp")
    return dealt.mapInArrow(run, "a long, b long, path long, seen long")


def link(entries: DataFrame, *, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: links between different fingerprints ``fp`` that connect all pairs within ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard each cover up to three differing bits")
    spark = entries.sparkSession
    path = shared_path(spark, "simhash")
    # A fixed number of partitions: few bytes here become 64 times as many rows.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (entries.where("fp IS NOT NULL").select("fp").repartition(parts, "fp").distinct()
            .select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("seen"), "fp"))
    links = None
    for level in range(3):
        found = stored(compare_buckets(signatures(rows, level), distance, bucket_rows if level < 2 else None), "simhash", f"{path}/{level}")
        part = found.where("b IS NOT NULL").select("a", "b")
        links = part if links is None else links.unionByName(part)
        rows = found.where("b IS NULL").select("path", "seen", F.col("a").alias("fp"))
        if level == 2 or rows.isEmpty():
            break
    return links.distinct()


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = DISTANCE,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``key, fp, component``: fingerprint of each row and the smallest key that links lead to, itself included."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-classes")
    names = connected_groups(classes.select(F.col("fp").alias("node")), link(classes, distance=distance, bucket_rows=bucket_rows))
    rooted = classes.join(names.withColumnRenamed("node", "fp"), "fp")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(smallest, "root").select("fp", "component")
    return prints.join(named, "fp").select(key, "fp", "component")


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                    F.col("component").alias("component_id"))
