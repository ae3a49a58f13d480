"""Exact top-k search by inner product, in tiles.

Vectors are packed into blocks.  A tile is one block of queries against one shard block: one
integer-valued matrix product, from which each query's best are partially selected.  Tiles'
lists are merged in a tree: first within groups of tiles, then across groups, so no task ever
holds more than a group's lists for its queries.

Vectors that are null, empty, of another length than the table's commonest (the larger of equally
common ones), or hold null or non-finite components take no part.  Ties go to the smaller id; repeated rows are candidates of their own;
query rows of one id are searched each for itself, equal ones once, and rows of a query's id are never its candidates; a query has fewer than k results only if there are fewer candidates.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulseframe.llm.common import prepare

BLOCK_ROWS = 4096


def integer_vectors(df: DataFrame, scale: int, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: ``floor(scale * x)`` of each component as double, for vectors that are whole."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.coalesce(whole & (F.size(x) > 0), F.lit(False)))
    common = rows.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common:
        rows = rows.where(F.size(vector) == common.dim)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("double")).alias("v"))


def packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """``block, ids, matrix``: each block's ids and vectors as bytes; rows are dealt by a hash of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, number = [], [], None

        def made():
            order = np.argsort(np.concatenate(ids), kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.concatenate(ids)[order].tobytes()]),
                                               pa.array([np.concatenate(rows)[order].tobytes()])], names=["block", "ids", "matrix"])

        for batch in batches:
            block, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            values = batch.column(2)
            matrix = values.flatten().to_numpy().reshape(len(key), -1)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if number is not None and (block[a] != number):
                    yield made()
                    ids, rows = [], []
                number = int(block[a])
                ids.append(key[a:b])
                rows.append(matrix[a:b])
        if ids:
            yield made()

    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")
    return (dealt.repartition("block").sortWithinPartitions("block")
            .mapInArrow(run, "block long, ids binary, matrix binary"))


def numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def best_of(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """``(query's place, id, score)``: each query's k best candidates of one tile (ids ascending); ties to the smaller id."""
    scores = np.where(queries[:, None] == ids[None, :], -np.inf, scores)
    out = []
    if scores.shape[1] > k:
        # The k-th largest score bounds the selection; every tie with it is looked at.
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    else:
        bound = np.full(len(queries), -np.inf)
    for place, (row, least) in enumerate(zip(scores, bound)):
        at = np.flatnonzero(row >= least)
        at = at[np.argsort(-row[at], kind="stable")][:k]
        out.extend((place, int(ids[i]), int(row[i])) for i in at if row[i] > -np.inf)
    return out


def top_k(queries: DataFrame, vectors: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS, fan: int = 32) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each of ``queries(id, v)`` the k best of ``vectors(id, v)`` but itself.

    Components are whole numbers held as double, so products are exact while sums stay below
    2**53.  The number of tiles is queries x rows / block_rows**2, each of bounded size.
    """
    prepare(vectors.sparkSession)
    queries = queries.dropDuplicates(["id", "v"])
    n, m = vectors.count(), queries.count()
    if n == 0 or m == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, sets = -(-n // block_rows), -(-m // block_rows)
    left = packed(queries, sets).select("block", F.explode(numbers(shards)).alias("shard"),
                                        F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    right = packed(vectors, shards).select(F.col("block").alias("shard"), F.explode(numbers(sets)).alias("block"),
                                           "ids", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, q_ids, q_matrix, ids, matrix = (batch.column(c)[i].as_py() for c in range(5))
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                a, b = np.frombuffer(q_matrix, "<f8").reshape(len(q_ids), -1), np.frombuffer(matrix, "<f8").reshape(len(ids), -1)
                prints = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in a], np.uint64).view(np.int64)  # tells rows of one id apart
                # Queries in strips: the scores held at once stay near two million.
                step = max(1, 2_000_000 // len(ids))
                for s in range(0, len(q_ids), step):
                    found = best_of(a[s:s + step] @ b.T, q_ids[s:s + step], ids, k)
                    if found:
                        row, v, score = (np.array(x, np.int64) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), shard)), pa.array(q_ids[s + row]), pa.array(prints[s + row]), pa.array(v), pa.array(score)],
                                                         names=["shard", "query_id", "print", "vec_id", "score"])

    # Merged, never broadcast: Spark's estimate knows nothing of the copies that explode makes, so all tiles would pass for one block and go to the driver.
    tiles = left.join(right.hint("merge"), ["block", "shard"]).select("shard", "q_ids", "q_matrix", "ids", "matrix")
    lists = tiles.mapInArrow(run, "shard long, query_id long, print long, vec_id long, score long")
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > 1:  # one level of the tree: groups of ``fan`` lists become one
        shards = -(-shards // fan)
        group = F.floor(F.col("shard") / fan).cast("long")
        lists = (lists.withColumn("shard", group)
                 .withColumn("place", F.row_number().over(Window.partitionBy("query_id", "print", "shard").orderBy(*order)))
                 .where(f"place <= {k}").drop("place"))
    return (lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "print").orderBy(*order)))
            .where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_tiled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every 50th vector among all others."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256)
    return top_k(vectors.where("id % 50 = 0"), vectors, 5)
