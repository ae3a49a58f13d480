"""What the text operators share: shared storage, Arrow batches, word caches, connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows that cross to a Python worker at once.  Documents may be long, so the
# default of 10,000 rows a batch would not bound memory.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the text operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach.

    Only where that is unset, and only on a local master, a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_path`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_batch(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` over columns as Python lists; the schema of the result is given as DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], names=names)

    return df.mapInArrow(run, schema)


class Memo:
    """A bounded cache for values that can be computed again.

    Two generations: when the young one is full it becomes the old one, and entries
    still in use are copied back on their next use.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 250_000):
        self.compute, self.limit, self.young, self.old = compute, limit, {}, {}

    def values(self, keys: list) -> list:
        """The value of each of ``keys``; those not in the cache are computed together."""
        missing = set(keys).difference(self.young)
        if missing:
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
                missing = set(keys)
            found = {k: self.old[k] for k in missing if k in self.old} if self.old else {}
            self.young.update(found)
            new = list(missing.difference(found))
            self.young.update(zip(new, self.compute(new)))
        return list(map(self.young.__getitem__, keys))


def connected_groups(nodes: DataFrame, edges: DataFrame, *, name: str = "groups", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node: ``node, root``.

    ``nodes(node)``, ``edges(a, b)``; nodes without an edge are their own root.  Large-star and
    small-star rounds: every node tells its neighbours the smallest node it knows.  Minima
    combine before each shuffle, a node's neighbours are never gathered, and each round is
    written to the shared folder.  Rounds grow with the logarithm of the longest chain; running
    out of them is an error, never a partial result.
    """
    spark = edges.sparkSession
    pairs = (edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    path = shared_path(spark, name)
    pairs = stored(pairs, name, f"{path}/0")
    if not pairs.isEmpty():
        before = None
        for i in range(1, max_rounds + 1):
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(low.select("u", F.col("m").alias("v"))))
            pairs = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                           .where("u <> v").distinct(), name, f"{path}/{i}")
            # Both values only fall; equal twice means that nothing moved.
            state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))
