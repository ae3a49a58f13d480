"""Hard negatives by inner product, found with length buckets and sorted coordinate lists.

Vectors are dealt by label into blocks of bounded size and, within a label, by length: a block is a length
bucket.  It holds its vectors' directions and, for each coordinate, the list of its vectors sorted by that coordinate's
value.  For an anchor a product of at least ``s`` leaves, by its angle to the block's longest vector, a range of
values on each coordinate; the anchor's few largest coordinates are its focus.  The vectors within the
range are read off the sorted list of the focus with the shortest range and cut down to those within all of them;
only they are multiplied out.  A block whose longest vector can't reach ``s`` isn't looked at.

Bounds ``s`` come from a first look at a few blocks: what is found there is a lower bound of what the whole search
returns, so nothing is lost by it.  Positives are searched in the anchor's own label, negatives in the others between half and
0.95 of the positive's score.  Best lists are kept per tile and merged in a tree; no task holds more than two blocks.

Rows with a null id, label or vector, an empty vector or a null or non-finite component take no part; vectors of different lengths are an
error.  Ties go to the smaller id; a row is never its own positive, nor is another row of the same id; repeated rows are candidates
of their own, while equal anchors are searched once.  Anchors without a positive, and pairs without a negative, give no
row.  An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseframe.llm.common import prepare, shared_path, stored

BLOCK_ROWS, ANCHOR_ROWS = 4096, 1024
FOCUS = 3
SLACK = 1e-9  # rounding of unit vectors and angles
FAN = 32
BUCKETS = 16


def labelled_vectors(df: DataFrame, scale: int) -> DataFrame:
    """``id, label, v``: ``floor(scale * x)`` of each component as double, for rows that are whole."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
             & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0))
    return df.where(F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * float(scale)).cast("double")).alias("v"))


def relabelled(rows: DataFrame, every: int, labels: int) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next of ``labels`` labels."""
    return rows.withColumn("label", F.when(F.col("id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def vector_blocks(rows: DataFrame, block_rows: int, path: str) -> DataFrame:
    """``label, block, rows, longest``: ``array<struct<id, v>>`` of at most about ``block_rows`` rows, by length within a label.

    Lengths are cut at approximate quantiles per label, in one pass; a fuller bucket (copies have one length) is dealt over
    several blocks, so a block is bounded for any data.
    """
    cuts = F.percentile_approx("length", F.lit([i / BUCKETS for i in range(1, BUCKETS)]), F.lit(1000)).alias("cuts")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), cuts)
    # Small buckets share a block with their neighbours in length.
    joined = F.greatest(F.lit(1), F.floor(F.lit(BUCKETS * block_rows) / F.col("n"))).cast("int")
    bucket = F.floor(F.size(F.filter("cuts", lambda c: c < F.col("length"))) / F.col("joined"))
    placed = rows.join(sizes, "label").withColumn("joined", joined).withColumn("bucket", bucket)
    counts = placed.groupBy("label", "bucket").agg(F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("m") / block_rows))
    blocks = (placed.join(counts, ["label", "bucket"]).withColumn("block", (F.col("bucket") * 1_000_000_000 + part).cast("long"))
              .groupBy("label", "block").agg(F.collect_list(F.struct("id", "v")).alias("rows"), F.max("length").alias("longest")))
    return stored(blocks, "vector-blocks", path)


def anchor_blocks(anchors: DataFrame, anchor_rows: int) -> DataFrame:
    """``label, anchors, steepest``: anchors ``id, key, v, least, needs`` of one label in bounded blocks.

    ``steepest`` is the largest of length / bound: a block of vectors whose longest is shorter than 1 / ``steepest`` holds nothing for any of them.
    """
    sizes = anchors.groupBy("label").agg(F.count("*").alias("n"))
    steep = F.when(F.col("least") > 0, F.col("length") / F.col("least")).otherwise(F.lit(float("inf")))
    return (anchors.join(sizes, "label").withColumn("a_block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / anchor_rows)))
            .groupBy("label", "a_block").agg(F.collect_list(F.struct("id", "key", "v", "least", "needs")).alias("anchors"), F.max(steep).alias("steepest")))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy().reshape(len(column), -1)


class Bucket:
    """A block of vectors, ids ascending, with sorted lists of the coordinates that anchors ask for."""

    def __init__(self, rows: pa.StructArray):
        ids = rows.field("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.matrix = ids[order], matrix_of(rows.field("v"))[order]
        lengths = np.sqrt((self.matrix * self.matrix).sum(axis=1))
        self.longest = lengths.max()
        self.unit = self.matrix / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in the order of coordinate ``f``, and its values in that order."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, least: float | None, focus: int = FOCUS) -> np.ndarray:
        """Places, ascending, of all vectors whose product with the anchor may reach ``least``."""
        if anchor.shape[0] != self.matrix.shape[1]:
            raise ValueError("vectors of different lengths")
        if least is None or least <= 0:
            return np.arange(len(self.ids))
        size = float(np.sqrt(anchor @ anchor))
        if size * self.longest < least * (1 - SLACK):
            return np.zeros(0, np.int64)
        reach = np.arccos(min(1.0, least / (size * self.longest))) + 1e-7
        direction = anchor / size
        ranges = []
        for f in np.argsort(-np.abs(direction), kind="stable")[:focus].tolist():
            angle = np.arccos(np.clip(direction[f], -1.0, 1.0))
            low, high = np.cos(min(np.pi, angle + reach)) - SLACK, np.cos(max(0.0, angle - reach)) + SLACK
            values = self.coordinate(f)[1]
            ranges.append((np.searchsorted(values, low), np.searchsorted(values, high, "right"), f, low, high))
        a, b, first, _, _ = min(ranges, key=lambda r: r[1] - r[0])
        found = self.coordinate(first)[0][a:b]
        for _, _, f, low, high in ranges:
            if f != first:
                value = self.unit[found, f]
                found = found[(value >= low) & (value <= high)]
        return np.sort(found)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, the first of equal ones."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def look_for_positives(bucket: Bucket, anchor: dict, vector: np.ndarray, k: int, focus: int) -> list[tuple]:
    """``positive_id, positive_score, found, score``: here the found row is the positive."""
    at = bucket.candidates(vector, anchor["least"], focus)
    at = at[bucket.ids[at] != anchor["id"]]
    scores = bucket.matrix[at] @ vector
    return [(None, None, None, int(bucket.ids[at[i]]), int(scores[i])) for i in best(scores, k)]


def look_for_negatives(bucket: Bucket, anchor: dict, vector: np.ndarray, k: int, focus: int) -> list[tuple]:
    """Of each positive of the anchor the best rows within its range of scores."""
    at = bucket.candidates(vector, anchor["least"], focus)
    scores = (bucket.matrix[at] @ vector).astype(np.int64)
    out = []
    for need in anchor["needs"]:
        p = need["positive_score"]
        # The bound is at least half the positive's score.
        fits = np.flatnonzero((scores >= need["bound"]) & (100 * scores >= 50 * p) & (100 * scores <= 95 * p))
        out += [(need["place"], need["positive_id"], p, int(bucket.ids[at[fits[i]]]), int(scores[fits[i]])) for i in best(scores[fits], k)]
    return out


SCHEMA = "tile long, anchor_id long, key long, label long, place int, positive_id long, positive_score long, found long, score long"


def searched(tiles: DataFrame, look, k: int, focus: int) -> DataFrame:
    """Best lists of each anchor in each tile ``label, anchors, tile, rows``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                label, anchors, tile, rows = (batch.column(n)[i] for n in ("label", "anchors", "tile", "rows"))
                bucket, anchors = Bucket(rows.values), anchors.values
                vectors = matrix_of(anchors.field("v"))
                others = pa.StructArray.from_arrays([anchors.field(n) for n in ("id", "key", "least", "needs")], ["id", "key", "least", "needs"])
                out = [(tile.as_py(), a["id"], a["key"], label.as_py(), *found)
                       for a, v in zip(others.to_pylist(), vectors) for found in look(bucket, a, v, k, focus)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return tiles.select("label", "anchors", "tile", "rows").mapInArrow(run, SCHEMA)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor (and positive) over all tiles; groups of tiles are merged first."""
    by, order = ["anchor_id", "key", "label", "place", "positive_id", "positive_score"], [F.desc("score"), F.asc("found")]
    for group in ([*by, "tile"], by):
        lists = (lists.withColumn("tile", F.pmod(F.col("tile"), F.lit(FAN)))
                 .withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k))
    return lists.drop("tile")


def in_reach(steepest: str = "steepest", longest: str = "longest"):
    return F.col(longest) * F.col(steepest) >= 1 - SLACK


def best_positives(anchors: DataFrame, blocks: DataFrame, k: int, anchor_rows: int, focus: int, path: str) -> DataFrame:
    """``anchor_id, key, label, found, score, rank``: the k best other rows of each anchor's own label."""
    tile = F.xxhash64("label", "block").alias("tile")
    right = blocks.select("label", tile, "rows", "longest")
    pilot = blocks.groupBy("label").agg(F.max_by("block", F.struct("longest", "block")).alias("block")).select(tile)
    unbounded = anchors.withColumns({"least": F.lit(None).cast("double"), "needs": F.lit(None).cast(NEEDS)})
    seen = searched(anchor_blocks(unbounded, anchor_rows).join(right.join(pilot, "tile", "left_semi"), "label"), look_for_positives, k, focus)
    # The k-th best of the first look, where there are k.
    bounds = merged(seen, k).where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "key", F.col("score").cast("double").alias("least"))
    bounded = stored(anchors.join(bounds, ["id", "key"], "left").withColumn("needs", F.lit(None).cast(NEEDS)), "anchors", f"{path}/bounded")
    tiles = anchor_blocks(bounded, anchor_rows).join(right, "label").where(in_reach())
    return stored(merged(searched(tiles, look_for_positives, k, focus), k), "positives", f"{path}/positives")


NEEDS = "array<struct<place:int,positive_id:bigint,positive_score:bigint,bound:bigint>>"


def best_negatives(anchors: DataFrame, blocks: DataFrame, found: DataFrame, k: int, anchor_rows: int, focus: int, path: str) -> DataFrame:
    """For each positive the k best rows of other labels within its range: ``place, positive_id, positive_score, found, score, rank`` beside the anchor."""
    lanes = max(1, blocks.count())
    lane = F.pmod(F.xxhash64("label", "block"), F.lit(lanes))
    right = blocks.select(F.col("label").alias("other"), F.xxhash64("label", "block").alias("tile"), lane.alias("lane"), "rows", "longest")
    wanted = found.where("score >= 0").select(F.col("anchor_id").alias("id"), "key", F.col("rank").alias("place"), F.col("found").alias("positive_id"),
                                              F.col("score").alias("positive_score"))

    def with_needs(needs: DataFrame) -> DataFrame:
        each = (needs.groupBy("id", "key").agg(F.collect_list(F.struct("place", "positive_id", "positive_score", "bound")).alias("needs"),
                                               F.min("bound").cast("double").alias("least")))  # as many as positives are asked for
        return anchor_blocks(anchors.join(each, ["id", "key"]), anchor_rows)

    def tiles(needs: DataFrame, first: bool) -> DataFrame:
        # A block of anchors meets each lane once, and so each block of vectors once.
        numbers = F.array(F.lit(0).cast("long")) if first else F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))
        left = with_needs(needs).withColumn("lane", F.explode(numbers))
        # Merged, never broadcast: anchors times lanes would pass for the anchors alone and go to the driver.
        return left.join(right.hint("merge"), "lane").where((F.col("label") != F.col("other")) & in_reach())

    half = F.ceil(F.col("positive_score") / 2).cast("long")
    seen = merged(searched(tiles(wanted.withColumn("bound", half), True), look_for_negatives, k, focus), k)
    bounds = seen.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "key", "place", F.col("score").alias("seen"))
    needs = stored(wanted.join(bounds, ["id", "key", "place"], "left").withColumn("bound", F.coalesce("seen", half)).drop("seen"), "needs", f"{path}/needs")
    return merged(searched(tiles(needs, False), look_for_negatives, k, focus), k)


def mine(rows: DataFrame, anchors: DataFrame, *, n_positives: int = 5, n_negatives: int = 3, block_rows: int = BLOCK_ROWS,
         anchor_rows: int = ANCHOR_ROWS, focus: int = FOCUS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``anchors`` among ``rows``, both ``id, label, v``.

    Components are whole numbers held as double, so products are exact while sums stay below 2**53.
    """
    spark = rows.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a tile
    path = shared_path(spark, "hard-negatives")
    measured = lambda df: df.select("id", "label", "v", F.xxhash64("id", "label", "v").alias("key"),
                                    F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("length"))
    blocks = vector_blocks(measured(rows), block_rows, f"{path}/blocks")
    anchors = stored(measured(anchors.distinct()), "anchors", f"{path}/anchors")
    found = best_positives(anchors, blocks, n_positives, anchor_rows, focus, path)
    negatives = best_negatives(anchors, blocks, found, n_negatives, anchor_rows, focus, path)
    out = stored(negatives.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
                 "hard-negatives", f"{path}/found")
    prepare(spark)  # later plans take more rows at once again
    return out


ORACLE = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, a.label AS anchor_label, c.id, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id % 50 = 0 AND c.id <> a.id),
p AS (SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op11_coordinate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every 50th vector, a seventh of the labels moved on by one."""
    rows = relabelled(labelled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256), 7, 10)
    return mine(rows, rows.where("id % 50 = 0"))
