"""Resumable tile processing: a ledger of finished tiles, in batch or as a stream."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pulseframe.session import cut_lineage

LEDGER = ("config STRING, tile_col INT, tile_row INT, points BIGINT, input_hash BIGINT, row_count BIGINT, hash_xor BIGINT,"
          " seconds DOUBLE, area DOUBLE, batch BIGINT, entry BIGINT")
TILE = ["tile_col", "tile_row"]


def config_identity(config: dict) -> str:
    """Stable identity of a job's parameters."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each tile."""
    try:
        entries = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LEDGER)
        raise
    names = [n.split()[0] for n in LEDGER.split(", ")]
    return entries.groupBy(*TILE).agg(F.max_by(F.struct(*names), "entry").alias("e")).select("e.*")


def row_hash(df: DataFrame) -> Column:
    columns = sorted(c for c in df.columns if c not in TILE)
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("missing")) for c in columns])


def tile_inputs(points: DataFrame) -> DataFrame:
    """``tile_col, tile_row, points, input_hash, area`` of the rows a tile is computed from."""
    area = F.lit(None).cast("double")
    if {"x", "y"} <= set(points.columns):
        area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return (points.withColumn("_h", row_hash(points)).groupBy(*TILE)
            .agg(F.count(F.lit(1)).alias("points"), F.bit_xor("_h").alias("input_hash"), area.cast("double").alias("area")))


def pending_tiles(inputs: DataFrame, ledger: DataFrame, config: str) -> DataFrame:
    """Tiles that were never computed, or from other rows than those there are now.

    A ledger of another configuration is refused.
    """
    if not ledger.where(F.col("config") != config).isEmpty():
        raise ValueError("this folder holds results of another configuration")
    done = ledger.select(*TILE, F.col("points").alias("_p"), F.col("input_hash").alias("_i"))
    return (inputs.join(done, TILE, "left").where(~(F.col("points").eqNullSafe(F.col("_p")) & F.col("input_hash").eqNullSafe(F.col("_i"))))
            .drop("_p", "_i"))


def process_tiles(points: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, config: dict, *,
                  batch: int = 0, only: DataFrame | None = None) -> int:
    """Compute the pending tiles of ``points`` (with ``tile_col, tile_row``) and record them.

    ``compute`` maps all rows of the pending tiles (core and halo) to output rows
    that keep the tile columns.  A tile whose rows have changed since its entry, because late ones
    came, is pending again and computed anew from all its rows.  Output partitions are overwritten
    dynamically and the ledger is written last, so a repeated or interrupted run is harmless.
    Returns the number of tiles completed.
    """
    spark = points.sparkSession
    identity = config_identity(config)
    ledger = read_ledger(spark, path)
    chosen = points if only is None else points.join(only.select(*TILE).distinct(), TILE, "left_semi")
    todo = cut_lineage(pending_tiles(tile_inputs(chosen), ledger, identity))
    total = todo.agg(F.count(F.lit(1)).alias("tiles"), F.sum("points").alias("points")).first()
    if not total.tiles:
        return 0
    entry = 1 + (ledger.agg(F.max("entry")).first()[0] or 0)
    started = time.monotonic()
    out = compute(points.join(todo.select(*TILE), TILE, "left_semi"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TILE).parquet(f"{path}/tiles"))
    seconds = time.monotonic() - started
    written = spark.read.schema(out.schema).parquet(f"{path}/tiles").join(todo.select(*TILE), TILE, "left_semi")
    entries = written.withColumn("_h", row_hash(out)).groupBy(*TILE).agg(F.count(F.lit(1)).alias("row_count"), F.bit_xor("_h").alias("hash_xor"))
    # Tiles run together: the time is shared out by their rows.
    (todo.join(entries, TILE, "left").select(
        F.lit(identity).alias("config"), *TILE, "points", "input_hash", F.coalesce("row_count", F.lit(0)).alias("row_count"), "hash_xor",
        (F.lit(seconds) * F.col("points") / float(total.points)).alias("seconds"), "area", F.lit(batch).cast("long").alias("batch"), F.lit(entry).cast("long").alias("entry"))
     .write.mode("append").parquet(f"{path}/ledger"))
    return total.tiles


def verify_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries whose stored rows no longer match the recorded count or hash."""
    data = spark.read.parquet(f"{path}/tiles")
    now = (data.withColumn("_h", row_hash(data)).groupBy(*TILE).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("x")))
    return (read_ledger(spark, path).join(now, TILE, "left")
            .where(~(F.col("row_count").eqNullSafe(F.coalesce("n", F.lit(0))) & F.col("hash_xor").eqNullSafe(F.col("x")))))


def stream_tiles(spark: SparkSession, source: str, schema, compute: Callable[[DataFrame], DataFrame], path: str, config: dict,
                 checkpoint: str):
    """Process tiles as their files arrive.

    The rows of each micro-batch are kept by tile under ``arrived``.  A tile is computed from all
    its rows so far, again whenever more arrive, so the end result is the same however the files
    were cut into batches.  A batch that is repeated overwrites its own rows.
    """
    names = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([f for f in names.fields if f.name not in TILE] + [StructField(c, IntegerType()) for c in TILE])
    columns = [f.name for f in names.fields]

    def each(batch: DataFrame, number: int) -> None:
        here = f"{path}/arrived/batch={number}"
        batch.write.mode("overwrite").partitionBy(*TILE).parquet(here)
        session = batch.sparkSession
        tiles = session.read.schema(fields).parquet(here).select(*TILE).distinct()
        arrived = session.read.schema(StructType([*fields.fields, StructField("batch", LongType())])).parquet(f"{path}/arrived").select(*columns)
        process_tiles(arrived, compute, path, config, batch=number, only=tiles)

    return (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def eta(ledger: DataFrame, remaining_work: float = 0.0) -> DataFrame:
    """Seconds per unit of work from finished tiles and the remaining time with its range.

    Work is ``points (1 + points / area)``; tiles under 10,000 points are ignored.
    Needs ``points, area, seconds``.
    """
    work = F.col("points") * (1 + F.col("points") / F.greatest(F.lit(1.0), "area"))
    one = ledger.where((F.col("points") >= 10_000) & (F.col("seconds") > 0)).agg(
        F.count(F.lit(1)).alias("samples"), F.sum("seconds").alias("seconds"), F.sum(work).alias("work"))
    rate = F.when(F.col("work") > 0, F.col("seconds") / F.col("work")).otherwise(0.0)
    few = F.col("samples") < 3
    return one.select("samples", rate.alias("seconds_per_work"), (rate * remaining_work).alias("remaining"),
                      (rate * remaining_work * F.when(few, 0.4).otherwise(0.6)).alias("remaining_low"),
                      (rate * remaining_work * F.when(few, 2.5).otherwise(1.8)).alias("remaining_high"))
