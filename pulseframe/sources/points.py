"""Reading points and checking datasets."""

from __future__ import annotations

from itertools import islice
from pathlib import PurePosixPath

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulseframe.functions.scalar import finite_or_null
from pulseframe.schema import POINT_COLUMNS


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that has fewer splits than the cluster has cores.

    Large inputs already arrive in more splits than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_points(df: DataFrame) -> DataFrame:
    """Turn every NaN and infinity of a floating column into NULL."""
    return df.select(*[
        finite_or_null(f.name).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields])


def coordinate_report(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a missing coordinate, rows with a repeated or missing id."""
    bad = F.lit(False)
    for axis in "xyz":
        bad = bad | finite_or_null(axis).isNull()
    # Ids are counted before they are compared, so one repeated id cannot make a hot group.
    per_id = df.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_coordinates"),
        F.coalesce(F.sum(F.when(F.col("point_id").isNull() | (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("bad_ids"))


def read_points(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, *,
                fmt: str = "parquet", check: bool = True) -> DataFrame:
    """Points with the chosen attributes, non-finite values as NULL.

    ``check`` refuses a source with a non-finite coordinate (one narrow pass).
    """
    df = spark.read.format(fmt).load(path)
    if columns is not None:
        df = df.select(*POINT_COLUMNS, *[c for c in columns if c not in POINT_COLUMNS])
    df = clean_points(df)
    if check:
        bad = df.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull())).first()[0]
        if bad:
            raise ValueError(f"{bad} points have non-finite coordinates")
    return df


# Rows decoded at once, at most.
RECORD_ROWS = 65_536
EVEN_ROWS = 256  # rows a divided record holds at least
# Numpy type code -> Spark type.
_RECORD_TYPES = {
    "<f4": T.FloatType(), "<f8": T.DoubleType(), "<u1": T.ShortType(), "<i2": T.ShortType(), "<i4": T.IntegerType(),
    "<u8": T.LongType(), "<i8": T.LongType(),
}


def read_fixed_records(spark: SparkSession, folder: str, layout: dict[str, tuple[str, int]], rows: int) -> DataFrame:
    """Aligned little-endian arrays, one file each, joined on the record number.

    ``layout`` maps a file name to ``(type code, values per record)``.  The record
    count of every file must equal ``rows``.
    """
    out = None
    for name, (code, width) in layout.items():
        kind = _RECORD_TYPES[code]
        dtype = np.dtype(code)
        length = dtype.itemsize * width
        source = f"{folder}/{name}"
        size = spark.read.format("binaryFile").load(source).select(F.sum("length")).first()[0]
        if size != rows * length:
            raise ValueError(f"{name}: {size} bytes, expected {rows} records of {length}")
        stem = PurePosixPath(name).stem

        # A record read from the file holds many rows where their number divides evenly (every record of a file has the
        # same length); else rows are read one by one and decoded many at a time.
        many = next(n for n in range(min(RECORD_ROWS, max(rows, 1)), 0, -1) if rows % n == 0)
        many = many if many >= EVEN_ROWS else 1

        def decode(records, dtype=dtype, width=width, many=many):
            while some := list(islice(records, max(1, RECORD_ROWS // many))):
                values = np.frombuffer(b"".join(raw for raw, _ in some), dtype=dtype).reshape(-1, width)
                cells = values.astype(object)
                if dtype.kind == "f":
                    cells[~np.isfinite(values)] = None
                first = some[0][1] * many  # numbers follow one another within a partition
                yield from zip(range(first, first + len(values)), *(cells[:, i].tolist() for i in range(width)))

        fields = [T.StructField("record", T.LongType(), False)]
        fields += [T.StructField(stem if width == 1 else f"{stem}_{i}", kind) for i in range(width)]
        # Record files are the one place that needs per-partition imperative decoding.
        part = spark.createDataFrame(
            spark.sparkContext.binaryRecords(source, many * length).zipWithIndex().mapPartitions(decode), T.StructType(fields))
        out = part if out is None else out.join(part, "record")
    return out


def validate_dataset(df: DataFrame, features: list[str], *, label: str = "classification",
                     trusted: str = "is_trusted", domain: tuple[int, ...] | None = None) -> DataFrame:
    """Violations per rule: ``rule, violations`` (one pass over the rows)."""
    lab, mark = F.col(label).cast("double"), F.col(trusted).cast("double")
    rules: dict[str, Column] = {
        "label_not_integer_0_255": F.count_if(F.coalesce(~((lab >= 0) & (lab <= 255) & (lab == F.floor(lab))), F.lit(True))),
        "mask_not_0_or_1": F.count_if(F.coalesce(~mark.isin(0.0, 1.0), F.lit(True))),
        "label_outside_domain": F.count_if(F.coalesce(~F.col(label).isin(*domain), F.lit(True))) if domain
        else F.lit(0).cast("long"),
        "feature_name_empty": F.lit(sum(not f.strip() for f in features)).cast("long"),
        "feature_name_repeated": F.lit(len(features) - len(set(features))).cast("long"),
        "feature_missing": F.lit(len([f for f in features if f not in df.columns])).cast("long"),
    }
    one = df.agg(*[c.alias(k) for k, c in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def dataset_summary(df: DataFrame, features: list[str], *, label: str = "classification",
                    trusted: str = "is_trusted") -> DataFrame:
    """Per class and in total (``class_code`` NULL): rows, trusted rows, rows with a missing value."""
    missing = F.lit(False)
    for f in features:
        missing = missing | finite_or_null(f).isNull()
    no_xy = finite_or_null("x").isNull() | finite_or_null("y").isNull()
    return (df.rollup(F.col(label).cast("int").alias("class_code"))
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.count_if(F.col(trusted).cast("boolean")).alias("trusted_rows"),
                 F.count_if(missing).alias("rows_missing_feature"),
                 F.count_if(no_xy).alias("rows_missing_xy"),
                 F.lit(len(features)).alias("feature_count")))
