"""Descriptive statistics of columns and clouds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.scalar import finite_or_null
from pulseframe.operators.neighbours import cell_index, knn_summary
from pulseframe.operators.ranking import exact_quantiles
from pulseframe.session import cut_lineage


def field_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, finite, missing, minimum, maximum, mean`` per column, one pass."""
    measures = {"finite": lambda c: F.count(c), "missing": lambda c: F.count_if(c.isNull()),
                "minimum": F.min, "maximum": F.max, "mean": F.avg}
    one = df.agg(*[f(finite_or_null(c)).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, f in measures.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), *[F.col(f"{i}_{m}").alias(m) for m in measures]) for i, c in enumerate(columns)])))


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, extremes, mean, population variance and exact p05..p95 per column, whatever the size."""
    shape = {"valid_count": lambda c: F.count(c), "invalid_count": lambda c: F.count_if(c.isNull()), "minimum": F.min,
             "maximum": F.max, "mean": F.avg, "variance": F.var_pop, "standard_deviation": F.stddev_pop}
    one = df.agg(*[f(finite_or_null(c)).alias(f"{i}_{m}") for i, c in enumerate(columns) for m, f in shape.items()])
    table = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), *[F.col(f"{i}_{m}").alias(m) for m in shape]) for i, c in enumerate(columns)])))
    names = ["percentile_05", "percentile_25", "median", "percentile_75", "percentile_95"]
    quantiles = exact_quantiles(df, columns, [0.05, 0.25, 0.5, 0.75, 0.95]).select("field", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    return table.join(quantiles, "field", "left").withColumn("approximate", F.lit(False))


def code_or_null(column: str, maximum: int) -> Column:
    """An integer code in 0..maximum, else NULL."""
    c = finite_or_null(column)
    return F.when((c >= 0) & (c <= maximum) & (c == F.floor(c)), c.cast("int"))


def return_histograms(df: DataFrame, class_column: str = "classification") -> DataFrame:
    """``kind, code, n`` for class, return number and number of returns, one pass."""
    coded = df.select(code_or_null(class_column, 255).alias("class_code"),
                      code_or_null("return_number", 15).alias("return_number"),
                      code_or_null("number_of_returns", 15).alias("number_of_returns"))
    combos = coded.groupBy("class_code", "return_number", "number_of_returns").agg(F.count(F.lit(1)).alias("n"))
    # The three-way histogram is small; the three marginals come from it.
    return (combos.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("code"), F.col("n")) for k in
        ("class_code", "return_number", "number_of_returns")])).alias("s")).select("s.*")
        .where(F.col("code").isNotNull() & ((F.col("kind") == "class_code") | (F.col("code") >= 1)))
        .groupBy("kind", "code").agg(F.sum("n").alias("n")))


def cloud_profile(df: DataFrame, class_column: str = "classification") -> DataFrame:
    """One row: extent, density, return fractions and counts of unusable codes."""
    r, n = code_or_null("return_number", 15), code_or_null("number_of_returns", 15)
    valid = F.coalesce((r >= 1) & (n >= r), F.lit(False))
    one = df.agg(
        F.count(F.lit(1)).alias("points"),
        (F.max("x") - F.min("x")).alias("extent_x"), (F.max("y") - F.min("y")).alias("extent_y"),
        F.count_if(code_or_null(class_column, 255).isNull()).alias("invalid_class"),
        F.count_if(F.coalesce(r < 1, F.lit(True))).alias("invalid_return_number"),
        F.count_if(F.coalesce(n < 1, F.lit(True))).alias("invalid_number_of_returns"),
        F.count_if(valid).alias("_valid"), F.count_if(valid & (r == n)).alias("_last"), F.count_if(valid & (n > 1)).alias("_multi"))
    area = F.col("extent_x") * F.col("extent_y")
    return one.select(
        "points", "extent_x", "extent_y", area.alias("bbox_area"),
        F.when(area > 0, F.col("points") / area).alias("bbox_density"),
        F.when((area > 0) & (F.col("points") > 0), F.sqrt(area / F.col("points"))).alias("nominal_spacing"),
        "invalid_class", "invalid_return_number", "invalid_number_of_returns",
        F.when(F.col("points") > 0, F.col("_valid") / F.col("points")).otherwise(0.0).alias("valid_return_fraction"),
        F.when(F.col("_valid") > 0, F.col("_last") / F.col("_valid")).otherwise(0.0).alias("last_return_fraction"),
        F.when(F.col("_valid") > 0, F.col("_multi") / F.col("_valid")).otherwise(0.0).alias("multiple_return_fraction"))


def bounds(df: DataFrame) -> DataFrame:
    """Minimum, maximum and size per axis and whether the box is valid."""
    one = df.agg(*[f(finite_or_null(a)).alias(f"{g}_{a}") for a in "xyz" for g, f in (("min", F.min), ("max", F.max))])
    sizes = {f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    one = one.withColumns(sizes)
    ok = F.lit(True)
    for a in "xyz":
        ok = ok & F.coalesce(F.col(f"size_{a}") >= 0, F.lit(False))
    return one.withColumn("is_valid", ok)


def z_sample_stats(df: DataFrame) -> DataFrame:
    """Mean and sample (n-1) deviation of z: the one deviation that is not population."""
    return df.agg(F.count("z").alias("n"), F.avg("z").alias("z_mean"), F.stddev_samp("z").alias("z_sample_std"))


def spacing_queries(df: DataFrame, cell: float | None = None) -> DataFrame:
    """The first point of every occupied cell; by default a cell has room for one point on average."""
    if cell is None:
        b = df.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("ex"), (F.max("y") - F.min("y")).alias("ey")).first()
        cell = math.sqrt(max((b.ex or 0.0) * (b.ey or 0.0), 1e-12) / max(1, b.n)) or 1.0
    cells = [cell_index("x", cell).alias("cx"), cell_index("y", cell).alias("cy")]
    # Plain values are kept by hash, a struct would sort the whole table.
    return df.groupBy(*cells).agg(F.min("point_id").alias("point_id"), *[F.min_by(a, "point_id").alias(a) for a in "xyz"]).drop("cx", "cy")


def spacing(df: DataFrame, cell: float | None = None) -> DataFrame:
    """Nearest-neighbour spacing of one point per occupied cell, searched in the whole cloud.

    One row: searched, duplicate and unresolved points, mean, extremes, p10..p90,
    median absolute deviation and ``ln 2 / (pi median^2)`` as density.  Quantiles are exact.
    """
    queries = cut_lineage(spacing_queries(df, cell))
    # Coincident points are seen where a query's nearest point is: no table of all places is grouped for them.
    found = knn_summary(queries, df.select("point_id", "x", "y", "z"), 1, positive_only=True)
    table = cut_lineage(found.select(F.col("mean_distance").alias("d"), F.when(F.col("coincident"), 1).alias("dup")))
    one = table.agg(
        F.count(F.lit(1)).alias("sampled"), F.count("dup").alias("duplicate_samples"), F.count_if(F.col("d").isNull()).alias("unresolved_samples"),
        F.avg("d").alias("mean"), F.min("d").alias("minimum"), F.max("d").alias("maximum"))
    names = {"percentile_10": 0.1, "percentile_25": 0.25, "median": 0.5, "percentile_75": 0.75, "percentile_90": 0.9}
    q = exact_quantiles(table, ["d"], list(names.values())).first()
    median = q.q2
    off = None if median is None else exact_quantiles(table.select(F.abs(F.col("d") - median).alias("d")), ["d"], [0.5]).first().q0
    lit = lambda v: F.lit(v).cast("double")
    return one.select(
        "sampled", "duplicate_samples", "unresolved_samples", "mean", "minimum", *[lit(q[f"q{i}"]).alias(n) for i, n in enumerate(names)], "maximum",
        lit(off).alias("median_absolute_deviation"),
        lit(math.log(2.0) / math.pi / (median * median) if median else None).alias("density_2d"))
