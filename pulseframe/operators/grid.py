"""Operations on sparse and dense rasters kept as ``(col, row, ...)`` tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# A raster with at most this many cells may be sent to every executor (about 40 bytes a cell).
BROADCAST_CELLS = 1_000_000
# Cells along a tile, rows of a strip, and the halo from which the axes are swept one at a time.
TILE, STRIP_ROWS, WIDE = 512, 64, 512


def densify(grid: DataFrame, width: int, height: int) -> DataFrame:
    """The full ``width x height`` grid; cells without a row get NULL values."""
    cells = grid.sparkSession.range(width * height).select(
        (F.col("id") % width).cast("int").alias("col"), F.expr(f"int(id div {width})").alias("row"))
    return cells.join(grid, ["col", "row"], "left")


def running(values: np.ndarray, radius: int, best: np.ufunc, neutral: float, axis: int) -> np.ndarray:
    """``best`` over ``2 * radius + 1`` places along ``axis``: prefix and suffix bests of blocks of that length, two looks a place whatever the radius."""
    values = np.moveaxis(values, axis, -1)
    n, width = values.shape[-1], 2 * radius + 1
    padded = np.full((*values.shape[:-1], -(-(n + 2 * radius) // width) * width), neutral)
    padded[..., radius:radius + n] = values
    blocks = padded.reshape(*values.shape[:-1], -1, width)
    prefix = best.accumulate(blocks, axis=-1).reshape(padded.shape)
    suffix = best.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(best(suffix[..., :n], prefix[..., 2 * radius:2 * radius + n]), -1, axis)


SIDES = {"min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}


def _in_tiles(dense: DataFrame, value: str, out: str, passes: list[tuple[str, int, str]]) -> DataFrame:
    """Add ``out``: the passes ``(min or max, radius, axes)`` one after another, in tiles with a halo as wide as their radii together.

    Rows are copied to the tiles whose halo they lie in and shuffled once; a task holds one tile.  Where only one axis is
    swept, tiles are strips with a halo at their ends.
    """
    reach = {a: sum(r for _, r, axes in passes if a in axes) for a in ("col", "row")}
    size = {a: max(TILE, 2 * r) if r else STRIP_ROWS for a, r in reach.items()}
    copies = dense
    for a, t in (("col", "_tx"), ("row", "_ty")):
        low, high = (F.floor((F.col(a) + d) / F.lit(size[a])).cast("int") for d in (-reach[a], reach[a]))
        copies = copies.withColumn(t, F.explode(F.sequence(low, high)))
    copies = copies.withColumn("_own", (F.floor(F.col("col") / F.lit(size["col"])) == F.col("_tx")) & (F.floor(F.col("row") / F.lit(size["row"])) == F.col("_ty")))
    names, schema = dense.columns, T.StructType([*dense.schema.fields, T.StructField(out, T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(tile: pa.Table) -> pa.Table:
        col, row, own = (tile.column(c).to_numpy() for c in ("col", "row", "_own"))
        at = row - row.min(), col - col.min()
        there = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
        there[at] = True
        image = np.full(there.shape, np.nan)
        image[at] = tile.column(value).cast(pa.float64()).to_numpy()
        for side, radius, axes in passes:
            best, neutral = SIDES[side]
            # Places without a value or outside the raster are skipped.
            image = np.where(there & np.isfinite(image), image, neutral)
            for axis, a in enumerate(("row", "col")):
                if a in axes:
                    image = running(image, radius, best, neutral, axis)
        found = image[at][own]
        kept = tile.select(names).filter(pa.array(own))
        columns = [c.combine_chunks().cast(f.type) for c, f in zip(kept.columns, arrow)]
        return pa.Table.from_arrays([*columns, pa.array(np.where(np.isfinite(found), found, np.nan), pa.float64(), from_pandas=True)], schema=arrow)

    return copies.groupBy("_tx", "_ty").applyInArrow(run, schema)


def _swept(dense: DataFrame, value: str, out: str, sides: list[str], radius: int) -> DataFrame:
    """Square windows of half width ``radius``, one side after another."""
    if radius < 0:
        raise ValueError("the radius can't be negative")
    if radius * len(sides) <= WIDE:
        return _in_tiles(dense, value, out, [(side, radius, ("col", "row")) for side in sides])
    # A wide window would make tiles too large for a task: one axis at a time, in strips.
    for i, side in enumerate(sides):
        dense = _in_tiles(dense, value if i == 0 else "_side", "_axis", [(side, radius, ("col",))])
        dense = _in_tiles(dense, "_axis", "_next", [(side, radius, ("row",))]).drop("_axis", "_side").withColumnRenamed("_next", "_side")
    return dense.withColumnRenamed("_side", out)


def sliding_min(dense: DataFrame, value: str, radius: int, out: str = "sliding_min") -> DataFrame:
    """Minimum over the square of half width ``radius``; missing cells are skipped."""
    return _swept(dense, value, out, ["min"], radius)


def sliding_max(dense: DataFrame, value: str, radius: int, out: str = "sliding_max") -> DataFrame:
    return _swept(dense, value, out, ["max"], radius)


def opening(dense: DataFrame, value: str, radius: int, out: str = "opened") -> DataFrame:
    """Erosion then dilation of a dense grid, in one shuffle."""
    return _swept(dense, value, out, ["min", "max"], radius)


def join_cells(points: DataFrame, grid: DataFrame, cells: int, how: str = "left") -> DataFrame:
    """Join rows to their cell.  A raster of known small size is broadcast; a larger one
    is shuffled, and a cell holding a large share of the rows is split by the skew join."""
    side = F.broadcast(grid) if cells <= BROADCAST_CELLS else grid
    return points.join(side, ["col", "row"], how)
