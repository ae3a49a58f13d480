"""Tiles, halos, adaptive splits, ownership and the rules that size them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.scalar import clamp
from pulseframe.operators.neighbours import cell_index
from pulseframe.session import cut_lineage

# Fixed value: the metres added to a halo.
HALO_MARGIN = 0.002


@dataclass(frozen=True)
class TileGrid:
    """Half-open square tiles over a survey, closed on the outer edge."""

    x0: float
    y0: float
    x1: float
    y1: float
    side: float

    def __post_init__(self):
        values = (self.x0, self.y0, self.x1, self.y1, self.side)
        if not all(math.isfinite(v) for v in values) or self.side <= 0 or self.x1 < self.x0 or self.y1 < self.y0:
            raise ValueError("invalid grid bounds or side")
        if max(self.cols, self.rows) >= 2 ** 31:
            raise ValueError("tile numbers need 31 bits: increase the tile side")

    @property
    def cols(self) -> int:
        return max(1, math.ceil((self.x1 - self.x0) / self.side))

    @property
    def rows(self) -> int:
        return max(1, math.ceil((self.y1 - self.y0) / self.side))

    @classmethod
    def over(cls, df: DataFrame, side: float) -> "TileGrid":
        """Grid over the bounds of ``df`` (one aggregate)."""
        b = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
        if b.x0 is None:
            raise ValueError("no points")
        return cls(b.x0, b.y0, b.x1, b.y1, side)


def _slot(column: str, low: float, high: float, side: float, count: int) -> Column:
    c = F.col(column)
    index = F.least(F.floor((c - low) / side), F.lit(count - 1))
    return F.when((c >= low) & (c <= high), index).otherwise(-1).cast("int")


def assign_tile(df: DataFrame, grid: TileGrid) -> DataFrame:
    """Add ``tile_col, tile_row`` of the owning tile; -1 for both outside the survey."""
    col = _slot("x", grid.x0, grid.x1, grid.side, grid.cols)
    row = _slot("y", grid.y0, grid.y1, grid.side, grid.rows)
    inside = (col >= 0) & (row >= 0)
    return df.withColumns({"tile_col": F.when(inside, col).otherwise(-1).cast("int"),
                           "tile_row": F.when(inside, row).otherwise(-1).cast("int")})


def replicate_halo(df: DataFrame, grid: TileGrid, halo: float) -> DataFrame:
    """A copy of each point per tile whose box, grown by ``halo``, holds it; ``is_core`` marks the owner."""
    owned = assign_tile(df, grid).withColumnsRenamed({"tile_col": "_oc", "tile_row": "_or"})

    def reach(axis: str, low: float, high: float, count: int, name: str) -> Column:
        # One tile wider than the arithmetic says; the exact test follows.
        first = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor((F.col(axis) - halo - low) / grid.side).cast("int") - 1))
        last = F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor((F.col(axis) + halo - low) / grid.side).cast("int") + 1))
        return F.explode(F.filter(F.sequence(first, last), lambda t: F.col(axis).between(
            t * grid.side + low - halo, F.least(F.lit(high), t * grid.side + low + grid.side) + halo))).alias(name)

    wide = owned.select("*", reach("x", grid.x0, grid.x1, grid.cols, "tile_col"))
    wide = wide.select("*", reach("y", grid.y0, grid.y1, grid.rows, "tile_row"))
    core = (F.col("tile_col") == F.col("_oc")) & (F.col("tile_row") == F.col("_or"))
    return wide.withColumn("is_core", core).drop("_oc", "_or")


def tile_counts(df: DataFrame, grid: TileGrid, halo: float) -> DataFrame:
    """Core and context rows per tile."""
    # Replicate coordinates only; the counts need nothing else.
    return (replicate_halo(df.select("x", "y"), grid, halo).groupBy("tile_col", "tile_row")
            .agg(F.count_if("is_core").alias("core_points"), F.count(F.lit(1)).alias("context_points")))


def adaptive_tiles(df: DataFrame, grid: TileGrid, cap: int, halo: float, *, min_side: float = 1.0,
                   max_depth: int = 12) -> DataFrame:
    """Leaves of a quadtree under each tile whose core plus halo holds at most ``cap`` rows.

    Only counts per node travel.  A level counts the nodes still too large and
    splits them; points are never moved.  Refuses when a node at the smallest
    side still exceeds the cap.  Result: ``tile_id, left, bottom, right, top,
    close_right, close_top, core_points, context_points``.
    """
    pts = df.select("x", "y")
    spark = df.sparkSession
    occupied = tile_counts(pts, grid, halo).where(F.col("core_points") > 0)
    left, bottom = F.col("tile_col") * grid.side + grid.x0, F.col("tile_row") * grid.side + grid.y0
    level = cut_lineage(occupied.select(
        F.concat_ws("_", "tile_col", "tile_row").alias("tile_id"), left.alias("left"), bottom.alias("bottom"),
        F.least(F.lit(grid.x1), left + grid.side).alias("right"), F.least(F.lit(grid.y1), bottom + grid.side).alias("top"),
        (F.col("tile_col") == grid.cols - 1).alias("close_right"), (F.col("tile_row") == grid.rows - 1).alias("close_top"),
        "core_points", "context_points"))
    leaves = None
    bin_side = grid.side
    for depth in range(max_depth + 1):
        done = level.where(F.col("context_points") <= cap)
        leaves = done if leaves is None else leaves.unionByName(done)
        big = level.where(F.col("context_points") > cap)
        worst = big.agg(F.count(F.lit(1)).alias("n"), F.min(F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"))).alias("side")).first()
        if not worst.n:
            return leaves
        if worst.side <= min_side or depth == max_depth:
            raise ValueError(f"{worst.n} cells of side {worst.side:g} still hold more than {cap} points with their halo")
        bin_side = max(bin_side / 2.0, halo)
        mx, my = F.col("left") + (F.col("right") - F.col("left")) / 2.0, F.col("bottom") + (F.col("top") - F.col("bottom")) / 2.0
        quarters = big.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"mx": mx, "my": my})
        east, north = F.col("k") % 2 == 1, F.col("k") >= 2
        quarters = quarters.select(
            F.concat("tile_id", F.lit("."), F.col("k").cast("string")).alias("tile_id"),
            F.when(east, F.col("mx")).otherwise(F.col("left")).alias("left"), F.when(north, F.col("my")).otherwise(F.col("bottom")).alias("bottom"),
            F.when(east, F.col("right")).otherwise(F.col("mx")).alias("right"), F.when(north, F.col("top")).otherwise(F.col("my")).alias("top"),
            (F.col("close_right") & east).alias("close_right"), (F.col("close_top") & north).alias("close_top"))
        # Nodes listed per bin of the current side; points equi-join on their bin.
        def bins(a: str, b: str, low: float) -> Column:
            return F.sequence(F.floor((F.col(a) - halo - low) / bin_side).cast("long"), F.floor((F.col(b) + halo - low) / bin_side).cast("long"))
        listed = (quarters.withColumn("bc", F.explode(bins("left", "right", grid.x0)))
                  .withColumn("br", F.explode(bins("bottom", "top", grid.y0))))
        binned = pts.withColumns({"bc": F.floor((F.col("x") - grid.x0) / bin_side).cast("long"),
                                  "br": F.floor((F.col("y") - grid.y0) / bin_side).cast("long")})
        x, y = F.col("x"), F.col("y")
        context = x.between(F.col("left") - halo, F.col("right") + halo) & y.between(F.col("bottom") - halo, F.col("top") + halo)
        core = ((x >= F.col("left")) & (y >= F.col("bottom"))
                & ((x < F.col("right")) | (F.col("close_right") & (x == F.col("right"))))
                & ((y < F.col("top")) | (F.col("close_top") & (y == F.col("top")))))
        names = ["tile_id", "left", "bottom", "right", "top", "close_right", "close_top"]
        level = cut_lineage(binned.join(listed, ["bc", "br"]).where(context).groupBy(*names)
                            .agg(F.count_if(core).alias("core_points"), F.count(F.lit(1)).alias("context_points"))
                            .where(F.col("core_points") > 0))
    return leaves


def suggest_side(profile: DataFrame) -> DataFrame:
    """Tile side from ``points, area, halo, bytes_per_point, budget``: add ``tile_side``."""
    usable = (F.col("budget") - 268435456) / F.col("bytes_per_point") * 0.55
    side = F.sqrt(usable / (F.col("points") / F.col("area"))) - 2 * F.col("halo")
    known = (F.col("points") > 0) & (F.col("area") > 0) & (F.col("bytes_per_point") > 0) & (F.col("budget") > 268435456)
    return profile.withColumn("tile_side", F.when(known, clamp(F.floor(side / 5) * 5.0, 5.0, 100.0)).otherwise(25.0))


def voxel(df: DataFrame, size: float = 1.0) -> DataFrame:
    return df.withColumns({f"v{a}": cell_index(a, size) for a in "xyz"})


def to_global(df: DataFrame, scale: float, shift: tuple[float, float, float]) -> DataFrame:
    """Local coordinates to survey coordinates: ``local / scale - shift``."""
    if not (scale > 0 and math.isfinite(scale)):
        raise ValueError("scale must be positive")
    return df.withColumns({a: F.col(a) / scale - s for a, s in zip("xyz", shift)})


def verify_ownership(df: DataFrame, owned: DataFrame) -> DataFrame:
    """Counts of source rows, owned rows, ids without owner, with several, and unknown ids."""
    a = df.select("point_id", F.lit(1).alias("s"), F.lit(0).alias("o"))
    b = owned.select("point_id", F.lit(0).alias("s"), F.lit(1).alias("o"))
    per = a.unionByName(b).groupBy("point_id").agg(F.sum("s").alias("s"), F.sum("o").alias("o"))
    return per.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("o"), F.lit(0)).alias("owned_rows"),
        F.count_if((F.col("s") > 0) & (F.col("o") == 0)).alias("missing_ids"),
        F.count_if(F.col("o") > 1).alias("repeated_ids"), F.count_if(F.col("s") == 0).alias("unknown_ids"))


# Descriptor lists of the two reduced profiles.
BALANCED = ("neighbor_count", "linearity", "planarity", "sphericity", "eigenentropy", "surface_variation",
            "verticality", "roughness", "z_range", "z_standard_deviation", "z_above_minimum", "z_below_maximum")
FAST = ("neighbor_count", "linearity", "planarity", "surface_variation", "verticality", "roughness",
        "z_range", "z_standard_deviation")


def feature_profile(profile: str, descriptors, radii) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """Descriptors and radii of a profile: ``current``, ``balanced`` (12 x 3) or ``fast`` (8 x 2)."""
    if profile == "current":
        return tuple(descriptors), tuple(radii)
    distinct = sorted({float(r) for r in radii if math.isfinite(r) and r > 0})
    if profile == "balanced":
        return BALANCED, tuple(distinct[:3])
    if profile == "fast":
        return FAST, tuple(distinct[:2])
    raise ValueError(f"unknown profile {profile!r}")


def tile_with_radius(radius: float) -> float:
    """Halo a tile needs so that its core rows see whole neighbourhoods."""
    return radius + HALO_MARGIN
