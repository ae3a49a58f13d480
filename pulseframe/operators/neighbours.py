"""Radius and nearest-neighbour joins.

Plan shape.  Space is cut into square cells a hair wider than the radius, and
cells into blocks of ``b`` x ``b`` (4 to 32, as large as still gives every core work).  Each query row
is shuffled once to its block; each support row to its block and, when it lies
in the border cells, to the neighbouring blocks as well (a few percent of
copies).  Inside a block the query row is expanded to its 9 (or 27) adjacent
cells and hash joined on the cell with a distance residual.  The expansion and
the pairs never cross the network and grouping by query needs no further shuffle.

Where more than a quarter of the rows lie in blocks over ``max_block_rows``, all blocks
are made smaller (4 copies of a support row instead of 9 and more).  The others over the limit
are divided: every cell of such a block becomes a unit of its own, and the queries of a dense
cell are salted over several units which each see the cell's whole support.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.session import cut_lineage, stored, tune

BLOCK_CELLS = (32, 16, 8, 4)
SMALL_BLOCK = 2  # where too many blocks would have to be divided
MAX_BLOCK_ROWS = 2_000_000
# Candidate pairs one unit of work should not exceed; denser places are divided.
MAX_UNIT_PAIRS = 20_000_000
# Fixed value: the limit of the density check for callers that ask for one.
MAX_CANDIDATES = 200_000
# A first nearest-neighbour round with more candidates than this starts finer.
CROWDED = 20_000
# A first nearest-neighbour search reaches so many times as far as the mean density suggests, and is widened so often.
WIDER, WIDENINGS = 8.0, 3
# Rows of a unit of it, and pairs that would bound its blocks alike; pairs are made in bounded batches.
NEAREST_ROWS, NEAREST_PAIRS = 500_000, 2_000_000_000
# Points kept side by side in one cell row.
CELL_ROW_POINTS = 16_384
# A hot-cell list longer than this is shuffled instead of broadcast.
BROADCAST_ROWS = 200_000


class NeighbourhoodTooDense(ValueError):
    """Raised instead of truncating a neighbourhood."""


def cell_side(radius: float) -> float:
    """Cell width: the radius and a margin that absorbs floating-point rounding."""
    if not (radius > 0 and math.isfinite(radius)):
        raise ValueError("radius must be positive and finite")
    return radius * (1.0 + 1e-6) + 1e-6


def cell_index(column, side: float) -> Column:
    c = column if isinstance(column, Column) else F.col(column)
    return F.floor(c / F.lit(float(side))).cast("long")


def _floor_div(column: Column, n: int) -> Column:
    return F.floor(column / F.lit(float(n))).cast("long")


@dataclass
class NeighbourPlan:
    """How one radius join is laid out; the product of one counting pass."""

    radius: float
    dims: int
    rows: int
    max_candidates: int
    block_cells: int
    pieces: int  # parts a cell's points are kept in, 1 unless a cell is very dense
    hot_cells: DataFrame | None  # cx, cy, splits: cells of over-full blocks
    hot_blocks: DataFrame | None  # bx, by
    partitions: int | None = None  # shuffle partitions the pairs need, where the session has fewer
    pairs: float = 0.0  # candidate pairs to be expected
    spatial: bool = False  # queries of a hot cell are divided by place, not by a hash of their id

    @property
    def side(self) -> float:
        return cell_side(self.radius)

    @property
    def unit(self) -> tuple[str, ...]:
        """Columns that name one unit of work; a constant salt would be folded away, so it is absent."""
        return ("ux", "uy") if self.hot_blocks is None else ("ux", "uy", "us")


def _count_cells(points: DataFrame, side: float) -> DataFrame:
    return (points.select(cell_index("x", side).alias("cx"), cell_index("y", side).alias("cy"),
                          cell_index("z", side).alias("cz"))
            .groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n")))


def plan_neighbourhood(points: DataFrame, radius: float, dims: int | None = None,
                       max_candidates: int | None = None,
                       max_block_rows: int = MAX_BLOCK_ROWS, max_unit_pairs: int = MAX_UNIT_PAIRS, spatial: bool = False,
                       dense: int | None = None, dense_limits: dict | None = None) -> NeighbourPlan:
    """Count points per cell once: choose 2-D or 3-D cells, find hot blocks, guard density.

    From ``dense`` candidates per query on, ``dense_limits`` replace ``max_block_rows``, ``max_unit_pairs`` and ``spatial``.
    The pass aggregates on the map side and returns a handful of scalars.
    """
    spark = tune(points.sparkSession)
    side = cell_side(radius)
    base = BLOCK_CELLS[-1]
    counts = _count_cells(points, side)

    def by_block(cells: int) -> DataFrame:
        return counts.groupBy(_floor_div(F.col("cx"), cells).alias("bx"), _floor_div(F.col("cy"), cells).alias("by"))

    # Occupied columns of a small block fit in a bit mask: no second level of counting.
    local = F.expr(f"shiftleft(1L, int(pmod(cx, {base}) * {base} + pmod(cy, {base})))")
    n = F.col("n").cast("double")
    row = by_block(base).agg(
        F.sum("n").alias("n"), F.sum(n * n).alias("q3"), F.max("n").alias("top3"), F.bit_count(F.bit_or(local)).alias("columns")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum(n * n / F.col("columns")), F.lit(0.0)).alias("q2"), F.coalesce(F.sum("q3"), F.lit(0.0)).alias("q3"),
        F.coalesce(F.max("n"), F.lit(0)).alias("top_block"), F.coalesce(F.max("top3"), F.lit(0)).alias("top3"),
        F.coalesce(F.max(9.0 * n * n / F.col("columns")), F.lit(0.0)).alias("top_pairs"),
    ).first()
    if dims is None:
        # Expected probes + candidates per layout; the cheaper one wins.
        dims = 2 if 9.0 * (row.n + row.q2) <= 27.0 * (row.n + row.q3) else 3
    pairs = 9.0 * row.q2 if dims == 2 else 27.0 * row.q3
    if dense is not None and pairs > dense * row.n:
        max_block_rows, max_unit_pairs, spatial = (dense_limits[k] for k in ("max_block_rows", "max_unit_pairs", "spatial"))
    bound = 27 * row.top3
    if max_candidates is not None and bound > max_candidates:
        bound = max_cell_candidates(points, radius)
        if bound > max_candidates:
            raise NeighbourhoodTooDense(
                f"a neighbourhood of radius {radius:g} has {bound} candidates, limit {max_candidates}; "
                "use a smaller radius")
    busy = 8 * max(spark.sparkContext.defaultParallelism, 1)
    cells = next((b for b in BLOCK_CELLS if row.blocks * base * base >= busy * b * b and row.top_pairs * (b // base) ** 2 <= max_unit_pairs), base)
    hot_cells = hot_blocks = None
    hot = 0
    if row.top_block * (cells // base) ** 2 > max_block_rows or row.top_pairs * (cells // base) ** 2 > max_unit_pairs:
        for cells in (cells, SMALL_BLOCK):
            columns = counts.groupBy("cx", "cy").agg(F.sum("n").alias("n")).groupBy(
                _floor_div(F.col("cx"), cells).alias("bx"), _floor_div(F.col("cy"), cells).alias("by")).agg(
                F.sum("n").alias("n"), (9.0 * F.sum(n) * F.sum(n) / F.count(F.lit(1))).alias("pairs"))
            blocks = columns.where((F.col("n") > max_block_rows) | (F.col("pairs") > max_unit_pairs))
            hot, within = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            if spatial or within * 4 <= row.n:
                break
    if hot:
        hot_blocks = blocks.select("bx", "by")
        unit = max(1, max_block_rows // 16)
        hot_cells = (counts.groupBy("cx", "cy").agg(F.sum("n").alias("n")).withColumns({"bx": _floor_div(F.col("cx"), cells), "by": _floor_div(F.col("cy"), cells)})
                     .join(hot_blocks, ["bx", "by"], "left_semi")
                     .withColumn("splits", F.ceil(F.greatest(F.col("n") / F.lit(float(unit)), 9.0 * n * n / F.lit(float(max_unit_pairs)), F.lit(1.0))).cast("int"))
                     .select("cx", "cy", F.pow(F.ceil(F.sqrt("splits")), F.lit(2)).cast("int").alias("splits") if spatial else F.col("splits")))
        hot_cells, hot_blocks = cut_lineage(hot_cells), cut_lineage(hot_blocks)
        if hot * cells * cells <= BROADCAST_ROWS:
            hot_cells, hot_blocks = F.broadcast(hot_cells), F.broadcast(hot_blocks)
    pieces = max(1, math.ceil((row.top_block if dims == 2 else row.top3) / CELL_ROW_POINTS))
    # Units divided by place differ in work: two of them to a task at most, on average half of one.
    # A task may hold many units that a caller wants small.
    wanted = math.ceil(max(row.n / (max_block_rows if spatial else max(max_block_rows, MAX_BLOCK_ROWS)), pairs / ((0.5 if spatial else 10.0) * max_unit_pairs)))
    return NeighbourPlan(radius, dims, row.n, bound, cells, pieces, hot_cells, hot_blocks,
                         wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None, float(pairs), spatial)


def cell_candidates(points: DataFrame, radius: float, queries: DataFrame | None = None) -> DataFrame:
    """Candidates per occupied query cell: points in the 27 cells around it."""
    side = cell_side(radius)
    counts = _count_cells(points, side)
    spread = (counts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(26))))
              .select((F.col("cx") + F.expr("k div 9") - 1).alias("cx"),
                      (F.col("cy") + F.expr("(k div 3) % 3") - 1).alias("cy"),
                      (F.col("cz") + F.expr("k % 3") - 1).alias("cz"), "n"))
    totals = spread.groupBy("cx", "cy", "cz").agg(F.sum("n").alias("candidates"))
    occupied = (counts if queries is None else _count_cells(queries, side)).select("cx", "cy", "cz")
    return totals.join(occupied, ["cx", "cy", "cz"], "left_semi")


def max_cell_candidates(points: DataFrame, radius: float) -> int:
    return cell_candidates(points, radius).agg(F.max("candidates")).first()[0] or 0


def candidate_guard(points: DataFrame, radius: float, limit: int = MAX_CANDIDATES,
                    queries: DataFrame | None = None) -> DataFrame:
    """One row ``max_candidates, cells, over_limit``: the density check as a table."""
    return cell_candidates(points, radius, queries).agg(
        F.max("candidates").alias("max_candidates"), F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("candidates") > limit).alias("over_limit"))


def _place_queries(q: DataFrame, plan: NeighbourPlan) -> DataFrame:
    """Add the unit key ``ux, uy, us`` to query rows that carry ``qcell_x, qcell_y``."""
    bx, by = _floor_div(F.col("qcell_x"), plan.block_cells), _floor_div(F.col("qcell_y"), plan.block_cells)
    normal = q.withColumns({"ux": bx, "uy": by})
    if plan.hot_blocks is None:
        return normal
    normal = normal.withColumn("us", F.lit(-1))
    hot_key = [F.col("ux") == F.col("bx"), F.col("uy") == F.col("by")]
    normal = normal.join(plan.hot_blocks, hot_key, "left_anti")
    cells = plan.hot_cells.select(F.col("cx").alias("qcell_x"), F.col("cy").alias("qcell_y"), "splits")
    if plan.spatial:
        across = lambda a: F.least(F.floor((F.col(f"q_{a}") / F.lit(plan.side) - F.col(f"qcell_{a}")) * F.sqrt("splits")), F.sqrt("splits") - 1)
        part = across("x") * F.sqrt("splits") + across("y")
    else:
        part = F.pmod(F.xxhash64("q_id"), F.col("splits"))
    hot = (q.join(cells, ["qcell_x", "qcell_y"])
           .withColumn("ux", F.col("qcell_x")).withColumn("uy", F.col("qcell_y"))
           .withColumn("us", part.cast("int")).drop("splits"))
    return normal.unionByName(hot)


def _place_support(s: DataFrame, plan: NeighbourPlan) -> DataFrame:
    """Copy support rows that carry ``scell_x, scell_y`` to every unit that may need them."""
    def lo(c):
        return _floor_div(F.col(c) - 1, plan.block_cells)

    def hi(c):
        return _floor_div(F.col(c) + 1, plan.block_cells)

    normal = (s.withColumn("ux", F.explode(F.sequence(lo("scell_x"), hi("scell_x"))))
              .withColumn("uy", F.explode(F.sequence(lo("scell_y"), hi("scell_y")))))
    if plan.hot_blocks is None:
        return normal
    normal = normal.withColumn("us", F.lit(-1))
    normal = normal.join(plan.hot_blocks, [F.col("ux") == F.col("bx"), F.col("uy") == F.col("by")], "left_anti")
    cells = plan.hot_cells.select(F.col("cx").alias("ux"), F.col("cy").alias("uy"), "splits")
    hot = (s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
           .withColumn("ux", F.col("scell_x") + F.expr("k div 3") - 1)
           .withColumn("uy", F.col("scell_y") + F.expr("k % 3") - 1)
           .join(cells, ["ux", "uy"])
           .withColumn("us", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
           .drop("k", "splits"))
    return normal.unionByName(hot)


def paired(queries: DataFrame, support: DataFrame, plan: NeighbourPlan, few_queries: bool = False) -> DataFrame:
    """All (query, support) rows within the radius, co-partitioned by unit.

    ``few_queries`` first drops support rows of units without any query.

    ``queries`` needs ``q_id, q_x, q_y, q_z`` and ``support`` needs ``s_id, s_x,
    s_y, s_z``; further columns pass through.  A point meets itself: callers drop
    or discount the row where the ids are equal.  Adds ``dx, dy, dz, d2``.
    """
    side = plan.side
    axes = ("x", "y") if plan.dims == 2 else ("x", "y", "z")
    queries = queries.withColumns({f"qcell_{a}": cell_index(f"q_{a}", side) for a in axes})
    support = support.withColumns({f"scell_{a}": cell_index(f"s_{a}", side) for a in axes})
    queries, support = _place_queries(queries, plan), _place_support(support, plan)
    if few_queries:
        support = support.join(queries.select(*plan.unit).distinct(), list(plan.unit), "left_semi")
    parts = [plan.partitions] if plan.partitions else []
    queries, support = queries.repartition(*parts, *plan.unit), support.repartition(*parts, *plan.unit)
    # One row per occupied cell with its points side by side: a probe finds one row and
    # walks contiguous memory.  Very dense cells are divided into bounded pieces.
    cell = [f"scell_{a}" for a in axes]
    if plan.pieces > 1:
        support = support.withColumn("piece", F.pmod(F.xxhash64("s_id"), F.lit(plan.pieces)))
        cell.append("piece")
    columns = [c for c in support.columns if c not in plan.unit and c not in cell]
    support = support.groupBy(*plan.unit, *cell).agg(F.collect_list(F.struct(*columns)).alias("_points"))
    # Expansion after the shuffle: it stays inside the task.  Cells out of reach are skipped.
    width = 3 ** len(axes)
    queries = queries.withColumn("_k", F.explode(F.array(*[F.lit(i) for i in range(width)])))
    queries = queries.withColumns({f"qcell_{a}": F.expr(f"qcell_{a} + (_k div {3 ** i}) % 3 - 1") for i, a in enumerate(axes)})
    gaps = [f"greatest(qcell_{a} * {side!r}D - q_{a}, q_{a} - (qcell_{a} + 1) * {side!r}D, 0.0D)" for a in axes]
    queries = queries.where(" + ".join(f"{g} * {g}" for g in gaps) + f" <= {side * side!r}D")
    on = [queries[u] == support[u] for u in plan.unit] + [queries[f"qcell_{a}"] == support[f"scell_{a}"] for a in axes]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    keep = [queries[c] for c in queries.columns if c != "_k" and not c.startswith("qcell_")]
    joined = queries.join(support.hint("shuffle_hash"), condition).select(*keep, "_points")
    out = joined.select(*[c for c in joined.columns if c != "_points"], F.inline("_points"))
    near = " + ".join(f"(s_{a} - q_{a}) * (s_{a} - q_{a})" for a in "xyz")
    out = out.where(f"{near} <= {plan.radius * plan.radius!r}D")
    return out.selectExpr("*", *[f"s_{a} - q_{a} AS d{a}" for a in "xyz"], f"{near} AS d2")


def _parts(plan: NeighbourPlan, df: DataFrame) -> list[int]:
    """Few rows may be much work: their number of tasks isn't left to the size of the shuffle."""
    return [plan.partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if plan.pairs > MAX_UNIT_PAIRS else []


def met_by_unit(queries: DataFrame, support: DataFrame, plan: NeighbourPlan, function, schema, few_queries: int | None = None) -> DataFrame:
    """``function(queries, support)`` on the Arrow tables of each unit: all support rows within the radius of its queries and more.

    The layout is that of :func:`paired`; a unit's rows are bounded by the plan.  ``few_queries``, their number, first drops the support rows of
    cells without any query around.
    """
    queries = queries.withColumns({f"qcell_{a}": cell_index(f"q_{a}", plan.side) for a in "xy"})
    support = support.withColumns({f"scell_{a}": cell_index(f"s_{a}", plan.side) for a in "xy"})
    if few_queries is not None:
        near = queries.select("qcell_x", "qcell_y").distinct()
        for a in "xy":
            near = near.withColumn(f"qcell_{a}", F.explode(F.sequence(F.col(f"qcell_{a}") - 1, F.col(f"qcell_{a}") + 1)))
        near = near.select(F.col("qcell_x").alias("scell_x"), F.col("qcell_y").alias("scell_y")).distinct()
        support = support.join(F.broadcast(near) if few_queries * 9 <= BROADCAST_ROWS else near, ["scell_x", "scell_y"], "left_semi")
    queries, support = _place_queries(queries, plan), _place_support(support, plan)
    parts = _parts(plan, queries)
    queries, support = (df.repartition(*parts, *plan.unit).groupBy(*plan.unit) for df in (queries, support))
    return queries.cogroup(support).applyInArrow(function, schema)


def as_queries(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("point_id").alias("q_id"), *[F.col(a).cast("double").alias(f"q_{a}") for a in "xyz"],
                     *[F.col(c).alias(f"q_{c}") for c in extra if c not in ("x", "y", "z")])


def as_support(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("point_id").alias("s_id"), *[F.col(a).cast("double").alias(f"s_{a}") for a in "xyz"],
                     *[F.col(c).alias(f"s_{c}") for c in extra if c not in ("x", "y", "z")])


def radius_join(queries: DataFrame, support: DataFrame, radius: float, *, dims: int | None = None,
                plan: NeighbourPlan | None = None, q_columns: tuple[str, ...] = (), s_columns: tuple[str, ...] = (),
                max_candidates: int | None = None,
                max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Every pair with ``d2 <= r2``; a point never pairs with its own id, coincident ids do.

    Result: ``q_id, s_id, dx, dy, dz, d2`` and the requested ``q_*`` / ``s_*`` columns.
    A ``plan`` made for the same support and radius saves the counting pass.
    """
    plan = plan or plan_neighbourhood(support, radius, dims, max_candidates, max_block_rows)
    pairs = paired(as_queries(queries, *q_columns), as_support(support, *s_columns), plan)
    return (pairs.where(F.col("q_id") != F.col("s_id"))
            .select("q_id", "s_id", "dx", "dy", "dz", "d2",
                    *[f"q_{c}" for c in q_columns], *[f"s_{c}" for c in s_columns]))


def _box(df: DataFrame) -> dict[str, float]:
    return df.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{g}_{a}") for a in "xyz" for g, f in (("lo", F.min), ("hi", F.max))]).first().asDict()


def count_pyramid(support: DataFrame, corner: dict[str, float], side: float, levels: int) -> DataFrame:
    """``level, cx, cy, cz, n, lo_*, hi_*``: occupied cells of side ``side * 2**level`` with their points and extent."""
    finest = [F.floor((F.col(a) - F.lit(corner[a])) / F.lit(side)).cast("long").alias(f"c{a}") for a in "xyz"]
    cells = support.groupBy(*finest).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{g}_{a}") for a in "xyz" for g, f in (("lo", F.min), ("hi", F.max))])
    cells = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    above = [F.expr(f"shiftright(c{a}, level)").alias(f"c{a}") for a in "xyz"]
    return (cells.groupBy("level", *above).agg(F.sum("n").alias("n"), *[f(f"{g}_{a}").alias(f"{g}_{a}") for a in "xyz" for g, f in (("lo", F.min), ("hi", F.max))]))


def _own_levels(todo: DataFrame, pyramid: DataFrame, corner: dict[str, float], side: float, levels: int, enough: int) -> DataFrame:
    """Query rows with the ``level`` of the smallest cell around them that holds ``enough`` points, and what its sphere may hold at most (``near``)."""
    cells = [F.floor((F.col(a) - F.lit(corner[a])) / F.lit(side)).cast("long").alias(f"f{a}") for a in "xyz"]
    placed = todo.select("*", *cells)
    own = placed.select("fx", "fy", "fz").distinct()
    ladder = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({f"c{a}": F.expr(f"shiftright(f{a}, level)") for a in "xyz"})
    full = pyramid.where(F.col("n") >= enough).select("level", "cx", "cy", "cz")
    level = ladder.join(full, ["level", "cx", "cy", "cz"]).groupBy("fx", "fy", "fz").agg(F.min("level").alias("level"))
    # A sphere of 1.74 sides lies within the cells of double side around the query's; many queries share these.
    level = level.withColumn("up", F.col("level") + 1).withColumns({f"u{a}": F.expr(f"shiftright(f{a}, up)") for a in "xyz"})
    shared = ["up", "ux", "uy", "uz"]
    around = (level.select(*shared).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(26))))
              .select(*shared, *[F.expr(f"u{a} + (k div {3 ** i}) % 3 - 1").alias(f"c{a}") for i, a in enumerate("xyz")]))
    near = (around.join(pyramid.select(F.col("level").alias("up"), "cx", "cy", "cz", "n"), ["up", "cx", "cy", "cz"])
            .groupBy(*shared).agg(F.sum("n").alias("near")))
    return placed.join(level.join(near, shared).select("fx", "fy", "fz", "level", "near"), ["fx", "fy", "fz"], "left").drop("fx", "fy", "fz")


def _descended(crowded: DataFrame, support: DataFrame, pyramid: DataFrame, corner: dict[str, float], side: float, levels: int, enough: int) -> DataFrame:
    """``q_id, s_id, d2``: candidates of queries whose spheres would hold too many, found by going down the pyramid.

    A query keeps the cells that begin no farther than the distance within which the cells seen so far hold ``enough`` points for certain.
    """
    gap = " + ".join(f"pow(greatest(lo_{a} - q_{a}, q_{a} - hi_{a}, 0.0D), 2)" for a in "xyz")
    far = " + ".join(f"pow(greatest(hi_{a} - q_{a}, q_{a} - lo_{a}), 2)" for a in "xyz")
    front = crowded.select(F.col("point_id").alias("q_id"), *[F.col(a).cast("double").alias(f"q_{a}") for a in "xyz"], *[F.lit(0).cast("long").alias(f"p{a}") for a in "xyz"])
    query = ["q_id", "q_x", "q_y", "q_z"]
    reached = Window.partitionBy("q_id").orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(levels, -1, -1):
        cells = pyramid.where(F.col("level") == level).withColumns({f"p{a}": F.expr(f"shiftright(c{a}, 1)") if level < levels else F.lit(0).cast("long") for a in "xyz"})
        seen = (front.join(cells, ["px", "py", "pz"]).selectExpr(*query, "cx", "cy", "cz", "n", f"{gap} AS gap", f"{far} AS far")
                .withColumn("held", F.sum("n").over(reached)))
        bound = F.min(F.when(F.col("held") >= enough, F.col("far"))).over(Window.partitionBy("q_id"))
        front = cut_lineage(seen.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("gap") <= F.col("bound") * (1 + 1e-9)))
                            .select(*query, *[F.col(f"c{a}").alias(f"p{a}") for a in "xyz"]))
    cell = [F.floor((F.col(a) - F.lit(corner[a])) / F.lit(side)).cast("long").alias(f"p{a}") for a in "xyz"]
    points = support.select(F.col("point_id").alias("s_id"), *[F.col(a).cast("double").alias(f"s_{a}") for a in "xyz"], *cell)
    d2 = " + ".join(f"(s_{a} - q_{a}) * (s_{a} - q_{a})" for a in "xyz")
    return front.join(points, ["px", "py", "pz"]).selectExpr("q_id", "s_id", f"{d2} AS d2")


PAIR_COLUMNS = "q_id long, s_id long, d2 double, rank int, done boolean"
SUMMARY_COLUMNS = "q_id long, mean_distance double, coincident boolean, done boolean"


def _searched(queries: DataFrame, support: DataFrame, plan: NeighbourPlan, k: int, *, summary: bool = False, positive_only: bool = False,
              crowded: float = math.inf, final: bool = False, few_queries: int | None = None) -> DataFrame:
    """The ``k`` nearest points within the plan's radius, found unit by unit: ``PAIR_COLUMNS``, or a row per query of ``SUMMARY_COLUMNS``.

    A query that isn't done gives one row without a neighbour; with ``final`` all are done with what is there.  A table searched in itself is
    shuffled once.
    """
    from pulseframe.operators import nearest as ne
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    names = SUMMARY_COLUMNS if summary else PAIR_COLUMNS
    arrow, radius = to_arrow_schema(StructType.fromDDL(names)), plan.radius

    def numbers(table: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
        return (np.column_stack([table.column(f"{side}_{a}").to_numpy() for a in "xyz"]).astype(float).reshape(-1, 3),
                table.column(f"{side}_id").cast(pa.int64()).to_numpy())

    def made(q: np.ndarray, q_ids: np.ndarray, points: np.ndarray, ids: np.ndarray) -> pa.Table:
        row, found, d2, rank, done = ne.nearest(q, q_ids, points, ids, k, radius, positive_only=positive_only, crowded=crowded, final=final)
        if summary:
            n = np.bincount(row, minlength=len(q))
            mean = np.bincount(row, np.sqrt(d2), len(q)) / np.maximum(n, 1)
            columns = [q_ids, pa.array(mean, mask=n == 0), ne.coincident(q, q_ids, points, ids) if positive_only else np.zeros(len(q), bool), done]
        else:
            left = q_ids[~done]
            none = np.arange(len(row) + len(left)) >= len(row)
            pad = lambda v: pa.array(np.append(v, np.zeros(len(left), v.dtype)), mask=none)
            columns = [np.append(q_ids[row], left), pad(found), pad(d2), pad(rank), ~none]
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def alone(table: pa.Table) -> pa.Table:
        points, ids = numbers(table, "s")
        own = table.column("own").to_numpy()
        return made(points[own], ids[own], points, ids)

    if queries is not support or plan.hot_blocks is not None:
        return met_by_unit(as_queries(queries), as_support(support), plan, lambda q, s: made(*numbers(q, "q"), *numbers(s, "s")), names, few_queries)
    placed = _place_support(as_support(support).withColumns({f"scell_{a}": cell_index(f"s_{a}", plan.side) for a in "xy"}), plan)
    own = [F.col(f"u{a}").eqNullSafe(_floor_div(F.col(f"scell_{a}"), plan.block_cells)) for a in "xy"]
    placed = placed.withColumn("own", own[0] & own[1]).drop("scell_x", "scell_y")
    return placed.repartition(*_parts(plan, placed), *plan.unit).groupBy(*plan.unit).applyInArrow(alone, names)


def knn_join(queries: DataFrame, support: DataFrame, k: int, *, start_radius: float | None = None,
             positive_only: bool = False, crowded: int = CROWDED, within: float | None = None) -> DataFrame:
    """The ``k`` nearest support points per query, ties by id: ``q_id, s_id, d2, rank``.

    One search, unit by unit, at some times the radius that the mean density suggests finishes nearly all queries: with ``k`` hits inside it no
    closer point can lie outside.  A few are searched again with wider ones.  For what is left a pyramid of cell counts tells how far each must
    look: the smallest cell around a query that holds enough points.  They are searched level by level, each with its own radius.  A query
    whose sphere would hold more than ``crowded`` points (a far one before a dense place, say) goes down the pyramid instead and opens only the
    cells in which its nearest points can lie.  ``positive_only`` skips coincident points, ``within`` those farther away.
    """
    return _nearest(queries, support, k, False, start_radius, positive_only, crowded, within)


def knn_summary(queries: DataFrame, support: DataFrame, k: int, *, positive_only: bool = False, crowded: int = CROWDED, within: float | None = None) -> DataFrame:
    """``q_id, mean_distance, coincident`` over the neighbours of :func:`knn_join`, which are never rows; a row for every query.

    With ``positive_only``, ``coincident`` tells whether a point of another id lies in the query's very place.
    """
    return _nearest(queries, support, k, True, None, positive_only, crowded, within)


def _nearest(queries: DataFrame, support: DataFrame, k: int, summary: bool, start_radius: float | None, positive_only: bool, crowded: int,
             within: float | None) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    box = _box(support)
    if not box["n"]:
        raise ValueError("support is empty")
    same = queries is support
    q_box = box if same else _box(queries)
    both = {a: (min(v for v in (box[f"lo_{a}"], q_box[f"lo_{a}"]) if v is not None), max(v for v in (box[f"hi_{a}"], q_box[f"hi_{a}"]) if v is not None)) for a in "xyz"}
    reach = math.sqrt(sum((hi - lo) ** 2 for lo, hi in both.values())) * (1 + 1e-9) or 1.0
    if within is not None:
        reach = min(reach, within)
    ex, ey, ez = (float(box[f"hi_{a}"] - box[f"lo_{a}"]) for a in "xyz")
    if start_radius is None:
        area = max(ex * ey, max(ex, ey, ez) ** 2 * 1e-3) or 1.0
        start_radius = math.sqrt(2.0 * (k + 1) * area / (math.pi * box["n"]))
    radius = min(WIDER * start_radius, reach)
    many = max(crowded, 100 * k)

    def planned(radius: float) -> NeighbourPlan:
        return plan_neighbourhood(support, radius, 2, None, NEAREST_ROWS, NEAREST_PAIRS, True)

    # Where points crowd, the mean density suggests too wide a start: begin finer, so that
    # crowded queries finish early.
    plan = planned(radius)
    for _ in range(12):
        if plan.max_candidates <= many:
            break
        radius /= 4.0
        plan = planned(radius)
    columns = ["point_id", "x", "y", "z"]
    support = support.select(*columns)
    queries = support if same else queries.select(*columns)
    first = stored(_searched(queries, support, plan, k, summary=summary, positive_only=positive_only, crowded=many, final=radius >= reach))
    late = support.sparkSession.createDataFrame([], PAIR_COLUMNS).drop("done")
    if radius < reach:
        left = first.where("NOT done").select("q_id")
        late = _later(queries, left, support, k, radius, reach, positive_only, many, both, planned, late)
        if within is not None:
            late = late.where(F.col("d2") <= within * within)
    if not summary:
        return first.where("done").drop("done").unionByName(late)
    means = late.groupBy("q_id").agg(F.avg(F.sqrt("d2")).alias("mean_distance"))
    return (first.where("done").drop("done")
            .unionByName(first.where("NOT done").select("q_id", "coincident").join(means, "q_id", "left").select("q_id", "mean_distance", "coincident")))


def _later(queries: DataFrame, left: DataFrame, support: DataFrame, k: int, radius: float, reach: float, positive_only: bool, many: int, both: dict, planned,
           found: DataFrame) -> DataFrame:
    """The neighbours of the queries ``left``, whose nearest points lie beyond ``radius``."""
    side = radius / 2.0

    def rest(rows: DataFrame, left: DataFrame) -> tuple[DataFrame, int]:
        n = left.count()
        small = F.broadcast(left) if n <= BROADCAST_ROWS else left
        return cut_lineage(rows.join(small, F.col("point_id") == F.col("q_id"), "left_semi")) if n else rows, n

    todo, n = rest(queries, left)
    for _ in range(WIDENINGS):
        if not n or radius >= reach:
            break
        radius = min(2.0 * radius, reach)
        plan = planned(radius)
        if plan.max_candidates > NEAREST_ROWS:
            break
        wider = cut_lineage(_searched(todo, support, plan, k, positive_only=positive_only, crowded=many, final=radius >= reach, few_queries=n))
        found = found.unionByName(wider.where("done").drop("done"))
        todo, n = rest(todo, wider.where("NOT done").select("q_id"))
    if not n:
        return found
    # The query itself and points in its place may be among those counted: one more is needed, of different places if asked for.
    counted = support.dropDuplicates(["x", "y", "z"]) if positive_only else support
    corner = {a: lo for a, (lo, _) in both.items()}
    levels = max(1, math.ceil(math.log2(max(hi - lo for lo, hi in both.values()) / side + 1)) + 1)
    pyramid = cut_lineage(count_pyramid(counted, corner, side, levels))
    todo = cut_lineage(_own_levels(todo, pyramid, corner, side, levels, k + 1))
    # Without enough points anywhere every point is a neighbour.
    easy = todo.where(F.col("near") <= many)
    for level in sorted(r.level for r in easy.select("level").distinct().collect()):  # one row per level
        r = min(side * 2 ** level * math.sqrt(3.0) * (1 + 1e-9), reach)
        rows = easy.where(F.col("level") == level).select("point_id", "x", "y", "z")
        found = found.unionByName(_searched(rows, support, planned(r), k, positive_only=positive_only, final=True, few_queries=n).drop("done"))
    hard = todo.where(F.col("near").isNull() | (F.col("near") > many)).select("point_id", "x", "y", "z")
    if not hard.isEmpty():
        pairs = _descended(hard, support, pyramid, corner, side, levels, k + 1).where(F.col("q_id") != F.col("s_id"))
        order = Window.partitionBy("q_id").orderBy("d2", "s_id")
        pairs = (pairs.where(F.col("d2") > 0) if positive_only else pairs).withColumn("rank", F.row_number().over(order))
        found = found.unionByName(pairs.where(F.col("rank") <= k))
    return found
