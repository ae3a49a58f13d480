"""Connected voxel structures and the semantic class rules built on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulseframe.functions.scalar import finite_or_null
from pulseframe.operators.neighbours import cell_index
from pulseframe.operators.rules import height_class
from pulseframe.session import cut_lineage

ROOF, WALL, POLE, WIRE, BUILDING = 128, 129, 130, 131, 6
VOXEL = ("vx", "vy", "vz")


@dataclass(frozen=True)
class StructureRules:
    """Default thresholds of the structure rules."""

    planar_fine: float = 0.65
    planar_coarse: float = 0.45
    structure_sphericity: float = 0.12
    coarse_sphericity: float = 0.20
    vegetation_sphericity: float = 0.18
    vegetation_planarity_max: float = 0.60
    wall_normal_max: float = 0.25
    roof_normal_min: float = 0.35
    low_height: float = 2.0
    medium_height: float = 5.0
    minimum_wall_height: float = 2.0
    minimum_wall_span: float = 2.0
    minimum_roof_width: float = 2.0
    minimum_component_cells: int = 12
    minimum_wall_cells: int = 3
    minimum_roof_cells: int = 6

    def check(self) -> None:
        shares = (self.planar_fine, self.planar_coarse, self.structure_sphericity, self.coarse_sphericity,
                  self.vegetation_sphericity, self.vegetation_planarity_max, self.wall_normal_max, self.roof_normal_min)
        if not all(0 <= s <= 1 for s in shares) or self.wall_normal_max >= self.roof_normal_min:
            raise ValueError("geometry thresholds must lie in 0..1 and separate walls from roofs")
        if not 0.15 <= self.low_height < self.medium_height:
            raise ValueError("height bands must increase from 0.15")

    def strict(self) -> "StructureRules":
        return replace(self, planar_fine=max(0.75, self.planar_fine), planar_coarse=max(0.60, self.planar_coarse),
                       structure_sphericity=min(0.08, self.structure_sphericity), coarse_sphericity=min(0.12, self.coarse_sphericity),
                       minimum_wall_span=max(3.0, self.minimum_wall_span), minimum_roof_width=max(3.0, self.minimum_roof_width))


def last_return() -> Column:
    r, n = finite_or_null("return_number"), finite_or_null("number_of_returns")
    return F.coalesce((r >= 1) & (n >= 1) & (r == F.floor(r)) & (n == F.floor(n)) & (r == n), F.lit(False))


def planar_support(rules: StructureRules) -> Column:
    return F.coalesce((F.col("planarity_r2") >= rules.planar_fine) & (F.col("sphericity_r2") <= rules.structure_sphericity)
                      & (F.col("planarity_r4") >= rules.planar_coarse) & (F.col("sphericity_r4") <= rules.coarse_sphericity), F.lit(False))


def with_voxel(df: DataFrame, size: float = 1.0) -> DataFrame:
    return df.withColumns({v: cell_index(a, size) for v, a in zip(VOXEL, "xyz")})


def patches(df: DataFrame, rules: StructureRules = StructureRules()) -> DataFrame:
    """Voxels of planar non-ground last returns with their ``wall`` and ``roof`` point counts."""
    normal = F.col("normal_z_absolute_r2")
    planar = planar_support(rules) & last_return() & ~F.coalesce(F.col("is_ground"), F.lit(False))
    wall, roof = normal.between(0.0, rules.wall_normal_max), normal.between(rules.roof_normal_min, 1.0)
    return (with_voxel(df.where(planar & (wall | roof))).groupBy(*VOXEL)
            .agg(F.count_if(wall).alias("wall"), F.count_if(roof).alias("roof")))


BLOCK = 32  # voxels along a block
HALF = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


def joined_sets(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Disjoint sets of ``0..n-1`` under the edges ``a, b``: each element's smallest member.

    Roots hang on smaller roots, then every path is halved; all edges move at once.
    """
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            return root
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(shorter := root[root], root):
            root = shorter
        a, b = a[open_], b[open_]


def components(cells: DataFrame, kind: str | None = None, *, block: int = BLOCK, max_rounds: int = 60) -> DataFrame:
    """26-neighbour connected components of voxels: ``vx, vy, vz, component``.

    ``kind`` (a small integer column) keeps sets of voxels apart, so that several
    sets are labelled in one run.  Voxels meet in spatial blocks, where disjoint sets join them in
    one task.  Only edges between blocks are left, and of those only what they say of the blocks' sets: these few are settled by star
    contraction, whose minima combine on the map side.  A component of any size is never gathered.
    Fails, rather than returning partial labels, when ``max_rounds`` does not suffice.
    """
    key = ([kind] if kind else []) + list(VOXEL)
    cells = cells.select(*key).distinct()
    box = cells.agg(*[f(v).alias(f"{g}{v}") for v in key for g, f in (("lo_", F.min), ("hi_", F.max))]).first()
    if box.lo_vx is None:
        return cells.withColumn("component", F.lit(None).cast("long"))
    nx, ny, nz = (box[f"hi_{v}"] - box[f"lo_{v}"] + 3 for v in VOXEL)
    kinds = box[f"hi_{kind}"] - box[f"lo_{kind}"] + 1 if kind else 1
    if kinds * nx * ny * nz >= 2 ** 63:
        raise ValueError("voxel range too large to number")
    # A free layer on each side keeps neighbours from wrapping around.
    text = f"(vx - {box.lo_vx - 1}L)"
    if kind:
        text = f"(({kind} - {box[f'lo_{kind}']}L) * {nx}L + {text})"
    number = F.expr(f"({text} * {ny}L + (vy - {box.lo_vy - 1}L)) * {nz}L + (vz - {box.lo_vz - 1}L)")
    steps = [i * ny * nz + j * nz + k for i, j, k in HALF]

    def label(table: pa.Table) -> pa.Table:
        u = table.column("u").to_numpy()
        order = np.argsort(u)
        numbers, ends = u[order], []
        for step in steps:
            at = np.minimum(np.searchsorted(numbers, numbers + step), len(numbers) - 1)
            near = np.flatnonzero(numbers[at] == numbers + step)
            ends.append((near, at[near]))
        root = joined_sets(len(numbers), *(np.concatenate(e) for e in zip(*ends)))
        found = np.empty(len(u), np.int64)
        found[order] = numbers[root]
        return table.select([*key, "u"]).append_column("part", pa.array(found))

    numbered = cells.withColumn("u", number)
    of_block = [F.floor(F.col(v) / block).alias(f"b{v}") for v in VOXEL]
    schema = T.StructType([*[f for f in numbered.schema.fields], T.StructField("part", T.LongType())])
    nodes = cut_lineage(numbered.groupBy(*([kind] if kind else []), *of_block).applyInArrow(label, schema))
    # Edges that leave a block, between the sets they join.
    rim = " OR ".join(f"pmod({v}, {block}) IN (0, {block - 1})" for v in VOXEL)
    border = nodes.where(rim)
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{v}") for o, v in zip(h, VOXEL)], F.lit(s).cast("long").alias("step")) for h, s in zip(HALF, steps)])
    leaves = " OR ".join(f"floor(({v} + o.o{v}) / {block}) <> floor({v} / {block})" for v in VOXEL)
    out = border.withColumn("o", F.explode(offsets)).where(leaves).select(F.col("part").alias("a"), (F.col("u") + F.col("o.step")).alias("v"))
    edges = cut_lineage(out.join(border.select(F.col("u").alias("v"), F.col("part").alias("b")), "v").where("a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.isEmpty():
        return nodes.select(*key, F.col("part").alias("component"))
    roots = _star_roots(edges, max_rounds)
    return nodes.join(roots, "part", "left").select(*key, F.coalesce("component", "part").alias("component"))


def _star_roots(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``part, component`` of the ends of ``edges(u, v)``: each round hangs every node on the smallest it can see, first
    for its larger neighbours, then for its smaller ones."""
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # Settled when every node hangs on exactly one root and no root hangs on another.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        loose = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR (hangs = 1 AND holds = 1)")
        if loose.isEmpty():
            return edges.select(F.col("u").alias("part"), F.col("v").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def accept_structures(cells: DataFrame, rules: StructureRules = StructureRules()) -> DataFrame:
    """Components (``component`` with ``wall, roof`` per voxel) with coherent wall and roof support.

    One row per component with its measures and ``accepted``.
    """
    wall, roof = F.col("wall") >= 3, F.col("roof") >= 3

    def span(mask: Column, v: str) -> Column:
        return F.max(F.when(mask, F.col(v))) - F.min(F.when(mask, F.col(v)))

    per = cells.groupBy("component").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(wall).alias("wall_cells"), F.count_if(roof).alias("roof_cells"),
        span(wall, "vz").alias("wall_height"), F.greatest(span(wall, "vx"), span(wall, "vy")).alias("wall_span"),
        F.least(span(roof, "vx"), span(roof, "vy")).alias("roof_width"))
    ok = ((F.col("cells") >= rules.minimum_component_cells) & (F.col("wall_cells") >= rules.minimum_wall_cells)
          & (F.col("roof_cells") >= rules.minimum_roof_cells) & (F.col("wall_height") >= rules.minimum_wall_height)
          & (F.col("wall_span") >= rules.minimum_wall_span) & (F.col("roof_width") >= rules.minimum_roof_width))
    return per.withColumn("accepted", F.coalesce(ok, F.lit(False)))


# Two-scale evidence of a linear object, and of its wire and pole kinds.
LINEAR_TEXT = ("hag >= 0.15D AND linearity_r2 >= 0.85D AND linearity_r4 >= 0.75D AND sphericity_r2 <= 0.08D"
               " AND sphericity_r4 <= 0.10D AND planarity_r2 < 0.25D")
WIRE_TEXT = "hag >= 2 AND z_range_r2 BETWEEN 0 AND 1 AND z_range_r4 BETWEEN 0 AND 2"
POLE_TEXT = "z_range_r2 >= 2.5D AND z_range_r4 >= 3"


def linear_cells(df: DataFrame) -> DataFrame:
    """Voxels of linear non-ground points: ``kind`` (wire / pole), lowest and highest HAG."""
    kind = F.expr(f"CASE WHEN {WIRE_TEXT} THEN 'wire' WHEN {POLE_TEXT} THEN 'pole' END")
    hit = df.where(F.expr(f"NOT coalesce(is_ground, false) AND {LINEAR_TEXT}")).withColumn("kind", kind).where("kind IS NOT NULL")
    return with_voxel(hit).groupBy("kind", *VOXEL).agg(F.min("hag").alias("low"), F.max("hag").alias("high"))


STRUCTURE_KIND, WIRE_KIND, POLE_KIND = 0, 1, 2


def _evidence(df: DataFrame, rules: StructureRules, structures: bool, linear: bool) -> DataFrame:
    """Voxels with evidence, one row per kind: planar counts or height span."""
    parts = []
    if structures:
        parts.append(patches(df, rules).select(F.lit(STRUCTURE_KIND).alias("k"), *VOXEL, "wall", "roof", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    if linear:
        parts.append(linear_cells(df).select(F.when(F.col("kind") == "wire", WIRE_KIND).otherwise(POLE_KIND).alias("k"), *VOXEL,
                                             F.lit(0).cast("long").alias("wall"), F.lit(0).cast("long").alias("roof"), "low", "high"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def accepted_cells(df: DataFrame, rules: StructureRules = StructureRules(), *, structures: bool = True, linear: bool = True) -> DataFrame:
    """Voxels of accepted objects: ``vx, vy, vz, kind`` (structure, wire, pole).

    All kinds are labelled in one component run.  A pole must reach an accepted
    wire within two voxels of its top.
    """
    cells = cut_lineage(_evidence(df, rules, structures, linear))
    labelled = cells.join(components(cells, "k"), ["k", *VOXEL])
    parts = []
    if structures:
        mine = labelled.where(F.col("k") == STRUCTURE_KIND)
        parts.append(mine.join(accept_structures(mine, rules).where("accepted"), "component", "left_semi").select(*VOXEL, F.lit("structure").alias("kind")))
    if linear:
        spans = labelled.where(F.col("k") != STRUCTURE_KIND).groupBy("k", "component").agg(
            F.count(F.lit(1)).alias("n"), *[(F.max(v) - F.min(v)).alias("d" + v[1]) for v in VOXEL],
            F.max("vz").alias("top"), F.min("low").alias("low"), F.max("high").alias("high"))
        long_wire = spans.where(f"k = {WIRE_KIND} AND n >= 12 AND greatest(dx, dy) >= 12 AND least(dx, dy) <= greatest(4.0D, greatest(dx, dy) * 0.2D)"
                                " AND dz <= greatest(dx, dy) * 0.25D + 1")
        wires = cut_lineage(labelled.join(long_wire, "component", "left_semi").select(*VOXEL))
        slim = spans.where(f"k = {POLE_KIND} AND n >= 4 AND dz >= 3 AND dx <= 1 AND dy <= 1 AND low <= 0.75D AND high >= 3")
        poles = labelled.where(F.col("k") == POLE_KIND)
        tops = poles.join(slim.select("component", "top"), "component").where(F.col("vz") >= F.col("top") - 1)
        steps = F.sequence(F.lit(-2), F.lit(2))
        around = (tops.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("h", F.explode(steps))
                  .select("component", (F.col("vx") + F.col("i")).alias("vx"), (F.col("vy") + F.col("j")).alias("vy"), (F.col("vz") + F.col("h")).alias("vz")))
        held = around.join(wires, list(VOXEL), "left_semi").select("component").distinct()
        parts.append(wires.withColumn("kind", F.lit("wire")))
        parts.append(poles.join(held, "component", "left_semi").select(*VOXEL, F.lit("pole").alias("kind")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def structure_cells(df: DataFrame, rules: StructureRules = StructureRules()) -> DataFrame:
    """Voxels of accepted wall-and-roof components."""
    return accepted_cells(df, rules, linear=False).select(*VOXEL)


def linear_objects(df: DataFrame) -> DataFrame:
    """Voxels of accepted wires and of poles that meet one at their top: ``vx, vy, vz, kind``."""
    return accepted_cells(df, structures=False)


def semantic_classify(df: DataFrame, requested: set[int], rules: StructureRules = StructureRules(),
                      selection: Column | None = None) -> DataFrame:
    """Add ``semantic_class, semantic_score, semantic_reason``; only requested classes are given.

    Ground stays 2.  Rows outside ``selection`` get class -1 and reason 0.
    """
    rules.check()
    linear = bool(requested & {POLE, WIRE})
    # One row per voxel, so that the points are joined once.
    kind = F.col("kind")
    flags = accepted_cells(df, rules, linear=linear).groupBy(*VOXEL).agg(
        F.bool_or(kind == "structure").alias("_s"), F.bool_or(kind == "wire").alias("_w"), F.bool_or(kind == "pole").alias("_p"))
    df = with_voxel(df).join(flags, list(VOXEL), "left").drop(*VOXEL)

    def asked(code) -> str:
        return "true" if code in requested else "false"

    fine = f"planarity_r2 >= {rules.planar_fine!r}D"
    df = df.withColumns({"_last": last_return(), "_planar": planar_support(rules), "_g": F.coalesce(F.col("is_ground"), F.lit(False))})
    df = df.selectExpr(
        "*", "_last AND coalesce(_s, false) AND _planar AS _struct",
        f"CASE WHEN normal_z_absolute_r2 <= {rules.wall_normal_max!r}D THEN {WALL} WHEN normal_z_absolute_r2 >= {rules.roof_normal_min!r}D THEN {ROOF} ELSE 1 END AS _surface")
    named = " OR ".join(f"_surface = {c}" for c in (1, ROOF, WALL) if c in requested) or "false"
    df = df.selectExpr(
        "*", f"CASE WHEN _struct AND ({named}) THEN _surface WHEN _struct AND _surface <> 1 AND {asked(BUILDING)} THEN {BUILDING} ELSE 1 END AS _l1",
        f"CASE WHEN NOT _struct THEN 8 WHEN ({named}) OR (_surface <> 1 AND {asked(BUILDING)}) THEN CASE WHEN _surface = {WALL} THEN 3 ELSE 2 END ELSE 9 END AS _r1")
    df = df.selectExpr("*", "CASE WHEN _r1 IN (2, 3) THEN 0.8D ELSE 0.0D END AS _c1")
    wire = f"{LINEAR_TEXT} AND coalesce(_w, false) AND {WIRE_TEXT}" if linear and WIRE in requested else "false"
    pole = f"{LINEAR_TEXT} AND coalesce(_p, false) AND {POLE_TEXT}" if linear and POLE in requested else "false"
    df = df.selectExpr("*", f"CASE WHEN _l1 = 1 AND coalesce({wire}, false) THEN {WIRE} WHEN _l1 = 1 AND coalesce({pole}, false) THEN {POLE} ELSE _l1 END AS _l2")
    low = f"{rules.vegetation_sphericity!r}D"
    high = f"{rules.vegetation_planarity_max!r}D"
    df = df.selectExpr(
        "*", f"_l2 = 1 AND coalesce(sphericity_r2 >= {low} AND sphericity_r4 >= {low} AND planarity_r2 < {high} AND planarity_r4 < {high}, false) AS _disp",
        "coalesce(hag >= 0.15D, false) AS _high")
    df = df.withColumn("_veg", height_class(F.col("hag"), rules.low_height, rules.medium_height))
    given = ", ".join(str(c) for c in (3, 4, 5) if c in requested) or "-1"
    df = df.selectExpr(
        "*", f"CASE WHEN _disp AND _high AND _veg IN ({given}) THEN _veg ELSE _l2 END AS _l3",
        f"CASE WHEN _l2 = {WIRE} THEN 6 WHEN _l2 = {POLE} THEN 7 WHEN _disp AND _high AND _veg IN ({given}) THEN 4"
        " WHEN _disp AND _high THEN 9 WHEN _disp THEN 5 ELSE _r1 END AS _r3",
        f"CASE WHEN _l2 IN ({WIRE}, {POLE}) THEN 0.75D WHEN _disp AND _high AND _veg IN ({given}) THEN 0.7D ELSE _c1 END AS _c3",
        "planarity_r2 IS NULL OR planarity_r4 IS NULL OR sphericity_r2 IS NULL OR sphericity_r4 IS NULL"
        f" OR (normal_z_absolute_r2 IS NULL AND {fine}) AS _miss")
    df = df.selectExpr("*", f"CASE WHEN _l3 = 1 AND _r3 = 8 AND coalesce({fine}, false) THEN CASE WHEN _last THEN 11 ELSE 10 END ELSE _r3 END AS _r4")
    outside = F.lit(False) if selection is None else ~F.coalesce(selection, F.lit(False))
    df = df.withColumn("_out", outside).selectExpr(
        "*", "CASE WHEN _out THEN -1 WHEN _g THEN 2 WHEN _miss THEN 1 ELSE _l3 END AS semantic_class",
        "CASE WHEN _out THEN 0.0D WHEN _g THEN 1.0D WHEN _miss THEN 0.0D ELSE _c3 END AS semantic_score",
        "CASE WHEN _out THEN 0 WHEN _g THEN 1 WHEN _miss THEN 12 ELSE _r4 END AS semantic_reason")
    return df.drop("_s", "_w", "_p", "_last", "_planar", "_g", "_struct", "_surface", "_l1", "_r1", "_c1", "_l2", "_disp",
                   "_high", "_veg", "_l3", "_r3", "_c3", "_miss", "_r4", "_out")


def clean_buildings(df: DataFrame, *, strict: bool = False, aggressive: bool = False, current_hag: bool = True,
                    rules: StructureRules = StructureRules(), working: str = "working_class", selection: Column | None = None) -> DataFrame:
    """Review of building classes: add ``clean_status`` 0..5 and ``clean_proposal`` (NULL = keep).

    1 coherent structure kept, 2 canopy suspect, 3 known non-last return, 4 weak
    support (changed only when aggressive), 5 missing geometry kept.
    """
    rules = rules.strict() if strict else rules
    df = semantic_classify(df, {BUILDING, 3, 4, 5}, rules, selection)
    r, n = finite_or_null("return_number"), finite_or_null("number_of_returns")
    df = df.withColumn("_mid", F.coalesce((r >= 1) & (n >= 1) & (r == F.floor(r)) & (n == F.floor(n)) & (r < n), F.lit(False)))
    target = f"semantic_class >= 0 AND NOT coalesce(is_ground, false) AND coalesce({working} IN ({BUILDING}, {ROOF}, {WALL}), false)"
    df = df.selectExpr("*", f"CASE WHEN NOT ({target}) THEN 0 WHEN semantic_class = {BUILDING} THEN 1"
                       " WHEN semantic_class IN (3, 4, 5) OR semantic_reason = 5 THEN 2 WHEN _mid THEN 3 WHEN semantic_reason = 12 THEN 5 ELSE 4 END AS clean_status")
    canopy = "CASE WHEN semantic_class IN (3, 4, 5) THEN semantic_class ELSE 1 END" if current_hag else "1"
    return df.selectExpr("*", f"CASE clean_status WHEN 2 THEN {canopy} WHEN 3 THEN 1 WHEN 4 THEN {'1' if aggressive else 'NULL'} END AS clean_proposal").drop("_mid")


def cleaning_tally(cleaned: DataFrame) -> DataFrame:
    """Rows and proposed changes per cleaning status."""
    return cleaned.groupBy("clean_status").agg(F.count(F.lit(1)).alias("n"), F.count("clean_proposal").alias("changes"))
