"""Queries over sources, selections, tiling, profiles and scalar helpers."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from pulseframe.functions import scalar as fn
from pulseframe.operators import attach, profile as pr, ranking, selection as se, tiling as ti
from pulseframe.operators.features import compute_features
from pulseframe.plans.registry import d, query, r
from pulseframe.plans.views import labelled_view, points_view, scene_view, table
from pulseframe.session import shared_folder
from pulseframe.sources import points as src, sinks

GAPS = "CASE WHEN point_id % 97 = 0 THEN {nan} WHEN point_id % 89 = 0 THEN {inf} ELSE z END"
SPARK_GAPS = GAPS.format(nan="double('NaN')", inf="double('Infinity')")
DUCK_GAPS = GAPS.format(nan="'nan'::DOUBLE", inf="'inf'::DOUBLE")


@query("read_points_clean", f"""WITH g AS (SELECT *, {DUCK_GAPS} AS w FROM pts)
SELECT point_id, {d('x')} AS x, CASE WHEN isfinite(w) THEN {d('w')} END AS w FROM g""", "pts")
def _(spark, sf):
    gaps = points_view(spark, sf).withColumn("w", F.expr(SPARK_GAPS))
    return src.clean_points(gaps).select("point_id", r("x").alias("x"), r("w").alias("w"))


@query("coordinate_report", f"""WITH g AS (SELECT *, {DUCK_GAPS} AS w FROM pts)
SELECT count(*) AS rows, count(*) FILTER (WHERE NOT isfinite(w)) AS bad_coordinates, 0::BIGINT AS bad_ids FROM g""", "pts")
def _(spark, sf):
    return src.coordinate_report(points_view(spark, sf).withColumn("z", F.expr(SPARK_GAPS)))


@query("validate_dataset", """SELECT unnest(['label_not_integer_0_255','mask_not_0_or_1','label_outside_domain','feature_name_empty','feature_name_repeated','feature_missing']) AS rule,
 unnest([(SELECT count(*) FILTER (WHERE pred_class < 0) FROM lab), 0, (SELECT count(*) FILTER (WHERE pred_class NOT IN (2,5)) FROM lab), 0, 1, 1])::BIGINT AS violations""", "lab")
def _(spark, sf):
    return src.validate_dataset(labelled_view(spark, sf), ["x", "z", "z", "absent"], label="pred_class", domain=(2, 5))


@query("dataset_summary", """SELECT CAST(classification AS INT) AS class_code, count(*) AS row_count, count(*) FILTER (WHERE is_trusted) AS trusted_rows,
 count(*) FILTER (WHERE intensity IS NULL OR score IS NULL) AS rows_missing_feature, 0::BIGINT AS rows_missing_xy, 2::INT AS feature_count
 FROM lab GROUP BY ROLLUP(classification)""", "lab")
def _(spark, sf):
    return src.dataset_summary(labelled_view(spark, sf), ["intensity", "score"])


@query("tile_write_counts", """WITH b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pts),
t AS (SELECT least(floor((x-x0)/5), greatest(1, ceil((x1-x0)/5))-1)::INT AS tile_col, least(floor((y-y0)/5), greatest(1, ceil((y1-y0)/5))-1)::INT AS tile_row FROM pts, b)
SELECT tile_col, tile_row, count(*) AS n FROM t GROUP BY ALL""", "pts")
def _(spark, sf):
    # Written, read back and counted per tile folder.
    p = points_view(spark, sf)
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    return sinks.tiles_written(ti.assign_tile(p, ti.TileGrid.over(p, 5.0)), path)


@query("export_classified", """SELECT classification, count(*) AS n, sum(point_id)::BIGINT AS ids FROM
 (SELECT point_id, CASE WHEN pred_class >= 0 THEN pred_class ELSE classification END AS classification FROM lab) GROUP BY 1""", "lab")
def _(spark, sf):
    lab = labelled_view(spark, sf)
    out = sinks.export_classified(lab.drop("pred_class"), lab.select("point_id", "pred_class"))
    return out.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


@query("export_features_partial", f"SELECT point_id, CASE WHEN x < 12 THEN {d('x*2+z')} END AS f1, CASE WHEN x < 5 THEN {d('z')} END AS f2 FROM pts", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    near = p.where("x < 5").select("point_id", r(F.expr("x*2+z")).alias("f1"), r("z").alias("f2"))
    far = p.where("x >= 5 AND x < 12").select("point_id", r(F.expr("x*2+z")).alias("f1"))
    return sinks.export_features(p, [near, far]).select("point_id", "f1", "f2")


@query("extract_by_mask", """SELECT part, count(*) AS n, sum(point_id)::BIGINT AS ids FROM
 (SELECT point_id, CASE WHEN confidence > 0.5 THEN 'proposal' ELSE 'retained' END AS part FROM lab) GROUP BY 1""", "lab")
def _(spark, sf):
    a, b = sinks.extract_by_mask(labelled_view(spark, sf), F.col("confidence") > 0.5)
    both = a.withColumn("part", F.lit("proposal")).unionByName(b.withColumn("part", F.lit("retained")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


TILE5 = """b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pts),
t AS (SELECT pts.*, least(floor((x-x0)/5), greatest(1, ceil((x1-x0)/5))-1)::INT AS tile_col, least(floor((y-y0)/5), greatest(1, ceil((y1-y0)/5))-1)::INT AS tile_row FROM pts, b)"""


@query("tiles_subset", f"WITH {TILE5} SELECT point_id, tile_col, tile_row FROM t WHERE (tile_col + tile_row) % 2 = 0", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    tiled = ti.assign_tile(p, ti.TileGrid.over(p, 5.0))
    chosen = tiled.select("tile_col", "tile_row").distinct().where((F.col("tile_col") + F.col("tile_row")) % 2 == 0)
    return sinks.tiles_subset(tiled, chosen).select("point_id", "tile_col", "tile_row")


@query("select_points_rules", """SELECT point_id FROM lab WHERE classification IN (2,6) AND confidence BETWEEN 0.25 AND 0.75
 AND intensity IS NOT NULL AND z >= 0.5 AND z != 3.0""", "lab")
def _(spark, sf):
    return se.select_points(labelled_view(spark, sf), [
        {"field": "classification", "op": "codes", "text": "2, 6"}, {"field": "confidence", "op": "range", "text": "0,25;0.75"},
        {"field": "intensity", "op": "finite"}, {"field": "z", "op": ">=", "text": "0,5"}, {"field": "z", "op": "!=", "text": "3"}]).select("point_id")


@query("select_missing", "SELECT point_id FROM lab WHERE confidence IS NULL AND score < 0.3", "lab")
def _(spark, sf):
    return se.select_points(labelled_view(spark, sf), [{"field": "confidence", "op": "missing"}, {"field": "score", "op": "<", "text": "0.3"}]).select("point_id")


REVIEW = "CASE WHEN is_ground THEN 0 WHEN coalesce(confidence BETWEEN 0.2 AND 0.9, false) AND coalesce(hag BETWEEN 0 AND 8, false) THEN 0 ELSE 1 END"


@query("range_review", f"SELECT point_id, {REVIEW}::INT AS review_status FROM lab", "lab")
def _(spark, sf):
    return se.range_review(labelled_view(spark, sf), {"confidence": (0.2, 0.9), "hag": (0.0, 8.0)}).select("point_id", "review_status")


@query("refine_proposal", f"""WITH p AS (SELECT *, (point_id % 2)::INT AS proposal, {REVIEW} AS st FROM lab)
SELECT point_id, CASE WHEN proposal = 1 AND st = 1 THEN 0 ELSE proposal END::INT AS proposal,
 CASE WHEN proposal = 1 AND st = 1 THEN 1 ELSE pred_class END::INT AS proposed_class FROM p""", "lab")
def _(spark, sf):
    p = labelled_view(spark, sf).withColumns({"proposal": (F.col("point_id") % 2).cast("int"), "proposed_class": F.col("pred_class")})
    return se.refine_proposal(p, {"confidence": (0.2, 0.9), "hag": (0.0, 8.0)}).select("point_id", "proposal", "proposed_class")


RING = [(2.0, 1.0), (18.0, 1.0), (18.0, 9.0), (10.0, 5.0), (2.0, 9.0)]


def _edges(ring):
    return ", ".join(f"({a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)" for a, b in zip([ring[-1], *ring[:-1]], ring))


POLY_TEST = """bool_or(abs((x-ax)*(py-ay)-(y-ay)*(px-ax)) <= 1e-9*greatest(1, sqrt((px-ax)*(px-ax)+(py-ay)*(py-ay)))
  AND x BETWEEN least(ax,px)-1e-9 AND greatest(ax,px)+1e-9 AND y BETWEEN least(ay,py)-1e-9 AND greatest(ay,py)+1e-9)
 OR count(*) FILTER (WHERE (ay > y) <> (py > y) AND x < (px-ax)*(y-ay)/nullif(py-ay,0)+ax) % 2 = 1"""


@query("in_polygon", f"""WITH e(ax,ay,px,py) AS (VALUES {_edges(RING)})
SELECT point_id FROM pts, e GROUP BY point_id HAVING {POLY_TEST}""", "pts")
def _(spark, sf):
    return se.in_polygon(points_view(spark, sf), RING).select("point_id")


@query("in_many_polygons", f"""WITH s AS (SELECT s_suppkey AS polygon_id, (s_suppkey % 4)*5.0 AS bx, s_suppkey*1.5 AS by_ FROM supplier),
e AS (SELECT polygon_id, bx+ox1 AS ax, by_+oy1 AS ay, bx+ox2 AS px, by_+oy2 AS py FROM s,
 (VALUES (1.0,3.0,0.0,0.0),(0.0,0.0,4.0,0.0),(4.0,0.0,2.5,2.0),(2.5,2.0,1.0,3.0)) v(ox1,oy1,ox2,oy2))
SELECT point_id, polygon_id FROM (SELECT point_id, x, y, polygon_id, ax::DOUBLE ax, ay::DOUBLE ay, px::DOUBLE px, py::DOUBLE py
 FROM pts JOIN (SELECT e.*, polygon_id*1.5 AS low FROM e) e ON y BETWEEN low - 1 AND low + 4) GROUP BY point_id, polygon_id HAVING {POLY_TEST}""", "pts")
def _(spark, sf):
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("polygon_id"), ((F.col("s_suppkey") % 4) * 5.0).alias("bx"), (F.col("s_suppkey") * 1.5).alias("by"))
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("ox"), F.lit(y).alias("oy")) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (2.5, 2.0), (1.0, 3.0)])])
    rings = base.withColumn("c", F.explode(corners)).select("polygon_id", "c.seq", (F.col("bx") + F.col("c.ox")).alias("px"), (F.col("by") + F.col("c.oy")).alias("py"))
    return se.in_polygons(points_view(spark, sf), rings, 2.0)


YAW, PITCH = -math.pi / 4, math.pi / 6


@query("project_orbit", f"""SELECT point_id, {d(f'(x-10)*{-math.sin(YAW)!r}::DOUBLE + (y-20)*{math.cos(YAW)!r}::DOUBLE + (z-1)*0::DOUBLE')} AS u,
 {d(f'(x-10)*{-math.cos(YAW) * math.sin(PITCH)!r}::DOUBLE + (y-20)*{-math.sin(YAW) * math.sin(PITCH)!r}::DOUBLE + (z-1)*{math.cos(PITCH)!r}::DOUBLE')} AS v FROM pts""", "pts")
def _(spark, sf):
    return se.project(points_view(spark, sf), "orbit", (10.0, 20.0, 1.0)).select("point_id", r("u").alias("u"), r("v").alias("v"))


@query("project_front_selection", "SELECT point_id FROM pts WHERE x - 10 BETWEEN -4 AND 4 AND z - 1 BETWEEN -0.75 AND 2.25", "pts")
def _(spark, sf):
    seen = se.project(points_view(spark, sf), "front", (10.0, 0.0, 1.0))
    return se.in_polygon(seen, [(-4.0, -0.75), (4.0, -0.75), (4.0, 2.25), (-4.0, 2.25)], "u", "v").select("point_id")


ANGLE = 0.3


@query("section_slab_oblique", f"SELECT point_id FROM pts WHERE abs(x*{-math.sin(ANGLE)!r}::DOUBLE + y*{math.cos(ANGLE)!r}::DOUBLE + z*0::DOUBLE - 6.5) <= 0.75", "pts")
def _(spark, sf):
    return se.section_slab(points_view(spark, sf), se.oblique_normal(ANGLE), 6.5, 1.5).select("point_id")


@query("wand", """WITH s AS (SELECT x sx, y sy, z sz, intensity si FROM pts WHERE point_id = 2003)
SELECT point_id FROM pts, s WHERE (x-sx)*(x-sx)+(y-sy)*(y-sy)+(z-sz)*(z-sz) <= 9.0 AND abs(intensity - si) <= 300""", "pts")
def _(spark, sf):
    return se.wand(points_view(spark, sf), 2003, 3.0, "intensity", 300.0).select("point_id")


@query("combine_selection", """SELECT mode, count(*) AS n, sum(point_id)::BIGINT AS ids FROM (
 SELECT 'add' AS mode, point_id FROM pts WHERE x < 6 OR z > 2 UNION ALL SELECT 'subtract', point_id FROM pts WHERE x < 6 AND NOT z > 2
 UNION ALL SELECT 'new', point_id FROM pts WHERE z > 2) GROUP BY mode""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    cur, hit = p.where("x < 6"), p.where("z > 2")
    parts = [se.combine_selection(cur, hit, m).withColumn("mode", F.lit(m)) for m in ("add", "subtract", "new")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"))


@query("thin_percent", """WITH o AS (SELECT point_id, row_number() OVER (ORDER BY point_id) AS i FROM pts)
SELECT point_id FROM o WHERE (100-37 + i*37)//100 > (100-37 + (i-1)*37)//100""", "pts")
def _(spark, sf):
    return se.thin_percent(points_view(spark, sf), 37).select("point_id")


@query("confidence_filter", "SELECT point_id FROM lab WHERE pred_class IS NOT NULL AND confidence >= 0.6", "lab")
def _(spark, sf):
    return se.confidence_filter(labelled_view(spark, sf), 0.6).select("point_id")


FIELDS = ["x", "z", "intensity", "confidence", "score", "hag"]
STATS = " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS finite, count(*) - count({f}) AS missing, min({f}) AS minimum, max({f}) AS maximum, avg({f}) AS mean FROM lab" for f in FIELDS)


@query("search_fields", f"""SELECT field FROM ({STATS}) WHERE 100.0*missing/(finite+missing) > 8 AND field LIKE '%n%'""", "lab")
def _(spark, sf):
    stats = pr.field_stats(labelled_view(spark, sf), FIELDS)
    return se.search_fields(se.search_fields(stats, "missing_percent", ">", "8,0"), "name", "contains", "N").select("field")


NAMES = "(SELECT l_returnflag || ' ' || CASE l_linenumber % 7 WHEN 0 THEN 'Classification' WHEN 1 THEN 'Vegetation_Score' WHEN 2 THEN 'Intensity' WHEN 3 THEN 'cluster id' WHEN 4 THEN 'Ground Mask' WHEN 5 THEN 'planarity@0.5' ELSE 'Training_Class' END AS name FROM lineitem)"


@query("label_derived_names", f"""SELECT name, count(*) AS n, regexp_matches(replace(replace(lower(name),' ',''),'_',''), 'class|label|training|prediction|confidence|cluster|groundmask|groundpreview|vegetationscore|reviewstatus') AS leaks
 FROM {NAMES} GROUP BY name""")
def _(spark, sf):
    names = spark.sql(f"SELECT * FROM {NAMES.replace('lineitem', '{li}')}", li=table(spark, sf, "lineitem"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("leaks", fn.is_label_derived("name"))


def duck_mix(columns, seed=0):
    lanes = []
    for lane, p in enumerate(se.MIX_PRIMES):
        h = f"{(seed * 7919 + 12345 + lane) % p}::BIGINT"
        for c in columns:
            h = f"(({h} + {c}::BIGINT % {p} + 1000003) % {p})"
            h = f"(({h} * (({h} + {48271 + lane}) % {p})) % {p})"
        h = f"(({h} + 69621) % {p})"
        lanes.append(f"(({h} * (({h} + 16807) % {p})) % {p})")
    return f"({lanes[0]} * {se.MIX_PRIMES[1]} + {lanes[1]})"


@query("sample_random", f"SELECT point_id FROM (SELECT point_id, row_number() OVER (ORDER BY {duck_mix(['point_id'], 5)}, point_id) AS rn FROM pts) WHERE rn <= 2500", "pts")
def _(spark, sf):
    return se.sample_random(points_view(spark, sf), 2500, seed=5).select("point_id")


@query("sample_grid", f"SELECT first(point_id ORDER BY {duck_mix(['point_id'])}, point_id) AS point_id FROM pts GROUP BY floor(x/2), floor(y/2), floor(z/2)", "pts")
def _(spark, sf):
    return se.sample_grid(points_view(spark, sf), 2.0).select("point_id")


@query("assign_tile", f"WITH {TILE5} SELECT point_id, tile_col, tile_row FROM t", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    return ti.assign_tile(p, ti.TileGrid.over(p, 5.0)).select("point_id", "tile_col", "tile_row")


HALO = """b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pts),
g AS (SELECT *, greatest(1, ceil((x1-x0)/8))::INT AS nc, greatest(1, ceil((y1-y0)/8))::INT AS nr FROM b),
tc AS (SELECT c::INT AS tile_col, rr::INT AS tile_row, x0+c*8 AS l, y0+rr*8 AS bo, least(x1, x0+c*8+8) AS ri, least(y1, y0+rr*8+8) AS tp, g.*
  FROM g, unnest(range(nc)) u(c), unnest(range(nr)) w(rr)),
rep AS (SELECT point_id, tile_col, tile_row, least(floor((x-x0)/8), nc-1) = tile_col AND least(floor((y-y0)/8), nr-1) = tile_row AS is_core
  FROM pts JOIN tc ON x BETWEEN l-1.002 AND ri+1.002 AND y BETWEEN bo-1.002 AND tp+1.002)"""


@query("replicate_halo", f"WITH {HALO} SELECT point_id, tile_col, tile_row, is_core FROM rep", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    return ti.replicate_halo(p, ti.TileGrid.over(p, 8.0), ti.tile_with_radius(1.0)).select("point_id", "tile_col", "tile_row", "is_core")


@query("tile_counts", f"WITH {HALO} SELECT tile_col, tile_row, count(*) FILTER (WHERE is_core) AS core_points, count(*) AS context_points FROM rep GROUP BY ALL", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    return ti.tile_counts(p, ti.TileGrid.over(p, 8.0), ti.tile_with_radius(1.0))


IN_BOX = """count(*) FILTER (WHERE x >= "left" AND y >= bottom AND (x < "right" OR (close_right AND x = "right")) AND (y < top OR (close_top AND y = top))) AS core_points,
 count(*) AS context_points FROM q JOIN pts ON x BETWEEN "left" - 0.5 AND "right" + 0.5 AND y BETWEEN bottom - 0.5 AND top + 0.5 GROUP BY ALL"""


@query("adaptive_tiles", f"""SELECT * FROM (WITH RECURSIVE b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pts),
g AS (SELECT *, greatest(1, ceil((x1-x0)/50))::INT AS nc, greatest(1, ceil((y1-y0)/50))::INT AS nr FROM b),
q AS (SELECT c || '_' || r AS tile_id, c*50.0::DOUBLE+x0 AS "left", r*50.0::DOUBLE+y0 AS bottom, least(x1, c*50.0::DOUBLE+x0+50) AS "right", least(y1, r*50.0::DOUBLE+y0+50) AS top, c = nc-1 AS close_right, r = nr-1 AS close_top
 FROM g, unnest(range(nc)) a(c), unnest(range(nr)) e(r)),
t AS (SELECT * FROM (SELECT q.*, {IN_BOX}) WHERE core_points > 0 UNION ALL
 SELECT * FROM (WITH q AS (SELECT tile_id || '.' || k AS tile_id, CASE WHEN k % 2 = 1 THEN mx ELSE "left" END AS "left", CASE WHEN k >= 2 THEN my ELSE bottom END AS bottom,
  CASE WHEN k % 2 = 1 THEN "right" ELSE mx END AS "right", CASE WHEN k >= 2 THEN top ELSE my END AS top, close_right AND k % 2 = 1 AS close_right, close_top AND k >= 2 AS close_top
  FROM (SELECT *, "left" + ("right"-"left")/2 AS mx, bottom + (top-bottom)/2 AS my FROM t WHERE context_points > 6000) h, (VALUES (0),(1),(2),(3)) v(k)) SELECT q.*, {IN_BOX}) WHERE core_points > 0)
SELECT tile_id, "left", bottom, "right", top, close_right, close_top, core_points, context_points FROM t WHERE context_points <= 6000)""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    grid = ti.TileGrid.over(p, 50.0)
    return ti.adaptive_tiles(p, grid, 6000, 0.5)


@query("suggest_side", """WITH s AS (SELECT o_custkey, count(*)*4000.0::DOUBLE AS points, 900.0::DOUBLE AS area FROM orders GROUP BY 1)
SELECT o_custkey, greatest(5.0, least(100.0, floor((sqrt((2147483648.0-268435456)/200.0*0.55/(points/area)) - 2*4.002)/5)*5))::DOUBLE AS tile_side FROM s""")
def _(spark, sf):
    prof = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 4000.0).alias("points")).withColumns(
        {"area": F.lit(900.0), "halo": F.lit(4.002), "bytes_per_point": F.lit(200.0), "budget": F.lit(2147483648.0)})
    return ti.suggest_side(prof).select("o_custkey", "tile_side")


@query("voxel", "SELECT floor(x/2.5)::BIGINT AS vx, floor(y/2.5)::BIGINT AS vy, floor(z/2.5)::BIGINT AS vz, count(*) AS n FROM pts GROUP BY ALL", "pts")
def _(spark, sf):
    return ti.voxel(points_view(spark, sf), 2.5).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"))


@query("to_global", f"SELECT point_id, {d('x/0.5+440000')} AS x, {d('y/0.5+4130000')} AS y, {d('z/0.5-12.5')} AS z FROM pts", "pts")
def _(spark, sf):
    g = ti.to_global(points_view(spark, sf), 0.5, (-440000.0, -4130000.0, 12.5))
    return g.select("point_id", *[r(a).alias(a) for a in "xyz"])


@query("verify_ownership", """SELECT count(*) AS source_rows, (count(*) FILTER (WHERE x < 15) + count(*) FILTER (WHERE x < 1))::BIGINT AS owned_rows,
 count(*) FILTER (WHERE x >= 15) AS missing_ids, count(*) FILTER (WHERE x < 1) AS repeated_ids, 0::BIGINT AS unknown_ids FROM pts""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    return ti.verify_ownership(p, p.where("x < 15").unionByName(p.where("x < 1")))


@query("feature_profile_fast")
def _(spark, sf):
    names, radii = ti.feature_profile("fast", (), (2.0, 0.5, 1.0))
    return compute_features(points_view(spark, sf), radii, names)


@query("field_stats", f"SELECT field, finite, missing, {d('minimum')} AS minimum, {d('maximum')} AS maximum, {d('mean')} AS mean FROM ({STATS})", "lab")
def _(spark, sf):
    s = pr.field_stats(labelled_view(spark, sf), FIELDS)
    return s.select("field", "finite", "missing", *[r(c).alias(c) for c in ("minimum", "maximum", "mean")])


Q5 = {"percentile_05": 0.05, "percentile_25": 0.25, "median": 0.5, "percentile_75": 0.75, "percentile_95": 0.95}
FSTAT = " UNION ALL ".join("SELECT '%s' AS field, count(%s) AS valid_count, count(*)-count(%s) AS invalid_count, %s FROM lab" % (
    f, f, f, ", ".join([f"{d(f'min({f})')} AS minimum", f"{d(f'max({f})')} AS maximum", f"{d(f'avg({f})')} AS mean", f"{d(f'var_pop({f})')} AS variance",
                        f"{d(f'stddev_pop({f})')} AS standard_deviation"] + [f"{d(f'quantile_cont({f}, {p})')} AS {n}" for n, p in Q5.items()])) for f in FIELDS)


@query("feature_statistics", f"SELECT *, false AS approximate FROM ({FSTAT})", "lab")
def _(spark, sf):
    s = pr.feature_statistics(labelled_view(spark, sf), FIELDS)
    return s.select("field", "valid_count", "invalid_count", "approximate",
                    *[r(c).alias(c) for c in ("minimum", "maximum", "mean", "variance", "standard_deviation", *Q5)])


@query("systematic_sample", """WITH v AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS i, count(*) OVER () AS n FROM pts),
t AS (SELECT DISTINCT (k*((SELECT max(n) FROM v)-1))//2999 AS i FROM unnest(range(3000)) u(k)) SELECT point_id FROM v JOIN t USING (i)""", "pts")
def _(spark, sf):
    return ranking.systematic_sample(points_view(spark, sf).select("point_id"), 3000)


@query("return_histograms", """SELECT 'class_code' AS kind, classification AS code, count(*) AS n FROM pts GROUP BY 2
 UNION ALL SELECT 'return_number', return_number, count(*) FROM pts GROUP BY 2 UNION ALL SELECT 'number_of_returns', number_of_returns, count(*) FROM pts GROUP BY 2""", "pts")
def _(spark, sf):
    return pr.return_histograms(points_view(spark, sf))


@query("cloud_profile", f"""SELECT count(*) AS points, {d('max(x)-min(x)')} AS extent_x, {d('max(y)-min(y)')} AS extent_y,
 {d('(max(x)-min(x))*(max(y)-min(y))')} AS bbox_area, {d('count(*)/((max(x)-min(x))*(max(y)-min(y)))')} AS bbox_density,
 {d('sqrt((max(x)-min(x))*(max(y)-min(y))/count(*))')} AS nominal_spacing, count(*) FILTER (WHERE pred_class < 0) AS invalid_class,
 0::BIGINT AS invalid_return_number, 0::BIGINT AS invalid_number_of_returns, {d('avg((number_of_returns >= return_number)::INT)')} AS valid_return_fraction,
 {d('avg((number_of_returns = return_number)::INT)')} AS last_return_fraction, {d('avg((number_of_returns > 1)::INT)')} AS multiple_return_fraction FROM lab""", "lab")
def _(spark, sf):
    c = pr.cloud_profile(labelled_view(spark, sf), "pred_class")
    whole = ("points", "invalid_class", "invalid_return_number", "invalid_number_of_returns")
    return c.select(*[F.col(n) if n in whole else r(n).alias(n) for n in c.columns])


@query("bounds", "SELECT " + ", ".join(f"{d(f'min({a})')} AS min_{a}, {d(f'max({a})')} AS max_{a}, {d(f'max({a})-min({a})')} AS size_{a}" for a in "xyz") + ", true AS is_valid FROM pts", "pts")
def _(spark, sf):
    b = pr.bounds(points_view(spark, sf))
    return b.select(*[F.col(n) if n == "is_valid" else r(n).alias(n) for n in b.columns])


@query("z_sample_stats", f"SELECT count(z) AS n, {d('avg(z)')} AS z_mean, {d('stddev_samp(z)')} AS z_sample_std FROM pts", "pts")
def _(spark, sf):
    return pr.z_sample_stats(points_view(spark, sf)).select("n", r("z_mean").alias("z_mean"), r("z_sample_std").alias("z_sample_std"))


@query("representative_tile", f"""WITH {TILE5}, n AS (SELECT tile_col, tile_row, count(*) AS points FROM t GROUP BY ALL), m AS (SELECT quantile_cont(points, 0.5) AS med FROM n)
SELECT tile_col, tile_row, points FROM n, m ORDER BY abs(points-med), tile_col, tile_row LIMIT 1""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    counts = ti.assign_tile(p, ti.TileGrid.over(p, 5.0)).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("points"))
    median = ranking.exact_quantiles(counts, ["points"], [0.5]).first().q0
    return counts.orderBy(F.abs(F.col("points") - median), "tile_col", "tile_row").limit(1).select("tile_col", "tile_row", "points")


@query("class_catalogue", "SELECT classification, class_name, n FROM (SELECT classification, count(*) AS n FROM scene GROUP BY 1) JOIN (VALUES (2,'Ground'),(5,'High vegetation'),(6,'Building'),(14,'Wire - conductor (phase)'),(15,'Transmission tower')) v(c,class_name) ON c = classification", "scene")
def _(spark, sf):
    counts = scene_view(spark, sf).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))
    return attach.class_names(counts).select("classification", "class_name", "n")


@query("class_names", """SELECT point_id, CASE c WHEN 2 THEN 'Ground' WHEN 70 THEN 'Stockpile' WHEN 130 THEN 'Utility pole' WHEN 40 THEN 'Reserved' ELSE 'User definable' END AS class_name
 FROM (SELECT point_id, CASE point_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 70 WHEN 2 THEN 130 WHEN 3 THEN 40 ELSE 200 END AS c FROM pts)""", "pts")
def _(spark, sf):
    p = points_view(spark, sf).select("point_id", F.expr("CASE point_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 70 WHEN 2 THEN 130 WHEN 3 THEN 40 ELSE 200 END").alias("classification"))
    return attach.class_names(p, custom={70: "Stockpile"}).select("point_id", "class_name")


@query("scalar_names", f"SELECT name, count(*) AS n, replace(replace(lower(name),' ',''),'_','') AS canonical, regexp_replace(lower(name),'[^a-z0-9]','','g') AS alnum FROM {NAMES} GROUP BY name")
def _(spark, sf):
    names = spark.sql(f"SELECT * FROM {NAMES.replace('lineitem', '{li}')}", li=table(spark, sf, "lineitem"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumns({"canonical": fn.canonical_name("name"), "alnum": fn.alphanumeric_name("name")})


@query("feature_key_parse", """SELECT k, split_part(k,'@',1) AS descriptor, CASE WHEN contains(k,'@') THEN TRY_CAST(split_part(k,'@',2) AS DOUBLE) END AS radius, count(*) AS n FROM
 (SELECT CASE o_custkey % 4 WHEN 0 THEN 'planarity@0.5' WHEN 1 THEN 'z_range@'||(o_custkey % 7) WHEN 2 THEN 'plain' ELSE 'bad@x' END AS k FROM orders) GROUP BY ALL""")
def _(spark, sf):
    keys = table(spark, sf, "orders").select(F.expr("CASE o_custkey % 4 WHEN 0 THEN 'planarity@0.5' WHEN 1 THEN 'z_range@'||(o_custkey % 7) WHEN 2 THEN 'plain' ELSE 'bad@x' END").alias("k"))
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("p", fn.feature_key_parse("k")).select("k", "p.descriptor", "p.radius", "n")


NUM = "CASE o_orderkey % 4 WHEN 0 THEN ' ' || (o_orderkey % 50) || ',25 ' WHEN 1 THEN (o_orderkey % 50) || '.5' WHEN 2 THEN '1,2.5' ELSE 'n/a' END"


@query("parse_number_locale", f"""WITH t AS (SELECT {NUM} AS t FROM orders)
SELECT t, TRY_CAST(CASE WHEN contains(trim(t),',') AND NOT contains(trim(t),'.') THEN replace(trim(t),',','.') ELSE trim(t) END AS DOUBLE) AS value, count(*) AS n FROM t GROUP BY ALL""")
def _(spark, sf):
    t = table(spark, sf, "orders").select(F.expr(NUM).alias("t"))
    return t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn("value", fn.parse_number_locale("t"))


@query("preferred_125", f"""WITH v AS (SELECT o_orderkey, o_totalprice/1000.0 - 50 AS v FROM orders), m AS (SELECT *, CASE WHEN v > 0 THEN pow(10, floor(log10(v))) END AS g FROM v)
SELECT o_orderkey, {d("coalesce(CASE WHEN v > 0 THEN g * CASE WHEN v/g <= 1 THEN 1 WHEN v/g <= 2 THEN 2 WHEN v/g <= 5 THEN 5 ELSE 10 END END, 0)")} AS preferred FROM m""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000.0 - 50).alias("v"))
    return o.select("o_orderkey", r(fn.preferred_125("v")).alias("preferred"))


@query("range_and_ratio", f"""SELECT point_id, coalesce(confidence BETWEEN 0.2 AND 0.4, false) AS inside,
 CASE WHEN abs(score) > 2.220446049250313e-16 THEN {d('z/score')} END AS ratio FROM lab""", "lab")
def _(spark, sf):
    return labelled_view(spark, sf).select("point_id", fn.within_range(F.col("confidence"), 0.2, 0.4).alias("inside"),
                                           r(fn.safe_ratio(F.col("z"), F.col("score"))).alias("ratio"))


@query("field_key_codec", """SELECT name, 'sf:' || replace(replace(replace(name,'@','%40'),' ','%20'),'/','%2F') AS key, name AS decoded, count(*) AS n FROM
 (SELECT 'f ' || o_orderpriority || '@' || (o_custkey % 5) || '/a' AS name FROM orders) GROUP BY ALL""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.expr("'f ' || o_orderpriority || '@' || (o_custkey % 5) || '/a'").alias("name"))
    o = o.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("key", fn.encode_field_key("name"))
    return o.withColumn("decoded", fn.decode_field_key("key"))


@query("set_operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT floor(x) c FROM pts WHERE classification = 2 UNION SELECT floor(x) FROM pts WHERE z > 3 AND x < 9)
 UNION ALL SELECT 'intersect', count(*) FROM (SELECT floor(x*10) c FROM pts WHERE classification = 2 INTERSECT SELECT floor(x*10) FROM pts WHERE z > 3)
 UNION ALL SELECT 'except', count(*) FROM (SELECT floor(y*20) c FROM pts WHERE classification = 2 EXCEPT SELECT floor(y*20) FROM pts WHERE z > 3)""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)

    def cells(expr, cond):
        return p.where(cond).select(F.expr(expr).alias("c"))

    parts = {"union": cells("floor(x)", "classification = 2").union(cells("floor(x)", "z > 3 AND x < 9")).distinct(),
             "intersect": cells("floor(x*10)", "classification = 2").intersect(cells("floor(x*10)", "z > 3")),
             "except": cells("floor(y*20)", "classification = 2").subtract(cells("floor(y*20)", "z > 3"))}
    out = None
    for op, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out
