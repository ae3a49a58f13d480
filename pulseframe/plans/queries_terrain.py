"""Queries over rasters, ground, terrain, surfaces and void filling; the flagship query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pulseframe.operators import features as fe, grid as gr, metrics as me, terrain as te
from pulseframe.plans.queries_space import duck_moments, duck_pairs, duck_ratio
from pulseframe.plans.registry import d, query, r
from pulseframe.plans.views import points_view


def duck_pmf(windows, thresholds, cell: float, source: str = "pts") -> str:
    """The ground filter step by step on points: CTEs ending in ``ground(point_id, is_ground)``."""
    parts = [f"""bb AS (SELECT min(x) x0, min(y) y0, floor((max(x)-min(x))/{cell})::BIGINT+1 AS w, floor((max(y)-min(y))/{cell})::BIGINT+1 AS h FROM {source}),
g0 AS (SELECT point_id, z AS cur, true AS ground, least(w-1, floor((x-x0)/{cell}))::BIGINT AS c, least(h-1, floor((y-y0)/{cell}))::BIGINT AS rr FROM {source}, bb),
dense AS (SELECT c, rr FROM bb, unnest(range(w)) a(c), unnest(range(h)) b(rr))"""]
    for i, (window, threshold) in enumerate(zip(windows, thresholds)):
        k = max(1, math.ceil(window / (2.0 * cell)))
        row = f"PARTITION BY rr ORDER BY c RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING"
        col = f"PARTITION BY c ORDER BY rr RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING"
        parts.append(f"""s{i} AS (SELECT c, rr, v FROM dense LEFT JOIN (SELECT c, rr, min(cur) AS v FROM g{i} WHERE ground GROUP BY c, rr) USING (c, rr)),
a{i} AS (SELECT c, rr, min(v) OVER ({row}) AS v FROM s{i}), b{i} AS (SELECT c, rr, min(v) OVER ({col}) AS v FROM a{i}),
c{i} AS (SELECT c, rr, max(v) OVER ({row}) AS v FROM b{i}), o{i} AS (SELECT c, rr, max(v) OVER ({col}) AS v FROM c{i}),
g{i + 1} AS (SELECT point_id, CASE WHEN ground AND v IS NOT NULL AND cur - v < {threshold} THEN v ELSE cur END AS cur,
  coalesce(ground AND v IS NOT NULL AND cur - v < {threshold}, false) AS ground, c, rr FROM g{i} LEFT JOIN o{i} USING (c, rr))""")
    parts.append(f"ground AS (SELECT point_id, ground AS is_ground FROM g{len(windows)})")
    return ",\n".join(parts)


def duck_dtm(step: float, where: str = "is_ground", source: str = "gp", name: str = "dtm") -> str:
    return f"""rb AS (SELECT min(x) x0, min(y) y0, floor((max(x)-min(x))/{step}+0.5)::INT+1 AS w, floor((max(y)-min(y))/{step}+0.5)::INT+1 AS h FROM {source}),
cells AS (SELECT {source}.*, least(w-1, floor((x-x0)/{step}+0.5))::INT AS col, least(h-1, floor((y-y0)/{step}+0.5))::INT AS "row" FROM {source}, rb),
{name} AS (SELECT col, "row", min(z) AS height, count(*) AS points FROM cells WHERE {where} GROUP BY ALL)"""


def duck_bilinear(step: float, out: str = "terrain", grid: str = "dtm", source: str = "gp") -> str:
    return f"""gx AS (SELECT p.*, (x-x0)/{step} AS gx, (y-y0)/{step} AS gy, w, h FROM {source} p, rb),
ix AS (SELECT *, CASE WHEN gx BETWEEN 0 AND w-1 AND gy BETWEEN 0 AND h-1 THEN least(floor(gx), w-2)::INT END AS c0,
  CASE WHEN gx BETWEEN 0 AND w-1 AND gy BETWEEN 0 AND h-1 THEN least(floor(gy), h-2)::INT END AS r0 FROM gx),
look AS (SELECT ix.*, (1-(gy-r0))*((1-(gx-c0))*a.height + (gx-c0)*b.height) + (gy-r0)*((1-(gx-c0))*c.height + (gx-c0)*e.height) AS {out}
  FROM ix LEFT JOIN {grid} a ON a.col = c0 AND a."row" = r0 LEFT JOIN {grid} b ON b.col = c0+1 AND b."row" = r0
  LEFT JOIN {grid} c ON c.col = c0 AND c."row" = r0+1 LEFT JOIN {grid} e ON e.col = c0+1 AND e."row" = r0+1)"""


LOWEST = """bb AS (SELECT min(x) x0, min(y) y0, floor((max(x)-min(x))/0.5)::INT+1 AS w, floor((max(y)-min(y))/0.5)::INT+1 AS h FROM pts),
lo AS (SELECT least(w-1, floor((x-x0)/0.5))::INT AS col, least(h-1, floor((y-y0)/0.5))::INT AS "row", min(z) AS v FROM pts, bb GROUP BY ALL),
dense AS (SELECT c::INT AS col, rr::INT AS "row", v FROM (SELECT c, rr FROM bb, unnest(range(w)) a(c), unnest(range(h)) b(rr)) LEFT JOIN lo ON lo.col = c AND lo."row" = rr)"""


def lowest_grid(spark, sf) -> DataFrame:
    p = points_view(spark, sf)
    raster = te.pmf_raster(p, (3.0,), (0.5,))
    return gr.densify(raster.index(p).groupBy("col", "row").agg(F.min("z").alias("v")), raster.width, raster.height)


@query("densify_grid", f'WITH {LOWEST} SELECT col, "row", {d("v")} AS v FROM dense', "pts")
def _(spark, sf):
    return lowest_grid(spark, sf).select("col", "row", r("v").alias("v"))


@query("sliding_min_max", f"""WITH {LOWEST}, a AS (SELECT col, "row", min(v) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lo,
 max(v) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hi FROM dense)
SELECT col, "row", {d('min(lo) OVER w')} AS sliding_min, {d('max(hi) OVER w')} AS sliding_max FROM a
WINDOW w AS (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", "pts")
def _(spark, sf):
    g = gr.sliding_max(gr.sliding_min(lowest_grid(spark, sf), "v", 2), "v", 2)
    return g.select("col", "row", r("sliding_min").alias("sliding_min"), r("sliding_max").alias("sliding_max"))


@query("morphological_opening", f"""WITH {LOWEST}, a AS (SELECT col, "row", min(v) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM dense),
b AS (SELECT col, "row", min(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM a),
c AS (SELECT col, "row", max(v) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM b)
SELECT col, "row", {d('max(v) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS opened FROM c""", "pts")
def _(spark, sf):
    return gr.opening(lowest_grid(spark, sf), "v", 3).select("col", "row", r("opened").alias("opened"))


PMF = duck_pmf(te.PMF_WINDOWS, te.PMF_THRESHOLDS, 0.5)


@query("pmf_ground", f"WITH {PMF} SELECT point_id, is_ground FROM ground", "pts")
def _(spark, sf):
    return te.pmf_ground(points_view(spark, sf)).select("point_id", "is_ground")


GP = f"{PMF}, gp AS (SELECT pts.*, is_ground FROM pts JOIN ground USING (point_id))"


@query("dtm", f"""WITH {GP}, {duck_dtm(1.0)} SELECT col, "row", {d('height')} AS height, points, 1::TINYINT AS state FROM dtm""", "pts")
def _(spark, sf):
    p = te.pmf_ground(points_view(spark, sf))
    return te.dtm(p, te.dtm_raster(p, 1.0)).select("col", "row", r("height").alias("height"), "points", "state")


@query("dtm_lookup", f"""WITH {GP}, {duck_dtm(1.0)}, {duck_bilinear(1.0)} SELECT point_id, {d('terrain')} AS terrain FROM look""", "pts")
def _(spark, sf):
    p = te.pmf_ground(points_view(spark, sf))
    raster = te.dtm_raster(p, 1.0)
    return te.dtm_lookup(p, te.dtm(p, raster), raster).select("point_id", r("terrain").alias("terrain"))


@query("height_above_ground", f"""WITH {GP}, {duck_dtm(1.5)}, {duck_bilinear(1.5)} SELECT point_id, {d('z - terrain')} AS hag FROM look""", "pts")
def _(spark, sf):
    p = te.pmf_ground(points_view(spark, sf))
    raster = te.dtm_raster(p, 1.5)
    return te.hag(p, te.dtm(p, raster), raster).select("point_id", r("hag").alias("hag"))


@query("hag_stats", f"""WITH {GP}, {duck_dtm(1.5)}, {duck_bilinear(1.5)}, q AS (SELECT z - terrain AS hag FROM look)
SELECT count(hag) AS valid, count(*) - count(hag) AS missing, count(*) FILTER (WHERE hag < 0) AS negative, {d('min(hag)')} AS minimum, {d('max(hag)')} AS maximum,
 {d('avg(hag)')} AS mean, {d('stddev_pop(hag)')} AS standard_deviation FROM q""", "pts")
def _(spark, sf):
    p = te.pmf_ground(points_view(spark, sf))
    raster = te.dtm_raster(p, 1.5)
    s = te.hag_stats(te.hag(p, te.dtm(p, raster), raster))
    return s.select("valid", "missing", "negative", *[r(c).alias(c) for c in ("minimum", "maximum", "mean", "standard_deviation")])


CLASSGROUND = duck_dtm(0.5, "classification = 2", "pts")


@query("dtm_stats", f"""WITH {CLASSGROUND}, t AS (SELECT w*h AS n FROM rb)
SELECT count(*) AS observed, 0::BIGINT AS interpolated, any_value(n) - count(*) AS nodata, {d('min(height)')} AS minimum, {d('max(height)')} AS maximum, {d('avg(height)')} AS mean,
 {d('stddev_pop(height)')} AS standard_deviation FROM dtm, t""", "pts")
def _(spark, sf):
    p = points_view(spark, sf).withColumn("is_ground", F.col("classification") == 2)
    raster = te.dtm_raster(p, 0.5)
    s = te.dtm_stats(gr.densify(te.dtm(p, raster), raster.width, raster.height))
    return s.select("observed", "interpolated", "nodata", *[r(c).alias(c) for c in ("minimum", "maximum", "mean", "standard_deviation")])


SURF = f"""{duck_dtm(2.0, 'true', 'pts')}, sc AS (SELECT col, "row", min(z) FILTER (WHERE classification = 2) AS g, min(z) FILTER (WHERE classification = 6) AS b,
 max(z) FILTER (WHERE classification = 6) AS t FROM cells WHERE classification IN (2, 6) GROUP BY ALL)"""


def surface_input(spark, sf):
    p = points_view(spark, sf)
    return p, te.dtm_raster(p, 2.0), F.col("classification") == 2, F.col("classification") == 6


@query("dfm", f"""WITH {SURF} SELECT col, "row", {d('coalesce(t, g)')} AS height, CASE WHEN t IS NOT NULL THEN 2 ELSE 1 END AS source_code FROM sc""", "pts")
def _(spark, sf):
    return te.dfm(*surface_input(spark, sf)).select("col", "row", r("height").alias("height"), "source_code")


@query("dfm_min_merge", f"""WITH {SURF} SELECT col, "row", {d('least(coalesce(g, b), coalesce(b, g))')} AS height, CASE WHEN b IS NULL OR g <= b THEN 1 ELSE 2 END AS source_code FROM sc""", "pts")
def _(spark, sf):
    return te.dfm_min_merge(*surface_input(spark, sf)).select("col", "row", r("height").alias("height"), "source_code")


@query("dfm_conflicts", f"""WITH {SURF} SELECT count(g) AS ground_cells, count(b) AS building_cells, count(*) FILTER (WHERE g IS NOT NULL AND b IS NOT NULL) AS overlap_cells,
 count(*) FILTER (WHERE g <= b) AS ground_wins FROM sc""", "pts")
def _(spark, sf):
    return te.dfm_conflicts(*surface_input(spark, sf))


REGIONS = """SELECT s_suppkey AS seq, (s_suppkey*3) % 8 AS x0, (s_suppkey*7) % 70 AS y0, (s_suppkey*3) % 8 + 2 AS x1, (s_suppkey*7) % 70 + 4 AS y1, s_suppkey % 3 AS preferred FROM {supplier}"""


@query("regions_apply", f"""WITH {SURF}, rg AS ({REGIONS.format(supplier='supplier')}), hit AS (SELECT col, "row", arg_max(preferred, seq) AS preferred FROM sc JOIN rg
 ON col BETWEEN x0 AND x1 AND "row" BETWEEN y0 AND y1 WHERE g IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT sc.col, sc."row", coalesce(preferred, 0)::INT AS preferred FROM sc LEFT JOIN hit USING (col, "row") WHERE g IS NOT NULL AND b IS NOT NULL""", "pts")
def _(spark, sf):
    both = te.surface_cells(*surface_input(spark, sf)).where("ground_min IS NOT NULL AND building_min IS NOT NULL").select("col", "row")
    rg = spark.sql(REGIONS.format(supplier="{s}"), s=spark.read.parquet(f"{sf}/supplier.parquet"))
    return te.regions_apply(both, rg).select("col", "row", F.col("preferred").cast("int").alias("preferred"))


@query("dfm_reviewed_merge", f"""WITH {SURF}, rg AS ({REGIONS.format(supplier='supplier')}), hit AS (SELECT col, "row", arg_max(preferred, seq) AS pf FROM sc JOIN rg
 ON col BETWEEN x0 AND x1 AND "row" BETWEEN y0 AND y1 GROUP BY ALL), c AS (SELECT sc.*, CASE WHEN g IS NOT NULL AND b IS NOT NULL AND pf IN (1,2) THEN pf WHEN b IS NULL OR g <= b THEN 1 ELSE 2 END AS sc2
 FROM sc LEFT JOIN hit USING (col, "row"))
SELECT col, "row", {d('CASE WHEN sc2 = 1 THEN g ELSE b END')} AS height, sc2::INT AS source_code FROM c""", "pts")
def _(spark, sf):
    p, raster, ground, building = surface_input(spark, sf)
    rg = spark.sql(REGIONS.format(supplier="{s}"), s=spark.read.parquet(f"{sf}/supplier.parquet"))
    cells = te.surface_cells(p, raster, ground, building).select("col", "row")
    return te.dfm_min_merge(p, raster, ground, building, te.regions_apply(cells, rg)).select("col", "row", r("height").alias("height"), "source_code")


OPTIONS = te.FillOptions(radius=1.5, maximum_range=1.6, maximum_deviation=0.1, minimum_support=4, maximum_support=8)


def duck_fill(estimate: str) -> str:
    return f"""{CLASSGROUND}, full_grid AS (SELECT c::INT AS col, rr::INT AS "row", height FROM (SELECT c, rr FROM rb, unnest(range(w)) a(c), unnest(range(h)) b(rr)) LEFT JOIN dtm ON dtm.col = c AND dtm."row" = rr),
nb AS (SELECT v.col, v."row", i, j, i*i+j*j AS d2, s.height AS z, row_number() OVER (PARTITION BY v.col, v."row" ORDER BY i*i+j*j, s."row"*rb.w+s.col) AS k
 FROM full_grid v, rb, (VALUES (-3),(-2),(-1),(0),(1),(2),(3)) a(i), (VALUES (-3),(-2),(-1),(0),(1),(2),(3)) b(j), dtm s
 WHERE v.height IS NULL AND i*i+j*j BETWEEN 1 AND 9 AND s.col = v.col+i AND s."row" = v."row"+j),
ag AS (SELECT col, "row", count(*) AS n, avg(z) AS mean, max(z)-min(z) AS span, sum(z/d2)/sum(1.0::DOUBLE/d2) AS idw,
 bool_or(i<=0 AND j<=0) AND bool_or(i>=0 AND j<=0) AND bool_or(i<=0 AND j>=0) AND bool_or(i>=0 AND j>=0) AS around FROM nb WHERE k <= 8 GROUP BY ALL),
oc AS (SELECT g.col, g."row", g.height, {estimate} AS est, CASE WHEN g.height IS NOT NULL THEN 'observed' WHEN n IS NULL OR n < 4 OR NOT around THEN 'insufficient'
 WHEN span > 1.6 THEN 'discontinuity' WHEN abs({estimate}-mean) > 0.1 THEN 'deviation' ELSE 'filled' END AS outcome FROM full_grid g LEFT JOIN ag USING (col, "row"))"""


def fill(spark, sf, method, **more):
    p = points_view(spark, sf).withColumn("is_ground", F.col("classification") == 2)
    raster = te.dtm_raster(p, 0.5)
    return te.fill_voids(te.dtm(p, raster), raster, method, OPTIONS, **more)


for _method, _estimate in (("mean", "mean"), ("idw", "idw")):
    def _fill(spark, sf, method=_method):
        return fill(spark, sf, method).select("col", "row", r("height").alias("height"), "state", "outcome")

    query(f"fill_voids_{_method}", f"""WITH {duck_fill(_estimate)} SELECT col, "row", {d("CASE outcome WHEN 'observed' THEN height WHEN 'filled' THEN est END")} AS height,
 (CASE outcome WHEN 'observed' THEN 1 WHEN 'filled' THEN 2 ELSE 0 END)::TINYINT AS state, outcome FROM oc""", "pts")(_fill)


@query("fill_statistics", f"""WITH {duck_fill('idw')} SELECT count(*) FILTER (WHERE outcome = 'filled') AS filled, count(*) FILTER (WHERE outcome = 'insufficient') AS insufficient,
 count(*) FILTER (WHERE outcome = 'discontinuity') AS discontinuity, count(*) FILTER (WHERE outcome = 'deviation') AS deviation,
 count(*) FILTER (WHERE outcome NOT IN ('observed','filled')) AS remaining FROM oc""", "pts")
def _(spark, sf):
    return te.fill_statistics(fill(spark, sf, "idw"))


@query("fill_voids_kriging")
def _(spark, sf):
    return fill(spark, sf, "kriging", variogram=te.Variogram("spherical", 0.01, 0.5, 3.0))


@query("terrain_presets", f"""WITH p(preset, step) AS (VALUES ('flat',2.0::DOUBLE),('archaeological_site',1.0),('terraced',1.0),('hilly',1.0),('rocky',0.5),('forest',2.0),('dense_vegetation',2.0),('reference',2.0)),
q AS (SELECT preset, z, floor(x/(step*0.75*1.25)) AS c, floor(y/(step*0.75*1.25)) AS rr FROM pts, p), l AS (SELECT preset, c, rr, min(z) AS low FROM q GROUP BY ALL),
a AS (SELECT preset, count(*) AS cells, {d('avg(low)')} AS mean_low FROM l GROUP BY 1), n AS (SELECT preset, count(*) FILTER (WHERE z - low <= 0.5) AS near_ground FROM q JOIN l USING (preset, c, rr) GROUP BY 1)
SELECT preset, cells, mean_low, near_ground FROM a JOIN n USING (preset)""", "pts")
def _(spark, sf):
    made = te.preset_surfaces(points_view(spark, sf), {n: te.terrain_preset(n, "high", "high", "high") for n in te.TERRAIN_PRESETS})
    return made.select("preset", "cells", r("mean_low").alias("mean_low"), "near_ground")


@query("ground_review", f"""WITH {GP}, q AS (SELECT floor(x/2)::BIGINT cx, floor(y/2)::BIGINT cy, z, is_ground AS g, CASE WHEN classification = 5 THEN 4 ELSE classification END AS t FROM gp),
c AS (SELECT cx, cy, min(z) FILTER (WHERE t = 2) AS lo, max(z) FILTER (WHERE t = 4) AS hi FROM q GROUP BY ALL), j AS (SELECT q.*, coalesce(hi - lo > 1, false) AND t = 2 AS cov FROM q JOIN c USING (cx, cy)),
a AS (SELECT count(*) FILTER (WHERE g) AS gp, count(*) FILTER (WHERE g AND t = 2) AS tp, count(*) FILTER (WHERE t = 2) AS tr, count(*) FILTER (WHERE g AND t = 6) AS b,
 count(*) FILTER (WHERE g AND t = 4) AS v, count(*) FILTER (WHERE cov) AS cv, count(*) FILTER (WHERE cov AND g) AS cf FROM j)
SELECT gp AS ground_points, {d('tp/gp')} AS precision, {d('tp/tr')} AS recall, {d('2*(tp/gp)*(tp/tr)/(tp/gp+tp/tr)')} AS f1, b AS building_false_ground, v AS vegetation_false_ground,
 cv AS covered_ground, {d('cf/greatest(1, cv)')} AS covered_ground_recall FROM a""", "pts")
def _(spark, sf):
    p = te.pmf_ground(points_view(spark, sf)).withColumn("classification", F.expr("CASE WHEN classification = 5 THEN 4 ELSE classification END"))
    g = me.ground_review(p)
    return g.select(*[r(c).alias(c) if c in ("precision", "recall", "f1", "covered_ground_recall") else F.col(c) for c in g.columns])


def flagship(p: DataFrame) -> DataFrame:
    """Ground, terrain, height above ground and two-scale shape, summarised per class."""
    ground = te.pmf_ground(p)
    raster = te.dtm_raster(p, 1.0)
    heights = te.hag(ground, te.dtm(ground, raster), raster)
    # Only the query side needs the derived columns; neighbours are searched in the raw points.
    f = fe.compute_features(heights, [0.5, 1.0], ("neighbor_count", "linearity", "planarity", "sphericity"), support=p,
                            carry=("classification", "is_ground", "hag"))
    return f.groupBy("classification").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("is_ground").alias("ground_points"), F.avg("hag").alias("mean_hag"),
        *[F.avg(f"{n}_{t}").alias(f"mean_{n}_{t}") for t in ("r0p5", "r1") for n in ("neighbor_count", "linearity", "planarity", "sphericity")])


FLAG_COLUMNS = ", ".join(f"{d(f'avg({e})', 5)} AS mean_{n}_{t}" for t, a in (("r0p5", "ma"), ("r1", "mb")) for n, e in (
    ("neighbor_count", f"coalesce({a}m.n, 0)"), ("linearity", duck_ratio(f"{a}.l1-{a}.l2", f"{a}.l1")),
    ("planarity", duck_ratio(f"{a}.l2-{a}.l3", f"{a}.l1")), ("sphericity", duck_ratio(f"{a}.l3", f"{a}.l1"))))


@query("flagship_class_summary", f"""WITH {GP}, {duck_dtm(1.0)}, {duck_bilinear(1.0)}, {duck_pairs(1.0)}, {duck_moments(0.5, 'ma')}, {duck_moments(1.0, 'mb')}
SELECT look.classification, count(*) AS points, count(*) FILTER (WHERE is_ground) AS ground_points, {d('avg(look.z - terrain)', 5)} AS mean_hag, {FLAG_COLUMNS}
FROM look LEFT JOIN mam ON mam.q_id = point_id LEFT JOIN mbm ON mbm.q_id = point_id LEFT JOIN ma ON ma.q_id = point_id LEFT JOIN mb ON mb.q_id = point_id GROUP BY 1""", "pts")
def _(spark, sf):
    out = flagship(points_view(spark, sf))
    return out.select("classification", "points", "ground_points", *[r(c, 5).alias(c) for c in out.columns if c.startswith("mean_")])
