"""Queries over rule-based labels and connected structures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulseframe.operators import metrics as me, rules as ru, structures as st
from pulseframe.operators.features import compute_features
from pulseframe.plans.registry import d, query, r
from pulseframe.plans.views import labelled_view, points_view, scene_view, table

# A profile per customer, so that the one-row rules run over whole tables.
PROFILE = """SELECT o_custkey AS id, count(*) AS n, avg(o_totalprice)/1000000.0 AS spacing, CAST(count(*) AS DOUBLE)*1.5 AS density_2d, CAST(count(*) AS DOUBLE)*1.5 AS density,
 CAST(1 + o_custkey % 5 AS DOUBLE)/2.0 AS maximum, CAST(o_custkey % 50 AS DOUBLE) + 4.0 AS extent_x, CAST(o_custkey % 37 AS DOUBLE) + 3.0 AS extent_y,
 CAST(o_custkey % 11 AS DOUBLE)/10.0 AS valid_return_fraction, CAST(o_custkey % 9 AS DOUBLE)/9.0 AS last_return_fraction FROM {orders} GROUP BY o_custkey"""
DUCK_PROFILE = PROFILE.format(orders="orders")


def profile(spark, sf):
    return spark.sql(PROFILE.format(orders="{o}"), o=table(spark, sf, "orders"))


@query("vegetation_radii", f"""WITH p AS ({DUCK_PROFILE}), t AS (SELECT *, greatest(0.2, least(3.0, maximum)) AS top FROM p),
f AS (SELECT *, greatest(0.05, least(0.25, top/4, sqrt({16 / math.pi!r}::DOUBLE/density))) AS fine FROM t)
SELECT id, {d('fine')} AS radius_fine, {d('2*fine')} AS radius_mid, {d('least(top, 4*fine)')} AS radius_coarse FROM f""")
def _(spark, sf):
    return ru.vegetation_radii(profile(spark, sf)).select("id", *[r(c).alias(c) for c in ("radius_fine", "radius_mid", "radius_coarse")])


@query("suggest_radii_neighbours", f"""WITH p AS ({DUCK_PROFILE}), u AS (SELECT id, least(least(extent_x, extent_y)*0.25, sqrt(k/pi()/density_2d)) AS v FROM p, (VALUES (8.0::DOUBLE),(16),(32),(64),(128)) x(k)),
w AS (SELECT *, v - lag(v) OVER (PARTITION BY id ORDER BY v) AS gap FROM u)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS i, {d('v')} AS radius FROM w WHERE gap IS NULL OR gap > 1e-9*greatest(1, v)""")
def _(spark, sf):
    s = ru.suggest_radii_neighbours(profile(spark, sf)).select("id", F.posexplode("radii").alias("i", "v"))
    return s.select("id", "i", r("v").alias("radius"))


@query("suggest_radii_series", f"""WITH p AS ({DUCK_PROFILE}), l AS (SELECT id, extent_x, extent_y, spacing, greatest(4*spacing, 0.05) AS low FROM p), m AS (SELECT *, pow(10, floor(log10(low))) AS g FROM l),
f AS (SELECT *, g * CASE WHEN low/g <= 1 THEN 1 WHEN low/g <= 2 THEN 2 WHEN low/g <= 5 THEN 5 ELSE 10 END AS first FROM m),
s AS (SELECT id, k*pow(10, floor(log10(low))+e) AS v, first, least(least(extent_x, extent_y)/4, greatest(first, 256*spacing))*1.000001 AS top FROM f, (VALUES (1.0::DOUBLE),(2),(5)) a(k), unnest(range(6)) b(e)),
o AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS i FROM s WHERE v >= first*0.999999 AND v <= top)
SELECT id, i, {d('v')} AS radius FROM o WHERE i < 8""")
def _(spark, sf):
    s = ru.suggest_radii_series(profile(spark, sf)).select("id", F.posexplode("radii").alias("i", "v"))
    return s.select("id", "i", r("v").alias("radius"))


@query("suggest_radii_preset", f"""WITH p AS ({DUCK_PROFILE}), a AS (SELECT id, density_2d*CASE WHEN valid_return_fraction >= 0.9 THEN greatest(0.25, least(1, last_return_fraction)) ELSE 1 END AS dd,
 least(3.0, least(extent_x, extent_y)/4) AS up FROM p), b AS (SELECT id, greatest(0.1, least(up, floor(greatest(0.1, least(up, sqrt(k/pi()/dd)))*1000.0+0.5)/1000.0)) AS v FROM a, (VALUES (16.0::DOUBLE),(64),(256)) x(k) WHERE up >= 0.1),
c AS (SELECT DISTINCT id, v FROM b) SELECT id, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS i, {d('v')} AS radius FROM c""")
def _(spark, sf):
    s = ru.suggest_radii_preset(profile(spark, sf), 0.1, 3.0).select("id", F.posexplode("radii").alias("i", "v"))
    return s.select("id", "i", r("v").alias("radius"))


# Observations at three scales that follow from the point number.
def obs(k: int, name: str) -> str:
    return {"count": f"CAST((point_id*{7 + k}) % 40 AS DOUBLE)", "planarity": f"CASE WHEN point_id % {41 + k} = 0 THEN NULL ELSE CAST((point_id*{13 + 2 * k}) % 100 AS DOUBLE)/100.0 END",
            "scattering": f"CAST((point_id*{17 + k}) % 40 AS DOUBLE)/100.0", "variation": f"CAST((point_id*{19 + k}) % 100 AS DOUBLE)/1000.0",
            "roughness_ratio": f"CAST((point_id*{23 + k}) % 150 AS DOUBLE)/1000.0"}[name]


NAMES = ("count", "planarity", "scattering", "variation", "roughness_ratio")
SPARK_SCALES = "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {obs(k, n)}" for n in NAMES) + ")" for k in range(3)) + ")"
OK = {k: f"({obs(k, 'count')} >= 12 AND {obs(k, 'planarity')} IS NOT NULL)" for k in range(3)}
T = dict(planar=0.5, scattering=0.12, variation=0.04, roughness_ratio=0.06, near_ground=0.15, minimum_neighbors=12, preset=1)


def observed(spark, sf):
    return labelled_view(spark, sf).withColumn("scales", F.expr(SPARK_SCALES)).withColumn(
        "classification", F.expr("CASE WHEN point_id % 19 = 0 THEN 7 ELSE classification END"))


ADAPT = " UNION ALL ".join(f"SELECT {', '.join(f'{obs(k, n)} AS {n}' for n in NAMES)} FROM smp" for k in range(3))


@query("adapt_thresholds", f"""WITH smp AS (SELECT * FROM lab WHERE NOT is_ground AND NOT (point_id % 19 = 0)), o AS (SELECT * FROM ({ADAPT}) WHERE count >= 12 AND planarity IS NOT NULL)
SELECT {d('greatest(0.40, least(0.65, quantile_cont(planarity, 0.7)))')} AS planar, {d('greatest(0.08, least(0.25, quantile_cont(scattering, 0.55)))*1.15')} AS scattering,
 {d('greatest(0.025, least(0.08, quantile_cont(variation, 0.55)))*1.15')} AS variation, {d('greatest(0.03, least(0.12, quantile_cont(roughness_ratio, 0.55)))*1.15')} AS roughness_ratio, 0.25::DOUBLE AS near_ground FROM o""", "lab")
def _(spark, sf):
    t = ru.adapt_thresholds(ru.threshold_rows(observed(spark, sf)), preset=0)
    return t.select(*[r(c).alias(c) for c in ("planar", "scattering", "variation", "roughness_ratio")], "near_ground")


def _plane(k):
    return f"({obs(k, 'planarity')} >= 0.5 AND {obs(k, 'variation')} <= 0.035)"


def _votes(k):
    return f"(({obs(k, 'scattering')} >= 0.12)::INT + ({obs(k, 'variation')} >= 0.04)::INT + ({obs(k, 'roughness_ratio')} >= 0.06)::INT)"


DECIDE = f"""t AS (SELECT point_id, is_ground, hag, CASE WHEN point_id % 19 = 0 THEN 7 ELSE classification END AS code, number_of_returns > 1 AS multi,
 {', '.join(f'{OK[k]} AS ok{k}, {_plane(k)} AS pl{k}, {_votes(k)} AS vo{k}, {obs(k, "planarity")} < 0.5 AS lo{k}, ({obs(k, "scattering")} >= 0.12 OR {obs(k, "variation")} >= 0.04) AS di{k}' for k in range(3))} FROM lab),
u AS (SELECT *, ok0::INT+ok1::INT+ok2::INT AS nv, (ok0 AND pl0)::INT+(ok1 AND pl1)::INT+(ok2 AND pl2)::INT AS np,
 (ok0 AND vo0 >= 2 AND lo0)::INT+(ok1 AND vo1 >= 2 AND lo1)::INT+(ok2 AND vo2 >= 2 AND lo2)::INT AS nvol,
 CASE WHEN ok0 THEN vo0/3.0::DOUBLE ELSE 0 END + CASE WHEN ok1 THEN vo1/3.0::DOUBLE ELSE 0 END + CASE WHEN ok2 THEN vo2/3.0::DOUBLE ELSE 0 END AS sc,
 CASE WHEN ok0 THEN pl0 WHEN ok1 THEN pl1 ELSE pl2 END AS fpl, CASE WHEN ok0 THEN lo0 AND di0 WHEN ok1 THEN lo1 AND di1 ELSE lo2 AND di2 END AS fvol FROM t),
w AS (SELECT *, CASE WHEN is_ground THEN 1 WHEN code IN (7,9,18,22) THEN 2 WHEN hag < 0 THEN 3 WHEN nv < 2 THEN 4 WHEN fpl THEN 5 WHEN hag < 0.15 THEN 6 WHEN nvol >= 2 AND fvol THEN 7 WHEN np >= 2 THEN 8 ELSE 9 END AS reason FROM u),
dec AS (SELECT *, CASE reason WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 7 THEN 1 WHEN 8 THEN 2 WHEN 5 THEN CASE WHEN np >= 2 THEN 2 ELSE 0 END ELSE 0 END AS category,
 CASE WHEN reason <= 4 THEN 0 ELSE greatest(0, least(1, sc/nv + CASE WHEN multi THEN 0.03 ELSE 0 END)) END AS evidence FROM w)"""


def decided(spark, sf):
    return ru.vegetation_decide(observed(spark, sf), T, multiple=F.col("number_of_returns") > 1)


@query("vegetation_decide", f"WITH {DECIDE} SELECT point_id, category::INT AS category, reason::INT AS reason, {d('evidence')} AS evidence FROM dec", "lab")
def _(spark, sf):
    return decided(spark, sf).select("point_id", "category", "reason", r("evidence").alias("evidence"))


@query("reason_histogram", f"WITH {DECIDE} SELECT category::INT AS category, reason::INT AS reason, count(*) AS n FROM dec GROUP BY ROLLUP(category, reason)", "lab")
def _(spark, sf):
    return me.reason_histogram(decided(spark, sf))


@query("binary_audit", f"""WITH {DECIDE}, a AS (SELECT category = 1 AS p, code IN (3,4,5) AS t, category = 0 AS un FROM dec JOIN (SELECT point_id, trusted_class FROM lab) USING (point_id)
 WHERE NOT is_ground AND trusted_class = code AND code >= 2 AND code NOT IN (7,18,22)), c AS (SELECT count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp, count(*) FILTER (WHERE NOT p AND t) AS fn,
 count(*) FILTER (WHERE NOT p AND NOT t) AS tn, count(*) FILTER (WHERE un) AS uncertain FROM a)
SELECT *, {d('CASE WHEN tp+fp > 0 THEN tp/(tp+fp) END')} AS precision, {d('CASE WHEN tp+fn > 0 THEN tp/(tp+fn) END')} AS recall FROM c""", "lab")
def _(spark, sf):
    x = decided(spark, sf)
    code = F.col("classification")
    scope = ~F.col("is_ground") & (F.col("trusted_class") == code) & (code >= 2) & ~code.isin(7, 18, 22)
    a = me.binary_audit(x, F.col("category") == 1, code.isin(3, 4, 5), scope, F.col("category") == 0)
    return a.select("tp", "fp", "fn", "tn", "uncertain", r("precision").alias("precision"), r("recall").alias("recall"))


@query("height_class", "SELECT point_id, CASE WHEN hag IS NULL THEN 1 WHEN hag <= 2 THEN 3 WHEN hag <= 5 THEN 4 ELSE 5 END AS vegetation_class FROM lab", "lab")
def _(spark, sf):
    return labelled_view(spark, sf).select("point_id", ru.height_class(F.col("hag")).alias("vegetation_class"))


@query("score_threshold", "SELECT point_id, CASE WHEN is_ground THEN 3 WHEN code IN (7,9,18,22) THEN 4 WHEN score >= 0.5 THEN 1 ELSE 0 END AS score_class FROM (SELECT *, CASE WHEN point_id % 19 = 0 THEN 7 ELSE classification END AS code FROM lab)", "lab")
def _(spark, sf):
    return ru.score_threshold(observed(spark, sf), 0.5).select("point_id", "score_class")


LAST = "(return_number = number_of_returns)"
PLANAR = "(planarity_r2 >= 0.65 AND sphericity_r2 <= 0.12 AND planarity_r4 >= 0.45 AND sphericity_r4 <= 0.20)"
VOX = "floor(x)::BIGINT AS vx, floor(y)::BIGINT AS vy, floor(z)::BIGINT AS vz"
PATCH = f"""pa AS (SELECT {VOX}, count(*) FILTER (WHERE normal_z_absolute_r2 <= 0.25) AS wall, count(*) FILTER (WHERE normal_z_absolute_r2 >= 0.35) AS roof
 FROM scene WHERE NOT is_ground AND {LAST} AND {PLANAR} AND (normal_z_absolute_r2 <= 0.25 OR normal_z_absolute_r2 >= 0.35) GROUP BY ALL)"""


def reach(cells: str, name: str) -> str:
    """Recursive CTEs: smallest cell number reachable from each cell."""
    return f"""{name}n AS (SELECT *, (vx*100000 + vy)*1000 + vz AS id FROM {cells}),
{name}e AS (SELECT a.id AS u, b.id AS v FROM {name}n a JOIN {name}n b ON b.vx BETWEEN a.vx-1 AND a.vx+1 AND b.vy BETWEEN a.vy-1 AND a.vy+1 AND b.vz BETWEEN a.vz-1 AND a.vz+1 AND a.id <> b.id),
{name}r(src, dst) AS (SELECT id, id FROM {name}n UNION SELECT r.src, e.v FROM {name}r r JOIN {name}e e ON r.dst = e.u),
{name} AS (SELECT n.*, c.comp FROM {name}n n JOIN (SELECT dst, min(src) AS comp FROM {name}r GROUP BY dst) c ON c.dst = n.id)"""


ACCEPT = f"""{PATCH}, {reach('pa', 'co')}, ac AS (SELECT comp, count(*) AS cells, count(*) FILTER (WHERE wall >= 3) AS wall_cells, count(*) FILTER (WHERE roof >= 3) AS roof_cells,
 max(vz) FILTER (WHERE wall >= 3) - min(vz) FILTER (WHERE wall >= 3) AS wh, greatest(max(vx) FILTER (WHERE wall >= 3) - min(vx) FILTER (WHERE wall >= 3), max(vy) FILTER (WHERE wall >= 3) - min(vy) FILTER (WHERE wall >= 3)) AS ws,
 least(max(vx) FILTER (WHERE roof >= 3) - min(vx) FILTER (WHERE roof >= 3), max(vy) FILTER (WHERE roof >= 3) - min(vy) FILTER (WHERE roof >= 3)) AS rw FROM co GROUP BY comp),
good AS (SELECT comp FROM ac WHERE cells >= 12 AND wall_cells >= 3 AND roof_cells >= 6 AND wh >= 2 AND ws >= 2 AND rw >= 2), sok AS (SELECT vx, vy, vz FROM co WHERE comp IN (SELECT comp FROM good))"""


@query("structure_patches", f"WITH {PATCH} SELECT * FROM pa", "scene")
def _(spark, sf):
    return st.patches(scene_view(spark, sf))


@query("structure_components", f"""WITH /*recursive*/ {PATCH}, {reach('pa', 'co')}, f AS (SELECT comp, min(vx) AS fx, min(vy) AS fy, min(vz) AS fz, count(*) AS size FROM co GROUP BY comp)
SELECT vx, vy, vz, fx, fy, fz, size FROM co JOIN f USING (comp)""", "scene")
def _(spark, sf):
    # Components compared by their extent and size: the numbering is ours.
    c = st.components(st.patches(scene_view(spark, sf)))
    per = c.groupBy("component").agg(F.min("vx").alias("fx"), F.min("vy").alias("fy"), F.min("vz").alias("fz"), F.count(F.lit(1)).alias("size"))
    return c.join(per, "component").select("vx", "vy", "vz", "fx", "fy", "fz", "size")


@query("structure_acceptance", f"""WITH /*recursive*/ {ACCEPT} SELECT cells, wall_cells, roof_cells, comp IN (SELECT comp FROM good) AS accepted, count(*) AS n FROM ac GROUP BY ALL""", "scene")
def _(spark, sf):
    p = st.patches(scene_view(spark, sf))
    a = st.accept_structures(p.join(st.components(p), list(st.VOXEL)))
    return a.groupBy("cells", "wall_cells", "roof_cells", "accepted").agg(F.count(F.lit(1)).alias("n"))


LIN = "hag >= 0.15 AND linearity_r2 >= 0.85 AND linearity_r4 >= 0.75 AND sphericity_r2 <= 0.08 AND sphericity_r4 <= 0.10 AND planarity_r2 < 0.25"
WIRE = "hag >= 2 AND z_range_r2 BETWEEN 0 AND 1 AND z_range_r4 BETWEEN 0 AND 2"
POLE = "z_range_r2 >= 2.5 AND z_range_r4 >= 3"
LINEAR = f"""li AS (SELECT CASE WHEN {WIRE} THEN 'wire' WHEN {POLE} THEN 'pole' END AS kind, {VOX}, min(hag) AS low, max(hag) AS high FROM scene WHERE NOT is_ground AND {LIN} AND ({WIRE} OR {POLE}) GROUP BY ALL),
wi AS (SELECT * FROM li WHERE kind = 'wire'), po AS (SELECT * FROM li WHERE kind = 'pole'), {reach('wi', 'wc')}, {reach('po', 'pc')},
wg AS (SELECT comp FROM wc GROUP BY comp HAVING count(*) >= 12 AND greatest(max(vx)-min(vx), max(vy)-min(vy)) >= 12 AND least(max(vx)-min(vx), max(vy)-min(vy)) <= greatest(4, 0.2*greatest(max(vx)-min(vx), max(vy)-min(vy)))
 AND max(vz)-min(vz) <= 0.25*greatest(max(vx)-min(vx), max(vy)-min(vy)) + 1), wok AS (SELECT vx, vy, vz FROM wc WHERE comp IN (SELECT comp FROM wg)),
pg AS (SELECT comp, max(vz) AS top FROM pc GROUP BY comp HAVING count(*) >= 4 AND max(vz)-min(vz) >= 3 AND max(vx)-min(vx) <= 1 AND max(vy)-min(vy) <= 1 AND min(low) <= 0.75 AND max(high) >= 3),
ph AS (SELECT DISTINCT pc.comp FROM pc JOIN pg USING (comp) JOIN wok w ON w.vx BETWEEN pc.vx-2 AND pc.vx+2 AND w.vy BETWEEN pc.vy-2 AND pc.vy+2 AND w.vz BETWEEN pc.vz-2 AND pc.vz+2 WHERE pc.vz >= top-1),
pok AS (SELECT vx, vy, vz FROM pc WHERE comp IN (SELECT comp FROM ph))"""


@query("linear_objects", f"WITH /*recursive*/ {LINEAR} SELECT vx, vy, vz, 'wire' AS kind FROM wok UNION ALL SELECT vx, vy, vz, 'pole' FROM pok", "scene")
def _(spark, sf):
    return st.linear_objects(scene_view(spark, sf))


def semantic_sql(requested: set[int], planar: str, accept: str, linear: bool, hag_low=2, hag_mid=5) -> str:
    """The class rules in SQL; ends in ``sem(point_id, label, score, reason)``."""
    wants = {c: "true" if c in requested else "false" for c in (6, 128, 129, 130, 131)}
    lin = f", {LINEAR}" if linear else ""
    flags = ", (vx,vy,vz) IN (SELECT (vx,vy,vz) FROM wok) AS inw, (vx,vy,vz) IN (SELECT (vx,vy,vz) FROM pok) AS inp" if linear else ", false AS inw, false AS inp"
    veg = ", ".join(str(c) for c in (3, 4, 5) if c in requested) or "-1"
    return f"""{accept}{lin}, sv AS (SELECT *, {VOX} FROM scene),
m1 AS (SELECT *, (vx,vy,vz) IN (SELECT (vx,vy,vz) FROM sok) AS ins{flags}, {LAST} AS last_, coalesce({planar}, false) AS plan_,
 CASE WHEN normal_z_absolute_r2 <= 0.25 THEN 129 WHEN normal_z_absolute_r2 >= 0.35 THEN 128 ELSE 1 END AS surf, CASE WHEN hag IS NULL THEN 1 WHEN hag <= {hag_low} THEN 3 WHEN hag <= {hag_mid} THEN 4 ELSE 5 END AS veg FROM sv),
m2 AS (SELECT *, last_ AND ins AND plan_ AS stc FROM m1),
m3 AS (SELECT *, CASE WHEN stc AND surf = 128 AND {wants[128]} THEN 128 WHEN stc AND surf = 129 AND {wants[129]} THEN 129 WHEN stc AND surf <> 1 AND {wants[6]} THEN 6 ELSE 1 END AS k1 FROM m2),
m4 AS (SELECT *, CASE WHEN k1 <> 1 THEN k1 WHEN {wants[131]} AND inw AND {LIN} AND {WIRE} THEN 131 WHEN {wants[130]} AND inp AND {LIN} AND {POLE} THEN 130 ELSE 1 END AS k2,
 CASE WHEN k1 <> 1 THEN CASE WHEN surf = 129 THEN 3 ELSE 2 END WHEN stc THEN 9 ELSE 8 END AS q1 FROM m3),
m5 AS (SELECT *, k2 = 1 AND coalesce(sphericity_r2 >= 0.18 AND sphericity_r4 >= 0.18 AND planarity_r2 < 0.6 AND planarity_r4 < 0.6, false) AS disp FROM m4),
m6 AS (SELECT *, CASE WHEN disp AND hag >= 0.15 AND veg IN ({veg}) THEN veg ELSE k2 END AS k3,
 CASE WHEN k2 = 131 THEN 6 WHEN k2 = 130 THEN 7 WHEN disp AND hag >= 0.15 THEN CASE WHEN veg IN ({veg}) THEN 4 ELSE 9 END WHEN disp THEN 5 ELSE q1 END AS q3 FROM m5),
m7 AS (SELECT *, CASE WHEN k3 = 1 AND q3 = 8 AND planarity_r2 >= 0.65 THEN CASE WHEN last_ THEN 11 ELSE 10 END ELSE q3 END AS q4, planarity_r2 IS NULL OR sphericity_r2 IS NULL AS miss FROM m6),
sem AS (SELECT *, CASE WHEN is_ground THEN 2 WHEN miss THEN 1 ELSE k3 END AS label, CASE WHEN is_ground THEN 1.0 WHEN miss THEN 0.0 WHEN k3 IN (6,128,129) THEN 0.8 WHEN k3 IN (130,131) THEN 0.75 WHEN k3 IN (3,4,5) THEN 0.7 ELSE 0.0 END::DOUBLE AS score,
 CASE WHEN is_ground THEN 1 WHEN miss THEN 12 ELSE q4 END AS reason FROM m7)"""


@query("semantic_classify", f"""WITH /*recursive*/ {semantic_sql({3, 4, 5, 128, 129, 130, 131}, PLANAR, ACCEPT, True)} SELECT point_id, label::INT AS semantic_class, score AS semantic_score, reason::INT AS semantic_reason FROM sem""", "scene")
def _(spark, sf):
    s = st.semantic_classify(scene_view(spark, sf), {3, 4, 5, 128, 129, 130, 131})
    return s.select("point_id", "semantic_class", "semantic_score", "semantic_reason")


CLEAN = """cl AS (SELECT *, CASE WHEN is_ground OR working_class NOT IN (6,128,129) THEN 0 WHEN label = 6 THEN 1 WHEN label IN (3,4,5) OR reason = 5 THEN 2
 WHEN return_number < number_of_returns THEN 3 WHEN reason = 12 THEN 5 ELSE 4 END AS status FROM sem)"""


@query("clean_buildings", f"""WITH /*recursive*/ {semantic_sql({3, 4, 5, 6}, PLANAR, ACCEPT, False)}, {CLEAN}
SELECT point_id, status::INT AS clean_status, CASE status WHEN 2 THEN CASE WHEN label IN (3,4,5) THEN label ELSE 1 END WHEN 3 THEN 1 WHEN 4 THEN 1 END::INT AS clean_proposal FROM cl""", "scene")
def _(spark, sf):
    return st.clean_buildings(scene_view(spark, sf), aggressive=True).select("point_id", "clean_status", "clean_proposal")


STRICT_PLANAR = "(planarity_r2 >= 0.75 AND sphericity_r2 <= 0.08 AND planarity_r4 >= 0.60 AND sphericity_r4 <= 0.12)"
STRICT = semantic_sql({3, 4, 5, 6}, STRICT_PLANAR, ACCEPT.replace(PLANAR, STRICT_PLANAR).replace("ws >= 2 AND rw >= 2", "ws >= 3 AND rw >= 3"), False).replace("planarity_r2 >= 0.65 THEN CASE", "planarity_r2 >= 0.75 THEN CASE")


@query("clean_buildings_strict_tally", f"""WITH /*recursive*/ {STRICT}, {CLEAN}
SELECT status::INT AS clean_status, count(*) AS n, count(*) FILTER (WHERE status IN (2, 3)) AS changes FROM cl GROUP BY 1""", "scene")
def _(spark, sf):
    return st.cleaning_tally(st.clean_buildings(scene_view(spark, sf), strict=True))


@query("vegetation_vector")
def _(spark, sf):
    f = compute_features(points_view(spark, sf), [0.75, 1.5], (
        "planarity", "sphericity", "surface_variation", "linearity", "normal_z_absolute", "barycenter_offset_ratio", "roughness", "z_range",
        "z_standard_deviation", "eigenvalues_sum", "pca_1", "pca_2", "neighbor_count"))
    v = ru.vegetation_vector(f, 0.75, 1.5)
    return v.select("point_id", *[c for c in v.columns if c.startswith("v_")], "supported")
