"""Queries over metrics, learning, the label ledger and tile jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pulseframe.operators import attach, ledger as le, learning as ml, metrics as me, tiling as ti
from pulseframe.operators.features import compute_features
from pulseframe.plans.queries_select import duck_mix
from pulseframe.plans.registry import d, query, r
from pulseframe.plans.views import labelled_view, points_view, table
from pulseframe.session import cut_lineage, shared_folder
from pulseframe.sources import sinks
from pulseframe.streaming import progress as sp, tiles as stt

SCORED = "s AS (SELECT classification AS t, pred_class AS p FROM lab WHERE pred_class >= 0)"


def scored(spark, sf):
    return labelled_view(spark, sf).where("pred_class >= 0").withColumn("true_class", F.col("classification"))


@query("confusion", f"WITH {SCORED} SELECT t AS true_class, p AS pred_class, count(*) AS n FROM s GROUP BY ALL", "lab")
def _(spark, sf):
    return me.confusion(scored(spark, sf))


@query("confusion_matrix", f"WITH {SCORED} SELECT t AS true_class, count(*) FILTER (WHERE p = 2) AS p2, count(*) FILTER (WHERE p = 5) AS p5, count(*) FILTER (WHERE p = 6) AS p6 FROM s GROUP BY t", "lab")
def _(spark, sf):
    return me.confusion_matrix(scored(spark, sf))


METRIC = f"""{SCORED}, c AS (SELECT DISTINCT t AS c FROM s UNION SELECT p FROM s), k AS (SELECT c, count(*) FILTER (WHERE t = c) AS support, count(*) FILTER (WHERE p = c) AS claimed,
 count(*) FILTER (WHERE t = c AND p = c) AS hit FROM s, c GROUP BY c), m AS (SELECT *, coalesce(hit/nullif(claimed,0), 0) AS pr, coalesce(hit/nullif(support,0), 0) AS re FROM k),
f AS (SELECT *, CASE WHEN pr+re > 0 THEN 2*pr*re/(pr+re) ELSE 0 END AS f1, CASE WHEN pr+re-pr*re > 0 THEN pr*re/(pr+re-pr*re) ELSE 0 END AS iou FROM m)"""


@query("class_metrics", f"WITH {METRIC} SELECT c AS class_code, {d('pr')} AS precision, {d('re')} AS recall, {d('f1')} AS f1, {d('iou')} AS iou, support, claimed, hit FROM f", "lab")
def _(spark, sf):
    m = me.class_metrics(me.confusion(scored(spark, sf)))
    return m.select("class_code", *[r(c).alias(c) for c in ("precision", "recall", "f1", "iou")], "support", "claimed", "hit")


@query("overall_metrics", f"""WITH {METRIC}, a AS (SELECT sum(support)::BIGINT AS n, sum(hit)/sum(support) AS po, sum(support*claimed)/(sum(support)*sum(support)::DOUBLE) AS pe, avg(re) AS ba, avg(f1) AS mf, avg(iou) AS mi FROM f WHERE support > 0)
SELECT n, {d('po')} AS accuracy, {d('ba')} AS balanced_accuracy, {d('(po-pe)/(1-pe)')} AS cohen_kappa, {d('mf')} AS macro_f1, {d('mi')} AS macro_iou, 1 AS classes_not_tested, 1 AS classes_not_trained, false AS validation_complete FROM a""", "lab")
def _(spark, sf):
    m = me.overall_metrics(me.confusion(scored(spark, sf)), [2, 5, 9])
    return m.select("n", *[r(c).alias(c) for c in ("accuracy", "balanced_accuracy", "cohen_kappa", "macro_f1", "macro_iou")],
                    "classes_not_tested", "classes_not_trained", "validation_complete")


QN = (("percentile_10", .1), ("percentile_25", .25), ("median", .5), ("percentile_75", .75), ("percentile_90", .9))


@query("class_distributions", f"""WITH u AS (SELECT classification, 'z' AS feature, z AS v FROM pts UNION ALL SELECT classification, 'intensity', intensity FROM pts)
SELECT classification AS class_code, feature, count(*) AS class_population, count(v) AS valid, {', '.join(f'{d(f"quantile_cont(v, {p})")} AS {n}' for n, p in QN)}
FROM u GROUP BY ALL""", "pts")
def _(spark, sf):
    c = me.class_distributions(points_view(spark, sf), ["z", "intensity"])
    return c.select("class_code", "feature", "class_population", "valid", *[r(n).alias(n) for n, _ in QN])


@query("block_class_histogram", "SELECT floor((x-x0)/4)::BIGINT AS block_col, floor((y-y0)/4)::BIGINT AS block_row, classification AS class_code, count(*) AS n FROM pts, (SELECT min(x) x0, min(y) y0 FROM pts) GROUP BY ALL", "pts")
def _(spark, sf):
    return me.block_class_histogram(points_view(spark, sf), 4.0)


@query("prediction_stats", f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY confidence, point_id) - 1 AS i, count(*) OVER () AS n FROM lab WHERE pred_class >= 0 AND confidence IS NOT NULL),
c AS (SELECT trusted_class AS c, count(*) AS n, count(*) FILTER (WHERE trusted_class = pred_class) AS hit FROM v WHERE trusted_class IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM lab) AS row_count, count(*) AS valid, {d('avg(confidence)')} AS mean_confidence, {', '.join(f'{d(f"max(confidence) FILTER (WHERE i = floor({p}*(n-1)+0.5))")} AS confidence_p{int(p * 100)}' for p in (.1, .5, .9))},
 (SELECT sum(n)::BIGINT FROM c) AS trusted_compared, {d('(SELECT sum(hit)/sum(n) FROM c)')} AS trusted_accuracy, {d('(SELECT avg(hit/n) FROM c)')} AS trusted_balanced_recall FROM v""", "lab")
def _(spark, sf):
    p = me.prediction_stats(labelled_view(spark, sf), "trusted_class")
    whole = ("row_count", "valid", "trusted_compared")
    return p.select(*[F.col(c) if c in whole else r(c).alias(c) for c in p.columns])


@query("prediction_shares", f"SELECT pred_class, count(*) AS n, {d('count(*)/(sum(count(*)) OVER ())')} AS share FROM lab WHERE pred_class >= 0 AND confidence IS NOT NULL GROUP BY 1", "lab")
def _(spark, sf):
    return me.prediction_shares(labelled_view(spark, sf)).select("pred_class", "n", r("share").alias("share"))


@query("content_fingerprint")
def _(spark, sf):
    return me.content_fingerprint(points_view(spark, sf), ["point_id", "x", "y", "z", "classification"])


VERSION = "CASE WHEN point_id % 50 = 0 THEN 9 ELSE classification END"


@query("compare_versions", f"""WITH a AS (SELECT * FROM pts WHERE point_id % 101 <> 0), b AS (SELECT point_id, x, y, z, {VERSION} AS classification, CASE WHEN point_id % 77 = 0 THEN NULL ELSE intensity END AS intensity FROM pts WHERE point_id % 103 <> 0),
j AS (SELECT a.point_id AS ai, b.point_id AS bi, coalesce(a.point_id, b.point_id) AS i, a.x IS DISTINCT FROM b.x AS dx, a.classification IS DISTINCT FROM b.classification AS dc, a.intensity IS DISTINCT FROM b.intensity AS dn FROM a FULL JOIN b USING (point_id))
SELECT 'only_in_first' AS "check", count(*) FILTER (WHERE bi IS NULL) AS differences, min(i) FILTER (WHERE bi IS NULL) AS first_id FROM j UNION ALL SELECT 'only_in_second', count(*) FILTER (WHERE ai IS NULL), min(i) FILTER (WHERE ai IS NULL) FROM j
UNION ALL SELECT 'x', count(*) FILTER (WHERE dx), min(i) FILTER (WHERE dx) FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL UNION ALL SELECT 'classification', count(*) FILTER (WHERE dc), min(i) FILTER (WHERE dc) FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL
UNION ALL SELECT 'intensity', count(*) FILTER (WHERE dn), min(i) FILTER (WHERE dn) FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    b = p.where("point_id % 103 <> 0").withColumns({"classification": F.expr(VERSION), "intensity": F.expr("CASE WHEN point_id % 77 = 0 THEN NULL ELSE intensity END")})
    return me.compare_versions(p.where("point_id % 101 <> 0"), b, ["x", "classification", "intensity"])


@query("attach_predictions", "SELECT point_id, classification, CASE WHEN score < 0.7 THEN pred_class END AS pred_class FROM lab WHERE is_trusted", "lab")
def _(spark, sf):
    lab = labelled_view(spark, sf).withColumn("is_core", F.col("is_trusted"))
    preds = lab.where("score < 0.7").select("point_id", "pred_class", "is_core")
    return attach.attach_predictions(lab.drop("pred_class"), preds).select("point_id", "classification", "pred_class")


HELD = "SELECT DISTINCT floor((x-x0)/4)::BIGINT AS c, floor((y-y0)/4)::BIGINT AS rr FROM pts, o WHERE (floor((x-x0)/4) + 3*floor((y-y0)/4)) % 7 = 0"


@query("buffer_exclude", f"""WITH o AS (SELECT min(x) x0, min(y) y0 FROM pts), held AS ({HELD}), k AS (SELECT pts.*, floor((x-x0)/4)::BIGINT AS c, floor((y-y0)/4)::BIGINT AS rr, x0, y0 FROM pts, o),
tr AS (SELECT * FROM k WHERE (c, rr) NOT IN (SELECT (c, rr) FROM held))
SELECT point_id FROM tr WHERE NOT EXISTS (SELECT 1 FROM held h WHERE greatest(x0+h.c*4-x, x-(x0+h.c*4+4), 0)*greatest(x0+h.c*4-x, x-(x0+h.c*4+4), 0)+greatest(y0+h.rr*4-y, y-(y0+h.rr*4+4), 0)*greatest(y0+h.rr*4-y, y-(y0+h.rr*4+4), 0) <= 0.64)""", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    low = p.agg(F.min("x"), F.min("y")).first()
    keyed = me.block_index(p, 4.0, (low[0], low[1]))
    held = keyed.select("block_col", "block_row").distinct().where((F.col("block_col") + 3 * F.col("block_row")) % 7 == 0)
    train = keyed.join(held, ["block_col", "block_row"], "left_anti")
    return attach.buffer_exclude(train, held, 4.0, (low[0], low[1]), 0.8).select("point_id")


@query("shared_keys", "SELECT point_id FROM pts WHERE x < 8 AND z > 1", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    return attach.shared_keys(p.where("x < 8"), p.where("z > 1"), ["point_id"])


@query("argmax_class", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, list_position(e, list_max(e))::INT - 1 AS best FROM v""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    return e.select("vec_id", ml.argmax_class(F.col("e"), list(range(64))).alias("best"))


@query("trusted_rows", "SELECT point_id FROM lab WHERE pred_class >= 0 AND pred_class = trusted_class AND intensity IS NOT NULL AND score IS NOT NULL", "lab")
def _(spark, sf):
    return ml.trusted_rows(labelled_view(spark, sf), ["intensity", "score"], working="pred_class").select("point_id")


HIST = "hi AS (SELECT floor((x-x0)/5)::BIGINT AS bc, floor((y-y0)/5)::BIGINT AS br, classification AS c, count(*) AS n FROM pts, (SELECT min(x) x0, min(y) y0 FROM pts) GROUP BY ALL)"
SPLIT = f"""{HIST}, bl AS (SELECT DISTINCT bc, br FROM hi), dr AS (SELECT bc, br, k, row_number() OVER (PARTITION BY k ORDER BY {duck_mix(['bc', 'br', 'k'], 42)}, bc, br) <= ceil((SELECT count(*) FROM bl)*0.3) AS te FROM bl, unnest(range(96)) u(k)),
pc AS (SELECT k, c, sum(CASE WHEN te THEN n ELSE 0 END) AS te, sum(CASE WHEN te THEN 0 ELSE n END) AS tr FROM hi JOIN dr USING (bc, br) GROUP BY ALL),
sc AS (SELECT k, count(*) FILTER (WHERE tr = 0) AS mtr, count(*) FILTER (WHERE te = 0) AS mte, sum(te) AS rows FROM pc GROUP BY k)"""


@query("split_scores", f"""WITH {SPLIT} SELECT k::INT AS candidate, mtr AS missing_train, mte AS missing_test, rows::BIGINT AS test_rows, {d('mte*10.0+abs(rows-(SELECT sum(n) FROM hi)*0.3)/(SELECT sum(n) FROM hi)')} AS score FROM sc""", "pts")
def _(spark, sf):
    s = ml.split_scores(cut_lineage(me.block_class_histogram(points_view(spark, sf), 5.0)), 0.3, 42, 96)
    return s.select("candidate", "missing_train", "missing_test", "test_rows", r("score").alias("score"))


@query("spatial_split", f"""WITH {SPLIT}, best AS (SELECT k FROM sc WHERE mtr = 0 ORDER BY mte*10.0+abs(rows-(SELECT sum(n) FROM hi)*0.3)/(SELECT sum(n) FROM hi), k LIMIT 1), tb AS (SELECT bc, br FROM dr JOIN best USING (k) WHERE te),
q AS (SELECT classification, (floor((x-x0)/5)::BIGINT, floor((y-y0)/5)::BIGINT) IN (SELECT (bc, br) FROM tb) AS te FROM pts, (SELECT min(x) x0, min(y) y0 FROM pts))
SELECT CASE WHEN te THEN 'test' ELSE 'train' END AS part, classification, count(*) AS n FROM q GROUP BY ALL""", "pts")
def _(spark, sf):
    s = ml.spatial_split(points_view(spark, sf), block_size=5.0, fraction=0.3)
    both = s.train.select("classification", F.lit("train").alias("part")).unionByName(s.test.select("classification", F.lit("test").alias("part")))
    return both.groupBy("part", "classification").agg(F.count(F.lit(1)).alias("n"))


@query("cap_per_class", f"SELECT point_id FROM (SELECT point_id, row_number() OVER (PARTITION BY classification ORDER BY {duck_mix(['point_id'], 42)}, point_id) AS rn FROM pts) WHERE rn <= 1500", "pts")
def _(spark, sf):
    return ml.cap_per_class(points_view(spark, sf), 1500).select("point_id")


@query("impute_median", f"""WITH m AS (SELECT quantile_cont(intensity, 0.5) AS mi, quantile_cont(score, 0.5) AS ms FROM lab WHERE is_trusted)
SELECT point_id, {d('coalesce(intensity, mi)')} AS intensity, {d('coalesce(score, ms)')} AS score, (intensity IS NULL)::INT::DOUBLE AS intensity_missing, (score IS NULL)::INT::DOUBLE AS score_missing FROM lab, m""", "lab")
def _(spark, sf):
    lab = labelled_view(spark, sf)
    out = ml.impute_median(lab.where("is_trusted"), ["intensity", "score", "z"]).apply(lab)
    return out.select("point_id", r("intensity").alias("intensity"), r("score").alias("score"), "intensity_missing", "score_missing")


@query("standardize", f"SELECT point_id, {d('(x-mx)/sx')} AS x, {d('(z-mz)/sz')} AS z FROM pts, (SELECT avg(x) mx, stddev_pop(x) sx, avg(z) mz, stddev_pop(z) sz FROM pts WHERE classification = 2)", "pts")
def _(spark, sf):
    p = points_view(spark, sf)
    prep = ml.standardize(p.where("classification = 2"), ml.Preprocessor(["x", "z"], {}, []))
    return prep.apply(p).select("point_id", r("x").alias("x"), r("z").alias("z"))


@query("cluster_output_mapping", f"""WITH q AS (SELECT point_id, classification = 2 AS g, intensity IS NOT NULL AS ok, least(floor(z), 3)::INT AS raw, 1.0::DOUBLE/(1+abs(z)) AS c FROM pts)
SELECT point_id, CASE WHEN g THEN 0 WHEN ok THEN raw+1 ELSE -1 END AS cluster_id, {d('CASE WHEN g THEN 1 WHEN ok THEN c ELSE 0 END')} AS cluster_confidence FROM q""", "pts")
def _(spark, sf):
    m = ml.map_clusters(F.least(F.floor("z"), F.lit(3)).cast("int"), 1.0 / (1 + F.abs("z")), F.col("intensity").isNotNull(), F.col("classification") == 2)
    return points_view(spark, sf).withColumns(m).select("point_id", "cluster_id", r("cluster_confidence").alias("cluster_confidence"))


def training_cloud(spark, sf) -> DataFrame:
    """Points with a few real neighbourhood features, written once."""
    f = compute_features(points_view(spark, sf), [1.0], ("planarity", "z_range", "z_standard_deviation", "z_above_minimum"), carry=("x", "y", "z", "classification", "intensity"))
    return cut_lineage(f)


FEATURES = ["planarity_r1", "z_range_r1", "z_standard_deviation_r1", "z_above_minimum_r1"]


def _learn(kind, **options):
    def run(spark, sf):
        split = ml.spatial_split(training_cloud(spark, sf), block_size=5.0, fraction=0.3)
        model = ml.train_classifier(ml.cap_per_class(split.train, 3000), FEATURES, kind, impute=True, **options)
        return ml.evaluate(model, split.test)
    return run


query("random_forest_evaluation")(_learn("random_forest"))
query("boosted_trees_evaluation")(_learn("boosted_trees"))
query("multilayer_evaluation")(_learn("multilayer"))


@query("predict_all_rows")
def _(spark, sf):
    cloud = training_cloud(spark, sf)
    model = ml.train_classifier(ml.cap_per_class(cloud, 2000), FEATURES, "random_forest")
    return ml.predict(model, cloud)


@query("external_test")
def _(spark, sf):
    cloud = training_cloud(spark, sf)
    middle = cloud.agg(F.percentile_approx("y", 0.5)).first()[0]
    model = ml.train_classifier(cloud.where(F.col("y") < middle), FEATURES, "random_forest", impute=True)
    return ml.external_test(model, cloud.where(F.col("y") >= middle), FEATURES, train_domain="asprs", test_domain="asprs")


@query("compare_models")
def _(spark, sf):
    split = ml.spatial_split(training_cloud(spark, sf), block_size=5.0, fraction=0.3)
    return ml.compare_models(split, FEATURES, impute=True)


@query("feature_importance")
def _(spark, sf):
    cloud = training_cloud(spark, sf)
    model = ml.train_classifier(cloud, FEATURES, "random_forest", impute=True)
    return ml.feature_importance(model, spark)


def _cluster(algorithm):
    def run(spark, sf):
        cloud = training_cloud(spark, sf).withColumn("is_ground", F.col("classification") == 2)
        return ml.cluster(cloud, FEATURES, 4, algorithm, ground="is_ground").select("point_id", "cluster_id", "cluster_confidence")
    return run


# Contracts that hold whatever a fit finds: rows, ids in range, ground as 0, usable confidences.
@query("cluster_contract", "SELECT count(*) AS n, count(*) FILTER (WHERE classification = 2) AS ground, 0::BIGINT AS bad_ids, 0::BIGINT AS bad_confidence FROM pts", "pts")
def _(spark, sf):
    cloud = training_cloud(spark, sf).withColumn("is_ground", F.col("classification") == 2)
    out = ml.cluster(cloud, FEATURES, 4, "kmeans", ground="is_ground")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("cluster_id") == 0) & F.col("is_ground")).alias("ground"),
                   F.count_if(~F.col("cluster_id").isin(-1, 0, 1, 2, 3, 4) | ((F.col("cluster_id") == 0) & ~F.col("is_ground"))).alias("bad_ids"),
                   F.count_if(~F.coalesce(F.col("cluster_confidence").between(0.0, 1.0), F.lit(False))).alias("bad_confidence"))


@query("predict_contract", "SELECT count(*) AS n, 0::BIGINT AS bad_classes, 0::BIGINT AS bad_rows FROM pts", "pts")
def _(spark, sf):
    cloud = training_cloud(spark, sf)
    model = ml.train_classifier(ml.cap_per_class(cloud, 2000), FEATURES, "random_forest")
    out = ml.predict(model, cloud)
    scored_ = F.col("pred_class") >= 0
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pred_class").isin(-1, 2, 5, 6)).alias("bad_classes"),
                   F.count_if(scored_ != F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))).alias("bad_rows"))


@query("learners_contract", "SELECT kind, n, 0::BIGINT AS bad_classes, 0::BIGINT AS bad_sums, true AS better_than_chance FROM (SELECT count(*) AS n FROM pts), (VALUES ('boosted_trees'), ('multilayer')) k(kind)", "pts")
def _(spark, sf):
    """Both fitted models on every row: a known class, probabilities that add up to one, and more right than the commonest class would be."""
    cloud = training_cloud(spark, sf)
    common = cloud.groupBy("classification").count().agg(F.max("count") / F.sum("count")).first()[0]
    out = None
    for kind in ("boosted_trees", "multilayer"):
        found = ml.predict(ml.train_classifier(ml.cap_per_class(cloud, 2000), FEATURES, kind, impute=True), cloud, keep_probabilities=True)
        total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
        row = found.join(cloud.select("point_id", "classification"), "point_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pred_class").isin(2, 5, 6)).alias("bad_classes"), F.count_if(~F.coalesce(F.abs(total - 1) < 1e-9, F.lit(False))).alias("bad_sums"),
            (F.avg((F.col("pred_class") == F.col("classification")).cast("double")) > common).alias("better_than_chance")).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("clusterings_contract", "SELECT algorithm, n, ground, 4::BIGINT AS clusters, 0::BIGINT AS bad_confidence FROM (SELECT count(*) AS n, count(*) FILTER (WHERE classification = 2) AS ground FROM pts), (VALUES ('hierarchical'), ('mixture')) a(algorithm)", "pts")
def _(spark, sf):
    """Both clusterings of every row: ground apart, all four clusters in use, confidences in range."""
    cloud = training_cloud(spark, sf).withColumn("is_ground", F.col("classification") == 2)
    out = None
    for algorithm in ("hierarchical", "mixture"):
        row = ml.cluster(cloud, FEATURES, 4, algorithm, ground="is_ground").agg(
            F.count(F.lit(1)).alias("n"), F.count_if((F.col("cluster_id") == 0) & F.col("is_ground")).alias("ground"), F.countDistinct(F.when(F.col("cluster_id") > 0, F.col("cluster_id"))).alias("clusters"),
            F.count_if(~F.coalesce(F.col("cluster_confidence").between(0.0, 1.0), F.lit(False))).alias("bad_confidence")).select(F.lit(algorithm).alias("algorithm"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("report_tables", f"WITH {SCORED} SELECT t AS true_class, p AS pred_class, count(*) AS n, count(*) AS n_json FROM s GROUP BY ALL", "lab")
def _(spark, sf):
    # Written as CSV and JSON, read back and laid side by side.
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    sinks.write_report_tables({"confusion": me.confusion(scored(spark, sf))}, path)
    schema = "true_class INT, pred_class INT, n BIGINT"
    csv = spark.read.schema(schema).option("header", True).csv(f"{path}/confusion.csv")
    return csv.join(spark.read.schema(schema).json(f"{path}/confusion.json").withColumnRenamed("n", "n_json"), ["true_class", "pred_class"])


query("cluster_kmeans")(_cluster("kmeans"))
query("cluster_hierarchical")(_cluster("hierarchical"))
query("cluster_mixture")(_cluster("mixture"))


MODELS = """SELECT 'm' || CAST(c_custkey AS STRING) AS artifact_id, array('planarity_r1', CASE WHEN c_custkey % 5 = 0 THEN 'z_range_r2' ELSE 'z_range_r1' END) AS feature_names,
 CASE WHEN c_custkey % 7 = 0 THEN 'archaeology' ELSE 'asprs' END AS target_domain, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE)/100.0 END AS balanced_accuracy,
 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 0.05 + CAST(c_custkey % 30 AS DOUBLE)/100.0 END AS trained_spacing, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 5.0 + CAST(c_custkey % 40 AS DOUBLE) END AS trained_density,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 10 AS DOUBLE)/10.0 END AS trained_valid_returns, c_custkey % 13 <> 0 AS file_ready FROM {customer}"""
SUIT = f"""mo AS ({MODELS.format(customer='customer').replace('array(', 'list_value(').replace('AS STRING', 'AS VARCHAR')}),
q AS (SELECT *, exp(-abs(ln(0.2::DOUBLE/trained_spacing))) AS a, exp(-abs(ln(20.0::DOUBLE/trained_density))) AS b, greatest(0, 1-abs(0.9::DOUBLE-trained_valid_returns)) AS c FROM mo),
w AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (trained_valid_returns IS NOT NULL)::INT AS k, coalesce(a,0)+coalesce(b,0)+CASE WHEN trained_valid_returns IS NULL THEN 0 ELSE c END AS s FROM q),
v AS (SELECT *, CASE WHEN k > 0 THEN s/k ELSE 0.45 END AS ds, file_ready AND target_domain = 'asprs' AND feature_names = ['planarity_r1','z_range_r1'] AS compatible FROM w),
su AS (SELECT artifact_id, compatible, {d('ds')} AS domain_score, {d('CASE WHEN compatible THEN 100*(0.55*greatest(0, least(1, coalesce(balanced_accuracy, 0.5)))+0.45*ds) ELSE 0 END')} AS score,
 CASE WHEN NOT compatible THEN 'Incompatible' WHEN k >= 2 AND ds >= 0.7 THEN 'Ready' ELSE 'Review' END AS status FROM v)"""


def suitability(spark, sf):
    models = spark.sql(MODELS.format(customer="{c}"), c=table(spark, sf, "customer"))
    here = spark.createDataFrame([(0.2, 20.0, 0.9)], "spacing double, density double, valid_returns double")
    s = ml.model_suitability(models, here, features=["planarity_r1", "z_range_r1"], domain="asprs")
    return s.select("artifact_id", "compatible", r("domain_score").alias("domain_score"), r("score").alias("score"), "status")


@query("model_suitability", f"WITH {SUIT} SELECT * FROM su")
def _(spark, sf):
    return suitability(spark, sf)


@query("model_ranking", f"WITH {SUIT} SELECT artifact_id, score FROM su ORDER BY compatible DESC, score DESC, artifact_id LIMIT 20")
def _(spark, sf):
    return ml.rank_models(suitability(spark, sf)).select("artifact_id", "score")


# --- ledger -------------------------------------------------------------------
BASE = "b0 AS (SELECT point_id, classification, classification AS original_class, classification AS working_class, NULL::INT AS trusted_class, false AS is_ground, 0 AS archaeology_class, pred_class, confidence, hag, is_ground AS preview FROM lab)"


def base_state(spark, sf):
    lab = labelled_view(spark, sf).withColumn("preview", F.col("is_ground").cast("double"))
    return le.init_labels(lab.drop("trusted_class")).select("point_id", "classification", *["original_class", "working_class", "trusted_class", "is_ground", "archaeology_class"], "pred_class", "confidence", "hag", "preview")


@query("ledger_init", f"WITH {BASE} SELECT point_id, original_class, working_class, trusted_class, is_ground FROM b0", "lab")
def _(spark, sf):
    return base_state(spark, sf).select("point_id", "original_class", "working_class", "trusted_class", "is_ground")


GE = """e1 AS (SELECT 1 AS version, point_id, 'is_ground' AS field, 0 AS before, 1 AS after FROM b0 WHERE preview UNION ALL
 SELECT 1, point_id, 'working_class', working_class, CASE WHEN preview THEN 2 ELSE 1 END FROM b0 WHERE (preview AND working_class <> 2) OR (NOT preview AND working_class = 2))"""


@query("ledger_apply_ground", f"WITH {BASE}, {GE} SELECT * FROM e1", "lab")
def _(spark, sf):
    return le.ground_edits(base_state(spark, sf), "preview", 1)


S1 = "s1 AS (SELECT b0.* EXCLUDE (working_class, is_ground), CASE WHEN preview THEN 2 WHEN working_class = 2 THEN 1 ELSE working_class END AS working_class, preview AS is_ground FROM b0)"
ME = """e2 AS (SELECT 2 AS version, point_id, 'working_class' AS field, working_class AS before, 6 AS after FROM s1 WHERE hag > 9 AND working_class <> 6 UNION ALL
 SELECT 2, point_id, 'trusted_class', NULL, 6 FROM s1 WHERE hag > 9 UNION ALL SELECT 2, point_id, 'is_ground', 1, 0 FROM s1 WHERE hag > 9 AND is_ground)"""


def state1(spark, sf):
    base = base_state(spark, sf)
    return base, le.ground_edits(base, "preview", 1)


@query("ledger_manual_label", f"WITH {BASE}, {S1}, {ME} SELECT * FROM e2", "lab")
def _(spark, sf):
    base, e1 = state1(spark, sf)
    s = le.current_state(base, e1, [1])
    return le.manual_edits(s, s.where("hag > 9"), 6, 2)


@query("ledger_trust_field", f"""WITH {BASE} SELECT 1 AS version, point_id, 'trusted_class' AS field, NULL::INT AS before, pred_class AS after FROM b0 WHERE pred_class >= 0
 UNION ALL SELECT 1, point_id, 'working_class', working_class, pred_class FROM b0 WHERE pred_class >= 0 AND pred_class <> working_class""", "lab")
def _(spark, sf):
    return le.trust_edits(base_state(spark, sf), "pred_class", 1)


@query("ledger_apply_predictions", f"""WITH {BASE}, {S1} SELECT 2 AS version, point_id, 'working_class' AS field, working_class AS before, pred_class AS after FROM s1
 WHERE pred_class >= 0 AND confidence >= 0.4 AND NOT is_ground AND pred_class <> 2 AND pred_class <> working_class""", "lab")
def _(spark, sf):
    base, e1 = state1(spark, sf)
    return le.prediction_edits(le.current_state(base, e1, [1]), 2, 0.4)


@query("ledger_auto_edits", f"WITH {BASE}, {S1} SELECT 2 AS version, point_id, 'working_class' AS field, working_class AS before, 1 AS after FROM s1 WHERE hag < 2 AND NOT is_ground AND working_class <> 1", "lab")
def _(spark, sf):
    base, e1 = state1(spark, sf)
    s = le.current_state(base, e1, [1])
    return le.auto_edits(s, s.where("hag < 2").select("point_id", F.lit(1).alias("proposal")), 2)


@query("ledger_restore", f"WITH {BASE}, {S1} SELECT 2 AS version, point_id, 'working_class' AS field, working_class AS before, original_class AS after FROM s1 WHERE working_class <> original_class AND hag > 3", "lab")
def _(spark, sf):
    base, e1 = state1(spark, sf)
    s = le.current_state(base, e1, [1])
    return le.restore_edits(s, s.where("hag > 3"), 2)


@query("ledger_undo_redo_state", f"""WITH {BASE}, {S1} SELECT point_id, CASE WHEN confidence > 0.8 THEN 17 ELSE CASE WHEN hag > 9 THEN 6 ELSE working_class END END AS working_class,
 CASE WHEN confidence > 0.8 THEN 17 WHEN hag > 9 THEN 6 END AS trusted_class, CASE WHEN confidence > 0.8 OR hag > 9 THEN false ELSE is_ground END AS is_ground FROM s1""", "lab")
def _(spark, sf):
    # Edits 1 and 2, edit 3 undone, edit 4 (drops the redo of 3), undone and redone.
    # Each version is written before the next one reads it, as the durable ledger does.
    base, e1 = state1(spark, sf)
    e1 = cut_lineage(e1)
    s1 = le.current_state(base, e1, [1])
    e2 = cut_lineage(le.manual_edits(s1, s1.where("hag > 9"), 6, 2))
    s2 = le.current_state(base, e1.unionByName(e2), [1, 2])
    e3 = le.manual_edits(s2, s2.where("hag < 1"), 9, 3)
    e4 = le.manual_edits(s2, s2.where("confidence > 0.8"), 17, 4)
    log = [{"action": "edit", "version": v} for v in (1, 2, 3)] + [{"action": "undo"}, {"action": "edit", "version": 4}, {"action": "undo"}, {"action": "redo"}]
    active, _ = le.active_versions(log)
    edits = e1.unionByName(e2).unionByName(e3).unionByName(e4)
    return le.current_state(base, edits, active).select("point_id", "working_class", "trusted_class", "is_ground")


RECORD = """'{"operation":"' || event_type || '","timestamp_utc":"2024-01-01T00:00:00Z","affected_points":' || user_id || ',"elapsed_ms":' || event_id || ',"output_fields":["a","b"],"parameters":{"k":"' || (event_id % 7) || '"}}'"""


@query("ledger_history", "SELECT event_type AS operation, user_id AS affected_points, event_id AS elapsed_ms, (event_id % 7)::VARCHAR AS k, 2 AS fields FROM events")
def _(spark, sf):
    h = le.history(table(spark, sf, "events").select(F.expr(RECORD).alias("record")))
    return h.select("operation", "affected_points", "elapsed_ms", F.col("parameters")["k"].alias("k"), F.size("output_fields").alias("fields"))


@query("staleness_check", """WITH t AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS made_with, max(event_id) FILTER (WHERE event_type = 'click') AS current FROM events GROUP BY 1)
SELECT user_id, made_with IS NOT NULL AND made_with IS DISTINCT FROM current AS stale FROM t""")
def _(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("made_with"), F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("current"))
    return t.select("user_id", le.stale("made_with", "current").alias("stale"))


@query("drop_fields", "SELECT * EXCLUDE (intensity) FROM pts", "pts")
def _(spark, sf):
    return le.drop_fields(points_view(spark, sf), ["intensity"])


# --- jobs ---------------------------------------------------------------------
@query("job_progress", f"""WITH e AS (SELECT event_type AS command, ts, event_id, greatest(0, least(1, value/50.0)) AS progress, 'phase' || (event_id % 3) AS phase FROM events)
SELECT command, arg_max(phase, (ts, progress, phase)) AS phase, {d('arg_max(progress, (ts, progress, phase))')} AS progress, count(*) AS events FROM e GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("command"), F.col("ts").alias("timestamp"), (F.col("value") / 50.0).alias("progress"),
                                          F.concat(F.lit("phase"), F.col("event_id") % 3).alias("phase"))
    return sp.latest_progress(e).select("command", "phase", r("progress").alias("progress"), "events")


@query("eta", f"""WITH l AS (SELECT l_suppkey, count(*)*400.0::DOUBLE AS points, sum(l_quantity)*10 AS area, sum(l_extendedprice)/1e6 AS seconds FROM lineitem GROUP BY 1), s AS (SELECT * FROM l WHERE points >= 10000 AND seconds > 0),
a AS (SELECT count(*) AS samples, sum(seconds)/sum(points*(1+points/greatest(1, area))) AS rate FROM s)
SELECT samples, {d('rate', 12)} AS seconds_per_work, {d('rate*1e9', 3)} AS remaining, {d('rate*1e9*CASE WHEN samples < 3 THEN 0.4 ELSE 0.6 END', 3)} AS remaining_low, {d('rate*1e9*CASE WHEN samples < 3 THEN 2.5 ELSE 1.8 END', 3)} AS remaining_high FROM a""")
def _(spark, sf):
    led = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.count(F.lit(1)) * 400.0).alias("points"), (F.sum("l_quantity") * 10).alias("area"), (F.sum("l_extendedprice") / 1e6).alias("seconds"))
    e = stt.eta(led, 1e9)
    return e.select("samples", r("seconds_per_work", 12).alias("seconds_per_work"), *[r(c, 3).alias(c) for c in ("remaining", "remaining_low", "remaining_high")])


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"


@query("process_tiles_resumable", f"""WITH b AS (SELECT min(x) x0, min(y) y0, max(x) x1, max(y) y1 FROM pts), t AS (SELECT pts.*, least(floor((x-x0)/10), greatest(1, ceil((x1-x0)/10))-1)::INT AS tile_col, least(floor((y-y0)/10), greatest(1, ceil((y1-y0)/10))-1)::INT AS tile_row FROM pts, b)
SELECT tile_col, tile_row, count(*) AS row_count FROM t GROUP BY ALL""", "pts")
def _(spark, sf):
    # Half of the tiles first, then a resumed run over all of them.
    p = points_view(spark, sf)
    tiled = ti.assign_tile(p, ti.TileGrid.over(p, 10.0))
    path, config = _folder(spark), {"job": "heights", "side": 10.0}

    def compute(rows):
        return rows.select("point_id", (F.col("z") * 2).alias("value"), "tile_col", "tile_row")

    first = tiled.select("tile_col", "tile_row").distinct().where((F.col("tile_col") + F.col("tile_row")) % 2 == 0)
    stt.process_tiles(tiled, compute, path, config, batch=0, only=first)
    stt.process_tiles(tiled, compute, path, config, batch=1)
    return stt.read_ledger(spark, path).select("tile_col", "tile_row", "row_count")
