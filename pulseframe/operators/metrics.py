"""Classification metrics, audits, comparison of versions and content identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.functions.scalar import finite_or_null
from pulseframe.operators.neighbours import cell_index
from pulseframe.operators.ranking import exact_quantiles, quantiles_of


def confusion(df: DataFrame, truth: str = "true_class", pred: str = "pred_class") -> DataFrame:
    """Counts per (true, predicted): the long confusion matrix over the union of classes."""
    return df.groupBy(F.col(truth).cast("int").alias("true_class"), F.col(pred).cast("int").alias("pred_class")) \
             .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "true_class", pred: str = "pred_class",
                     classes: list[int] | None = None) -> DataFrame:
    """The square matrix: one row per class, one column ``p<code>`` per class."""
    long = confusion(df, truth, pred)
    if classes is None:
        both = long.select(F.col("true_class").alias("c")).union(long.select("pred_class"))
        classes = sorted(r.c for r in both.distinct().collect() if r.c is not None)
    if not classes or len(classes) > 256:
        raise ValueError("a class matrix needs 1..256 classes")
    rows = df.sparkSession.createDataFrame([(c,) for c in classes], "true_class int")
    cells = [F.coalesce(F.sum(F.when(F.col("pred_class") == c, F.col("n"))), F.lit(0)).alias(f"p{c}") for c in classes]
    return rows.join(long, "true_class", "left").groupBy("true_class").agg(*cells)


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1, IoU and support per class of a long confusion matrix; 0 on zero division."""
    t = matrix.groupBy(F.col("true_class").alias("class_code")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("pred_class"), F.col("n"))).alias("hit"))
    p = matrix.groupBy(F.col("pred_class").alias("class_code")).agg(F.sum("n").alias("claimed"))
    df = t.join(p, "class_code", "full").na.fill(0, ["support", "hit", "claimed"])
    df = df.withColumns({"precision": F.when(F.col("claimed") > 0, F.col("hit") / F.col("claimed")).otherwise(0.0),
                         "recall": F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)})
    pr, both = F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
    return df.select("class_code", "precision", "recall",
                     F.when(both > 0, 2 * pr / both).otherwise(0.0).alias("f1"),
                     F.when(both - pr > 0, pr / (both - pr)).otherwise(0.0).alias("iou"), "support", "claimed", "hit")


def overall_metrics(matrix: DataFrame, train_classes: list[int] | None = None) -> DataFrame:
    """One row: accuracy, balanced accuracy, kappa (NULL if undefined), macro F1 / IoU, completeness."""
    per = class_metrics(matrix)
    seen = F.col("support") > 0
    one = per.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hits"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(F.col("support").cast("double") * F.col("claimed")).alias("chance"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), F.avg(F.when(seen, F.col("iou"))).alias("macro_iou"),
        F.collect_set(F.when(seen, F.col("class_code"))).alias("tested"))
    total = F.col("n").cast("double")
    po, pe = F.col("hits") / total, F.col("chance") / (total * total)
    trained = F.array(*[F.lit(c) for c in train_classes]) if train_classes else F.col("tested")
    missing, unseen = F.array_except(trained, "tested"), F.array_except("tested", trained)
    return one.select(
        "n", po.alias("accuracy"), "balanced_accuracy",
        F.when(1 - pe > 1e-15, (po - pe) / (1 - pe)).alias("cohen_kappa"), "macro_f1", "macro_iou",
        F.size(missing).alias("classes_not_tested"), F.size(unseen).alias("classes_not_trained"),
        ((F.size(missing) == 0) & (F.size(unseen) == 0)).alias("validation_complete"))


def class_distributions(df: DataFrame, features: list[str], *, label: str = "classification") -> DataFrame:
    """Per class and feature: population, valid rows and exact p10..p90 over all rows."""
    population = {r.c: r.n for r in df.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect() if r.c is not None}
    if len(population) > 256:
        raise ValueError("class distributions need at most 256 classes")
    codes, k = sorted(population), len(features)
    place = F.array_position(F.array(*[F.lit(c) for c in codes]), F.col(label)).cast("int") - 1 if codes else F.lit(None).cast("int")
    long = (df.where(F.col(label).isNotNull()).select(F.explode(F.array(*[
        F.struct((place * k + i).alias("f"), finite_or_null(f).alias("v")) for i, f in enumerate(features)])).alias("s")).select("s.*").where(F.col("v").isNotNull()))
    names = ["percentile_10", "percentile_25", "median", "percentile_75", "percentile_90"]
    found = quantiles_of(long, [0.1, 0.25, 0.5, 0.75, 0.9]) if codes else {}
    rows = [(c, f, population[c], *found.get(i * k + j, (0, *[None] * 5))) for i, c in enumerate(codes) for j, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "class_code int, feature string, class_population long, valid long, " + ", ".join(f"{n} double" for n in names))


def block_index(df: DataFrame, size: float, origin: tuple[float, float] | None = None) -> DataFrame:
    """Add ``block_col, block_row`` counted from the lowest coordinates."""
    if origin is None:
        low = df.agg(F.min("x"), F.min("y")).first()
        origin = (low[0], low[1])
    return df.withColumns({"block_col": F.floor((F.col("x") - origin[0]) / size).cast("long"),
                           "block_row": F.floor((F.col("y") - origin[1]) / size).cast("long")})


def block_class_histogram(df: DataFrame, size: float, label: str = "classification") -> DataFrame:
    return (block_index(df, size).groupBy("block_col", "block_row", F.col(label).alias("class_code"))
            .agg(F.count(F.lit(1)).alias("n")))


def prediction_stats(df: DataFrame, trusted: str | None = None) -> DataFrame:
    """One row: aligned and valid rows, mean and nearest-rank p10/50/90 confidence, trusted agreement."""
    conf = finite_or_null("confidence")
    valid = (F.col("pred_class") >= 0) & conf.isNotNull()
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(valid).alias("valid"), F.avg(F.when(valid, conf)).alias("mean_confidence"))
    q = exact_quantiles(df.where(valid).select(conf.alias("confidence")), ["confidence"], [0.1, 0.5, 0.9], method="nearest")
    out = one.withColumn("_k", F.lit("confidence")).join(
        q.select(F.col("field").alias("_k"), F.col("q0").alias("confidence_p10"), F.col("q1").alias("confidence_p50"),
                 F.col("q2").alias("confidence_p90")), "_k", "left")
    if trusted is not None:
        ref = finite_or_null(trusted)
        compared = df.where(valid & ref.between(0, 255)).groupBy(F.floor(ref + 0.5).cast("int").alias("c")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.floor(ref + 0.5) == F.col("pred_class")).alias("hit"))
        agree = compared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trusted_compared"), (F.sum("hit") / F.sum("n")).alias("trusted_accuracy"),
                             F.avg(F.col("hit") / F.col("n")).alias("trusted_balanced_recall")).withColumn("_k", F.lit("confidence"))
        out = out.join(agree, "_k")
    return out.drop("_k")


def prediction_shares(df: DataFrame) -> DataFrame:
    """Valid predictions per class and their share of all valid ones."""
    counts = (df.where((F.col("pred_class") >= 0) & finite_or_null("confidence").isNotNull())
              .groupBy("pred_class").agg(F.count(F.lit(1)).alias("n")))
    # One row per class: the window over all of them is bounded by the class codes.
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def binary_audit(df: DataFrame, predicted: Column, truth: Column, scope: Column, uncertain: Column) -> DataFrame:
    """tp, fp, fn, tn, uncertain, precision and recall over the rows in scope."""
    s = F.coalesce(scope, F.lit(False))
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(truth, F.lit(False))
    one = df.agg(F.count_if(s & p & t).alias("tp"), F.count_if(s & p & ~t).alias("fp"), F.count_if(s & ~p & t).alias("fn"),
                 F.count_if(s & ~p & ~t).alias("tn"), F.count_if(s & F.coalesce(uncertain, F.lit(False))).alias("uncertain"))
    return one.withColumns({
        "precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))),
        "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))})


def reason_histogram(df: DataFrame, category: str = "category", reason: str = "reason") -> DataFrame:
    """Rows per category and reason, with a subtotal per category (reason NULL) and the total."""
    return df.rollup(category, reason).agg(F.count(F.lit(1)).alias("n"))


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free identity of the rows' content: count, xor and sum of 64-bit row hashes."""
    def canonical(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if kind in ("double", "float"):
            v = finite_or_null(name)
            return F.when(v == 0, F.lit(0.0)).otherwise(v)
        return F.col(name)

    h = F.xxhash64(*[F.concat_ws("|", F.lit(n), F.coalesce(canonical(n).cast("string"), F.lit("missing"))) for n in columns])
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"), F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("hash_sum"), F.lit(",".join(columns)).alias("columns"))


def ground_review(df: DataFrame, predicted: str = "is_ground", truth: str = "classification", cell: float = 2.0) -> DataFrame:
    """Ground precision / recall / F1, false ground on classes 6 and 4, recall of covered ground.

    Ground is covered when vegetation (class 4) in its cell stands more than 1 above the lowest ground.
    """
    keyed = df.select(cell_index("x", cell).alias("cx"), cell_index("y", cell).alias("cy"), "z",
                      F.col(truth).alias("t"), F.coalesce(F.col(predicted), F.lit(False)).alias("g"))
    # Everything needed per cell fits in one aggregate, so the points are not joined back.
    per = keyed.groupBy("cx", "cy").agg(
        F.min(F.when(F.col("t") == 2, F.col("z"))).alias("lo"), F.max(F.when(F.col("t") == 4, F.col("z"))).alias("hi"),
        F.count_if(F.col("g")).alias("ground"), F.count_if(F.col("g") & (F.col("t") == 2)).alias("tp"),
        F.count_if(F.col("t") == 2).alias("truth"), F.count_if(F.col("g") & (F.col("t") == 6)).alias("b"),
        F.count_if(F.col("g") & (F.col("t") == 4)).alias("v"))
    covered = F.coalesce(F.col("hi") - F.col("lo") > 1.0, F.lit(False))
    one = per.agg(F.sum("ground").alias("ground_points"), F.sum("tp").alias("tp"), F.sum("truth").alias("truth"),
                  F.sum("b").alias("building_false_ground"), F.sum("v").alias("vegetation_false_ground"),
                  F.coalesce(F.sum(F.when(covered, F.col("truth"))), F.lit(0)).alias("covered_ground"),
                  F.coalesce(F.sum(F.when(covered, F.col("tp"))), F.lit(0)).alias("covered_found"))
    p, r = F.col("tp") / F.greatest(F.lit(1), "ground_points"), F.col("tp") / F.greatest(F.lit(1), "truth")
    return one.select("ground_points", p.alias("precision"), r.alias("recall"),
                      (2 * p * r / F.greatest(F.lit(1e-20), p + r)).alias("f1"), "building_false_ground",
                      "vegetation_false_ground", "covered_ground",
                      (F.col("covered_found") / F.greatest(F.lit(1), "covered_ground")).alias("covered_ground_recall"))


def compare_versions(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows that differ (NULL-safe) and the first such id; plus ids on one side only."""
    left = a.select("point_id", *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    right = b.select("point_id", *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    both = left.join(right, "point_id", "full")
    present = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    tests = {c: present & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns}
    tests = {"only_in_first": F.col("in_b").isNull(), "only_in_second": F.col("in_a").isNull(), **tests}
    one = both.agg(*[x for i, t in enumerate(tests.values()) for x in (
        F.count_if(t).alias(f"n{i}"), F.min(F.when(t, F.col("point_id"))).alias(f"f{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("differences"), F.col(f"f{i}").alias("first_id"))
        for i, name in enumerate(tests)])))
