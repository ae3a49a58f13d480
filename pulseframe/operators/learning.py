"""Training rows, leakage-free splits, preprocessing, classifiers and clustering."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pulseframe.functions.scalar import finite_or_null
from pulseframe.operators import fitting, metrics
from pulseframe.operators.attach import assert_disjoint, buffer_exclude
from pulseframe.operators.ranking import exact_quantiles, smallest_per_group
from pulseframe.operators.selection import mix
from pulseframe.session import cut_lineage


def trusted_rows(df: DataFrame, features: list[str], *, impute: bool = False, working: str = "working_class",
                 trusted: str = "trusted_class") -> DataFrame:
    """Rows whose working class is an integer 0..255, confirmed, with usable position and features.

    With ``impute`` one finite feature is enough.
    """
    code = finite_or_null(working)
    ok = (code >= 0) & (code <= 255) & (code == F.floor(code)) & (code == finite_or_null(trusted))
    finite = [finite_or_null(f).isNotNull() for f in features]
    usable = reduce(lambda a, b: (a | b) if impute else (a & b), finite)
    return df.where(ok & finite_or_null("x").isNotNull() & finite_or_null("y").isNotNull() & usable)


def split_scores(histogram: DataFrame, fraction: float, seed: int, candidates: int = 96) -> DataFrame:
    """Score of each candidate draw of whole blocks: ``candidate, missing_train, missing_test, score``.

    Works on the (block, class) histogram, never on rows.  A draw takes
    ``ceil(fraction * blocks)`` blocks by a portable pseudo-random order.
    """
    total = histogram.agg(F.sum("n")).first()[0]
    drawn = draw_blocks(histogram, fraction, seed, candidates)
    joined = histogram.join(drawn, ["block_col", "block_row"])
    per = joined.groupBy("candidate", "class_code").agg(
        F.sum(F.when(F.col("is_test"), F.col("n")).otherwise(0)).alias("test"), F.sum(F.when(F.col("is_test"), 0).otherwise(F.col("n"))).alias("train"))
    return per.groupBy("candidate").agg(
        F.count_if(F.col("train") == 0).alias("missing_train"), F.count_if(F.col("test") == 0).alias("missing_test"),
        F.sum("test").alias("test_rows")).withColumn(
        "score", F.col("missing_test") * 10.0 + F.abs(F.col("test_rows") - total * fraction) / total)


def draw_blocks(histogram: DataFrame, fraction: float, seed: int, candidates: int) -> DataFrame:
    """``block_col, block_row, candidate, is_test`` for every candidate draw."""
    blocks = histogram.select("block_col", "block_row").distinct()
    count = blocks.count()
    if count < 2:
        raise ValueError("a spatial split needs at least two occupied blocks")
    take = -(-int(round(count * fraction * 1e9)) // 10 ** 9)
    spread = blocks.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    keyed = spread.withColumn("_mix", mix("block_col", "block_row", "candidate", seed=seed))
    # One group per candidate holds one row per block, not per point.
    order = Window.partitionBy("candidate").orderBy("_mix", "block_col", "block_row")
    return keyed.withColumn("is_test", F.row_number().over(order) <= take).drop("_mix")


@dataclass
class SpatialSplit:
    train: DataFrame
    test: DataFrame
    test_blocks: DataFrame
    score: float


def spatial_split(df: DataFrame, *, block_size: float, fraction: float = 0.25, seed: int = 42, buffer: float = 0.0,
                  candidates: int = 96, label: str = "classification") -> SpatialSplit:
    """Whole blocks go to test; the best of ``candidates`` seeded draws is kept.

    No class may vanish from training, neither by the draw nor by the buffer.
    """
    if not block_size > 0 or not 0.05 <= fraction <= 0.5 or buffer < 0:
        raise ValueError("block size must be positive, fraction in 0.05..0.5, buffer not negative")
    low = df.agg(F.min("x"), F.min("y")).first()
    origin = (low[0], low[1])
    keyed = metrics.block_index(df, block_size, origin)
    histogram = cut_lineage(keyed.groupBy("block_col", "block_row", F.col(label).alias("class_code")).agg(F.count(F.lit(1)).alias("n")))
    candidates = max(8, candidates)
    best = (split_scores(histogram, fraction, seed, candidates).where(F.col("missing_train") == 0)
            .orderBy("score", "candidate").first())
    if best is None:
        raise ValueError("no spatial split keeps every class in training; use smaller blocks")
    blocks = cut_lineage(draw_blocks(histogram, fraction, seed, candidates)
                         .where((F.col("candidate") == best.candidate) & F.col("is_test")).select("block_col", "block_row"))
    test = keyed.join(blocks, ["block_col", "block_row"], "left_semi")
    train = keyed.join(blocks, ["block_col", "block_row"], "left_anti")
    if buffer > 0:
        train = buffer_exclude(train, blocks, block_size, origin, buffer)
        kept = {r[0] for r in train.select(label).distinct().collect()}
        every = {r[0] for r in histogram.select("class_code").distinct().collect()}
        if kept != every:
            raise ValueError(f"the buffer removes every training row of classes {sorted(every - kept)}")
    return SpatialSplit(train, test, blocks, best.score)


def cap_per_class(df: DataFrame, n: int, seed: int = 42, label: str = "classification") -> DataFrame:
    """At most ``n`` rows per class in a repeatable random order (training side only)."""
    if n <= 0:
        return df
    return smallest_per_group(df.withColumn("_mix", mix("point_id", seed=seed)), [label], "_mix", "point_id", n).drop("_mix")


@dataclass
class Preprocessor:
    """Training medians, indicator columns and scaling, applied with plain expressions."""

    features: list[str]
    medians: dict[str, float]
    indicators: list[str]
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.features + [f"{f}_missing" for f in self.indicators]

    def apply(self, df: DataFrame) -> DataFrame:
        def value(f: str) -> Column:
            v = F.coalesce(finite_or_null(f), F.lit(float(self.medians[f]))) if f in self.medians else finite_or_null(f)
            return v

        out = {f"{f}_missing": finite_or_null(f).isNull().cast("double") for f in self.indicators}
        out.update({f: value(f) for f in self.features})
        df = df.withColumns(out)
        if self.scale:
            df = df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.scale.items()})
        return df


def impute_median(train: DataFrame, features: list[str]) -> Preprocessor:
    """Exact training medians and indicators for the columns with missing values in training."""
    q = {r.field: r for r in exact_quantiles(train, features, [0.5]).collect()}
    empty = [f for f in features if q[f].valid == 0]
    if empty:
        raise ValueError(f"columns without any training value: {empty}")
    missing = train.agg(*[F.count_if(finite_or_null(f).isNull()).alias(str(i)) for i, f in enumerate(features)]).first()
    return Preprocessor(features, {f: q[f].q0 for f in features}, [f for i, f in enumerate(features) if missing[i]])


def standardize(train: DataFrame, prep: Preprocessor) -> Preprocessor:
    """Add the training mean and population deviation (1 where it is 0) to a preprocessor."""
    ready = prep.apply(train)
    one = ready.agg(*[f(c).alias(f"{i}{n}") for i, c in enumerate(prep.columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = {c: (one[f"{i}m"], one[f"{i}s"] or 1.0) for i, c in enumerate(prep.columns)}
    return Preprocessor(prep.features, prep.medians, prep.indicators, scale)


@dataclass
class TrainedModel:
    """A fitted classifier with everything prediction needs."""

    kind: str
    model: object
    features: list[str]
    classes: list[int]
    prep: Preprocessor | None
    cuts: list[list[float]] = field(default_factory=list)  # of the forest's columns


KINDS = ("random_forest", "boosted_trees", "multilayer")
# Depth of trees where none is asked for.
DEPTH = {"random_forest": 10, "boosted_trees": 6}
FOREST_BINS, LEAST_BIN = 32, 500  # a bin of the forest holds one row in LEAST_BIN at least


def forest_cuts(rows: DataFrame, d: int) -> list[list[float]]:
    """Cuts between the bins of each of ``d`` columns, from all rows ``x``."""
    edges = fitting.bin_edges(rows, d, FOREST_BINS)
    size = FOREST_BINS + 1
    held = fitting.summed(rows, lambda x: np.concatenate([np.bincount(np.searchsorted(e, x[:, j]), minlength=size) for j, e in enumerate(edges)]).astype(float), d * size)
    least, cuts = held[:size].sum() / LEAST_BIN, []
    for e, counts in zip(edges, held.reshape(d, size)):
        kept, run, above = [], 0.0, counts.sum()
        for edge, n in zip(e, counts):
            run, above = run + n, above - n
            if run >= least and above >= least and run and above:
                kept.append(float(edge))
                run = 0.0
        cuts.append(kept)
    return cuts


def binned(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """Each column's value replaced by the number of its bin, from 1: a cut belongs to the bin below it."""
    some = [(c, [-np.inf, *np.nextafter(e, np.inf).tolist(), np.inf]) for c, e in zip(columns, cuts) if e]
    if some:
        names = [c for c, _ in some]
        df = Bucketizer(inputCols=names, outputCols=[f"_bin_{c}" for c in names], splitsArray=[e for _, e in some], handleInvalid="keep").transform(df)
    one = {c: F.col(f"_bin_{c}") + 1.0 if e else F.lit(1.0) for c, e in zip(columns, cuts)}
    return df.withColumns(one).drop(*[f"_bin_{c}" for c in columns])


def train_classifier(train: DataFrame, features: list[str], kind: str = "random_forest", *, label: str = "classification",
                     impute: bool = False, balanced: bool = True, trees: int = 50, depth: int | None = None, min_leaf: int = 1,
                     criterion: str = "gini", iterations: int = 20, hidden: tuple[int, ...] | None = None, max_features: str = "auto", step: float = 0.1,
                     subsample: float = 1.0, column_sample: float = 1.0, seed: int = 42) -> TrainedModel:
    """Fit a classifier on rows with finite features (or imputed ones).

    ``balanced`` weights classes inversely to their size, whatever the ratio.  ``iterations`` are rounds of boosting
    or steps of the network.  The library's forest looks for its thresholds in some 10,000 rows; it is given numbers of bins, all of them
    to be found among so many, and so chooses among cuts made from all rows.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown classifier {kind!r}")
    # Written once: medians, class sizes and the fit read it many times.
    train = cut_lineage(train.select(label, *features))
    prep = impute_median(train, features) if impute else Preprocessor(features, {}, [])
    if kind == "multilayer":
        prep = standardize(train, prep)
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    classes = sorted(counts)
    if len(classes) < 2:
        raise ValueError("training needs at least two classes")
    total = sum(counts.values())
    index = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
    weight = F.create_map(*[F.lit(v) for c in classes for v in (c, total / (len(classes) * counts[c]) if balanced else 1.0)])
    ready = prep.apply(train).withColumns({"_y": F.try_element_at(index, F.col(label)), "_w": F.try_element_at(weight, F.col(label))})
    whole = ready.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in prep.columns]))
    if kind == "random_forest":
        cuts = forest_cuts(whole.select(F.array(*[F.col(c).cast("double") for c in prep.columns]).alias("x")), len(prep.columns))
        ready = VectorAssembler(inputCols=prep.columns, outputCol="_x").transform(binned(whole, prep.columns, cuts)).select("_x", "_y", "_w")
        fitted = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth or DEPTH[kind], minInstancesPerNode=min_leaf,
                                        impurity=criterion, featureSubsetStrategy=max_features, seed=seed, maxBins=FOREST_BINS + 2).fit(ready)
        return TrainedModel(kind, fitted, list(features), classes, prep, cuts)
    rows = whole.select(F.array(*[F.col(c).cast("double") for c in prep.columns]).alias("x"), F.col("_y").cast("int").alias("y"), F.col("_w").alias("w"))
    if kind == "boosted_trees":
        fitted = fitting.fit_boosted(rows, len(classes), len(prep.columns), rounds=iterations, depth=depth or DEPTH[kind], rate=step, subsample=subsample,
                                     column_sample=column_sample, seed=seed)
    else:
        wide = max(32, min(256, 4 * len(prep.columns)))
        fitted = fitting.fit_network(rows, [len(prep.columns), *(hidden or (wide, wide // 2)), len(classes)], iterations=iterations, seed=seed)
    return TrainedModel(kind, fitted, list(features), classes, prep)


def argmax_class(probabilities: Column, classes: list[int]) -> Column:
    """Class of the first largest probability."""
    at = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    return F.get(F.array(*[F.lit(c) for c in classes]), at - 1)


def predict(model: TrainedModel, df: DataFrame, features: list[str] | None = None, keep_probabilities: bool = False) -> DataFrame:
    """``point_id, pred_class, confidence, uncertainty`` for every row.

    A row with a missing input gets -1 and NULL; it is never dropped.
    """
    if features is not None and list(features) != model.features:
        raise ValueError("feature set or order differs from training")
    prep = model.prep
    ready = prep.apply(df.select("point_id", *model.features))
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in prep.columns])
    ready = ready.withColumn("_ok", usable).na.fill(0.0, prep.columns)
    if model.kind == "random_forest":
        vectors = VectorAssembler(inputCols=prep.columns, outputCol="_x").transform(binned(ready, prep.columns, model.cuts))
        scored = model.model.transform(vectors).select("point_id", "_ok", vector_to_array(F.col("probability")).alias("probabilities"))
    else:
        scored = ready.select("point_id", "_ok", F.array(*[F.col(c).cast("double") for c in prep.columns]).alias("x")).select(
            "point_id", "_ok", model.model.column("x").alias("probabilities"))
    best = F.array_max("probabilities")
    return scored.select(
        "point_id", F.when(F.col("_ok"), argmax_class(F.col("probabilities"), model.classes)).otherwise(-1).cast("smallint").alias("pred_class"),
        F.when(F.col("_ok"), best).cast("float").alias("confidence"), F.when(F.col("_ok"), 1.0 - best).cast("float").alias("uncertainty"),
        *([F.when(F.col("_ok"), F.col("probabilities")).alias("probabilities")] if keep_probabilities else []))


def evaluate(model: TrainedModel, test: DataFrame, label: str = "classification") -> DataFrame:
    """Overall metrics of a model on labelled rows (rows it cannot score count as wrong)."""
    scored = test.select("point_id", F.col(label).alias("true_class")).join(predict(model, test), "point_id")
    return metrics.overall_metrics(metrics.confusion(scored), model.classes)


def external_test(model: TrainedModel, test: DataFrame, features: list[str], *, train_domain: str, test_domain: str,
                  label: str = "classification") -> DataFrame:
    """Evaluate on a separate labelled cloud with the same features and class domain."""
    if list(features) != model.features:
        raise ValueError("external test needs the same ordered features")
    if train_domain != test_domain:
        raise ValueError("external test needs the same class domain")
    return evaluate(model, test, label)


def compare_models(split: SpatialSplit, features: list[str], kinds=KINDS, *, label: str = "classification", **options) -> DataFrame:
    """Fit several classifiers on one split and rank them by balanced accuracy."""
    assert_disjoint(split.train, split.test, ["point_id"])
    assert_disjoint(split.train, split.test, ["block_col", "block_row"])
    identity = metrics.content_fingerprint(split.test, ["point_id"]).first()
    rows = None
    for kind in kinds:
        result = evaluate(train_classifier(split.train, features, kind, label=label, **options), split.test, label)
        again = metrics.content_fingerprint(split.test, ["point_id"]).first()
        if again != identity:
            raise RuntimeError("the test rows changed between models")
        result = result.withColumn("classifier", F.lit(kind))
        rows = result if rows is None else rows.unionByName(result)
    return rows.orderBy(F.desc("balanced_accuracy"), "classifier")


def feature_importance(model: TrainedModel, spark) -> DataFrame:
    """``feature, importance``; a missing-value indicator counts for its own column."""
    if model.kind != "random_forest":
        raise ValueError("importances come from the random forest")
    values = model.model.featureImportances.toArray()
    rows = [(c[:-len("_missing")] if c not in model.features else c, float(v)) for c, v in zip(model.prep.columns, values)]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance"))


def centre_distances(columns: list[str], centres) -> Column:
    """Array of distances from a row to each centre."""
    def one(c):
        return F.sqrt(reduce(lambda a, b: a + b, [(F.col(n) - float(v)) * (F.col(n) - float(v)) for n, v in zip(columns, c)]))
    return F.array(*[one(c) for c in centres])


def map_clusters(raw: Column, confidence: Column, usable: Column, ground: Column | None) -> dict[str, Column]:
    """Public ids: 0 = ground and 1..K when ground is locked, else 0..K-1; -1 without usable input."""
    if ground is None:
        return {"cluster_id": F.when(usable, raw).otherwise(-1).cast("int"),
                "cluster_confidence": F.when(usable, confidence).otherwise(0.0)}
    g = F.coalesce(ground, F.lit(False))
    return {"cluster_id": F.when(g, 0).when(usable, raw + 1).otherwise(-1).cast("int"),
            "cluster_confidence": F.when(g, 1.0).when(usable, confidence).otherwise(0.0)}


def cluster(df: DataFrame, features: list[str], k: int, algorithm: str = "kmeans", *,
            ground: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``cluster_id, cluster_confidence``.

    ``algorithm``: kmeans, hierarchical (clustering features) or mixture (diagonal covariances).  The fit uses all
    rows without ground; columns empty there are ignored; the rest is imputed by the median and
    standardised.
    """
    if k < 2:
        raise ValueError("clusters must be at least two")
    finite = {f: finite_or_null(f).isNotNull() for f in features}
    pool = df if ground is None else df.where(~F.coalesce(F.col(ground), F.lit(False)))
    pool = pool.where(reduce(lambda a, b: a | b, finite.values())).select("point_id", *features)
    sample = cut_lineage(pool)
    counts = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count(finite_or_null(f)).alias(f"f{i}") for i, f in enumerate(features)]).first()
    active = [f for i, f in enumerate(features) if counts[f"f{i}"]]
    if not active or sample.select(*active).distinct().limit(k).count() < k:
        raise ValueError("fewer distinct usable rows than clusters")
    prep = standardize(sample, impute_median(sample, active))
    assembler = VectorAssembler(inputCols=prep.columns, outputCol="_x")
    fit_on = assembler.transform(prep.apply(sample)).select("_x")
    usable = reduce(lambda a, b: a | b, [finite[f] for f in active])
    lock = None if ground is None else F.col(ground)
    # Work on a copy of the inputs so that the caller's columns stay as they are.
    inner = df.withColumns({"_usable": usable, **{f"_in_{f}": F.col(f) for f in active}})
    scaled = prep.apply(inner)
    restored = {f: F.col(f"_in_{f}") for f in active}
    drop = ["_usable", "_x", "_raw", "_conf", "_d", *[f"_in_{f}" for f in active], *[f"{f}_missing" for f in prep.indicators]]
    rows = fit_on.select(vector_to_array("_x").alias("x"))
    if algorithm == "mixture":
        starts = [np.array(KMeans(featuresCol="_x", k=k, seed=seed + i).fit(fit_on).clusterCenters()) for i in range(2)]
        fitted = fitting.fit_mixture(rows, starts)
        scored = scaled.withColumn("_x", F.array(*prep.columns)).withColumn("_d", fitted.column("_x"))
        scored = scored.withColumn("_conf", F.array_max("_d")).withColumn("_raw", F.array_position("_d", F.col("_conf")).cast("int") - 1)
    elif algorithm in ("kmeans", "hierarchical"):
        if algorithm == "kmeans":
            centres = KMeans(featuresCol="_x", k=k, seed=seed).fit(fit_on).clusterCenters()
            scored = scaled.withColumn("_d", centre_distances(prep.columns, centres))
        else:
            # Distance to the nearest leaf of each cluster.
            scored = scaled.withColumn("_x", F.array(*prep.columns)).withColumn("_d", fitting.fit_leaves(rows, k, len(prep.columns)).column("_x"))
        scored = scored.withColumn("_raw", F.array_position("_d", F.array_min("_d")).cast("int") - 1)
        ordered = F.array_sort("_d")
        ratio = F.get(ordered, F.lit(0)) / F.greatest(F.get(ordered, F.lit(1)), F.lit(1e-12))
        scored = scored.withColumn("_conf", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - ratio)))
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    out = scored.withColumns(map_clusters(F.col("_raw"), F.col("_conf"), F.col("_usable"), lock))
    return out.withColumns(restored).drop(*drop)


def model_suitability(models: DataFrame, profile: DataFrame, *, features: list[str], domain: str) -> DataFrame:
    """Score of each catalogued model for a cloud: ``compatible, domain_score, score, status``.

    ``models``: artifact_id, feature_names, target_domain, balanced_accuracy,
    trained_spacing, trained_density, trained_valid_returns, file_ready.
    ``profile`` is one row: spacing, density, valid_returns.
    """
    here = profile.first()

    def near(current, trained: str) -> Column:
        if current is None or not current > 0:
            return F.lit(None).cast("double")
        return F.when(F.col(trained) > 0, F.exp(-F.abs(F.ln(F.lit(float(current)) / F.col(trained)))))

    shares = F.lit(None).cast("double")
    if here.valid_returns is not None:
        shares = F.when(F.col("trained_valid_returns") >= 0, F.greatest(F.lit(0.0), 1 - F.abs(F.lit(float(here.valid_returns)) - F.col("trained_valid_returns"))))
    parts = F.array_compact(F.array(near(here.spacing, "trained_spacing"), near(here.density, "trained_density"), shares))
    df = models.withColumn("_parts", parts)
    n = F.size("_parts")
    df = df.withColumns({
        "domain_count": n,
        "domain_score": F.when(n > 0, F.aggregate("_parts", F.lit(0.0), lambda a, b: a + b) / n).otherwise(0.45),
        "compatible": F.col("file_ready") & (F.col("target_domain") == domain)
        & (F.lit(not features) | (F.col("feature_names") == F.array(*[F.lit(f) for f in features])))})
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("balanced_accuracy", F.lit(0.5))))
    score = F.when(F.col("compatible"), 100.0 * (0.55 * quality + 0.45 * F.col("domain_score"))).otherwise(0.0)
    status = F.when(~F.col("compatible"), "Incompatible").when((n >= 2) & (F.col("domain_score") >= 0.7), "Ready").otherwise("Review")
    return df.withColumns({"score": score, "status": status}).drop("_parts")


def rank_models(scored: DataFrame, limit: int = 20) -> DataFrame:
    """Compatible models first, then by score (a top list)."""
    return scored.orderBy(F.desc("compatible"), F.desc("score"), "artifact_id").limit(limit)
