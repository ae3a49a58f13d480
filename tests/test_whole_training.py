"""Models are fitted on every row they are given."""

import numpy as np
from pyspark.sql import functions as F

from pulseframe.operators import learning as ml
from pulseframe.plans.catalog import QUERIES


def trained_on(monkeypatch, spark, name):
    """Rows given to the fit of a query, and those of its whole cloud."""
    seen, plain = [], ml.train_classifier
    monkeypatch.setattr(ml, "train_classifier", lambda train, *a, **b: seen.append(train) or plain(train, *a, **b | {"trees": 3, "depth": 3}))
    QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    return seen[0]


def test_external_test_fits_on_every_row_below_the_middle(spark, monkeypatch):
    assert trained_on(monkeypatch, spark, "external_test").count() > 29_000


def test_feature_importance_fits_on_every_row(spark, monkeypatch):
    assert trained_on(monkeypatch, spark, "feature_importance").count() == 60_000


def test_a_forest_takes_its_thresholds_from_all_rows(spark):
    """In 60,000 rows the library alone would look at a sixth of them."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=60_000), rng.integers(0, 2, 60_000)
    df = spark.createDataFrame([(i, float(x), float(k), int(x > 0.5)) for i, (x, k) in enumerate(zip(a, b))], "point_id long, a double, b double, classification int")
    model = ml.train_classifier(df, ["a", "b"], trees=5, depth=4)
    cuts, flag = model.cuts
    assert len(cuts) == 31 and flag == [0.0]
    shares = np.bincount(np.searchsorted(cuts, a), minlength=32) / len(a)
    assert np.abs(shares - 1 / 32).max() < 0.002
    found = ml.predict(model, df).join(df, "point_id").agg(F.avg((F.col("pred_class") == F.col("classification")).cast("double"))).first()[0]
    assert found > 0.98


def test_rare_values_share_a_bin(spark):
    x = np.concatenate([np.zeros(5000), np.ones(5), np.arange(2.0, 5002.0)])
    rows = spark.createDataFrame([([float(v)],) for v in x], "x array<double>")
    cuts = ml.forest_cuts(rows, 1)[0]
    shares = np.bincount(np.searchsorted(cuts, x)) / len(x)
    assert len(cuts) > 10 and shares.min() >= 1 / ml.LEAST_BIN
