"""Quality by co-training: a text view and a metadata view teach each other.

Text view: what the words look like (shares of kinds of characters, repetition, word lengths).
Metadata view: what is known of the page beside its words (language, source, recorded length, layout
of lines).  Each view has a logistic regression.  First both learn from labelled rows; then, in
each round, every unlabelled row of which one view is confident is a pseudo-labelled row for the
other, with a smaller weight, and both learn again.  Rows of a calibration fold take no part in
this; on them the two views' log-odds are calibrated together into one probability.  Every
row is scored.

Null and empty texts have zero shares; null language and source count as empty strings, a null
length as zero; repeated rows score alike.  Labels that are null are ignored, the highest of
several for one row counts.  Without labelled rows of both kinds nothing can be learned: every
row scores 1 and is kept.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.llm.common import by_batch, prepare, stored, text_or_empty

ROUNDS, CONFIDENT, PSEUDO_WEIGHT, THRESHOLD = 3, 0.97, 0.3, 0.5
FOLDS = 5  # one fold calibrates
STEPS = 8  # Newton steps of a fit
TREE = 64  # partial sums added in one task
SOURCES, LANGUAGES = 16, 8  # hash slots
# Characters whose shares are features of their own.
SIGNS = b"|!?*$&%#@<>{}[]()/\\=_+~^.,;:'\"-"


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


GROUPS = np.stack([table(bytes(range(65, 91))), table(bytes(range(97, 123))), table(b"0123456789"), table(b" \t"), table(b"\n\r"),
                   table(bytes(range(128, 256))), *(table(bytes([c])) for c in SIGNS)])


def text_view(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * (len(GROUPS) + 6)
    shares = GROUPS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words = text.split()
    n = max(len(words), 1)
    seen = set(words)
    bare = len({w.strip("|!?*$&%#.,") for w in seen})
    return [*np.sqrt(shares).tolist(), len(seen) / n, bare / n, min(len(data) / n, 200) / 20, np.log1p(n) / 5,
            sum(map(len, seen)) / max(len(seen), 1) / 10, (shares[0] + 1e-3) / (shares[0] + shares[1] + 2e-3)]


def metadata_view(text: str, lang: str, source: str, n_chars: int) -> list[float]:
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    n, total = len(lines), max(sum(sizes), 1)
    known = [np.log1p(max(n_chars, 0)) / 5, np.log1p(n) / 3, np.log1p(total / n) / 5, max(sizes) / total, sum(s < 30 for s in sizes) / n,
             len(set(lines)) / n, sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / n]
    slots = [0.0] * (SOURCES + LANGUAGES)
    slots[zlib.crc32(source.encode("utf-8", "replace")) % SOURCES] = 1.0
    slots[SOURCES + zlib.crc32(lang.encode("utf-8", "replace")) % LANGUAGES] = 1.0
    return known + slots


@dataclass
class QualityModel:
    """Intercept and weights of both views, and of the calibration of their log-odds."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    both: np.ndarray | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both."""
        if self.both is None:
            return (np.ones(len(text)),) * 3
        odds = self.log_odds(text, meta)
        return sigmoid(odds[:, 0]), sigmoid(odds[:, 1]), sigmoid(self.both[0] + odds @ self.both[1:])

    def log_odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Log-odds of both views, side by side."""
        return np.clip(np.column_stack([text @ self.text[1:] + self.text[0], meta @ self.meta[1:] + self.meta[0]]), -15, 15)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def views(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, by_text, by_meta``: the features of both views."""
    prepare(docs.sparkSession)

    def run(c):
        return {"k": c["k"], "by_text": [text_view(t) for t in c["t"]],
                "by_meta": [metadata_view(*x) for x in zip(c["t"], c["lang"], c["source"], c["n"])]}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), *inputs(docs))
    return by_batch(rows, run, f"k {kind}, by_text array<double>, by_meta array<double>").withColumnRenamed("k", key)


def inputs(docs: DataFrame) -> list[Column]:
    has = set(docs.columns)
    word = lambda c: text_or_empty(c) if c in has else F.lit("")
    number = F.coalesce(F.col("n_chars").cast("long"), F.lit(0)) if "n_chars" in has else F.lit(0)
    return [word("lang").alias("lang"), word("source").alias("source"), number.cast("long").alias("n")]


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays: views as matrices, a missing label as not-a-number."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def totals(rows: DataFrame, terms: Callable[[dict[str, np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of the arrays that ``terms`` makes of a batch, added up in tasks and then in a tree."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = terms(arrays(batch))
                total = made if total is None else [x + y for x, y in zip(total, made)]
        if total is not None:
            yield packed(total)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                made = pickle.loads(row)
                total = made if total is None else [x + y for x, y in zip(total, made)]
        if total is not None:
            yield packed(total)

    def packed(arrays: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(arrays)], pa.binary())], names=["sums"])

    sums, parts = rows.mapInArrow(part, "sums binary"), rows.rdd.getNumPartitions()
    while parts > TREE:
        parts = -(-parts // TREE)
        sums = sums.repartition(parts).mapInArrow(join, "sums binary")
    found = [pickle.loads(r.sums) for r in sums.collect()]
    return [sum(x[1:], x[0]) for x in zip(*found)]


def logistic_terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Negative Hessian, gradient and total weight of a logistic likelihood, intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    p = sigmoid(x @ weights)
    return [x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (y - p)), np.array([w.sum()])]


def stepped(weights: np.ndarray, hessian: np.ndarray, gradient: np.ndarray, size: np.ndarray, prior: float = 1e-4) -> np.ndarray:
    """One Newton step under a ridge in proportion to the rows' weight; the intercept is hardly held."""
    ridge = np.full(len(weights), prior * max(float(size[0]), 1.0))
    ridge[0] *= 1e-3
    step = np.linalg.solve(hessian + np.diag(ridge + 1e-9), gradient - ridge * weights)
    return weights + step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-9))


def learn_views(rows: DataFrame, model: QualityModel, teachers: QualityModel | None, confident: float, pseudo_weight: float) -> None:
    """Fit both views; with ``teachers`` each view's confident unlabelled rows are labelled rows of the other."""
    sure = float(np.log(confident / (1 - confident)))
    for _ in range(STEPS):
        now = (model.text, model.meta)

        def terms(c):
            views = [c["by_text"], c["by_meta"]]
            given = c["y"].astype(float)
            known = ~np.isnan(given)
            out = []
            for i, other in ((0, 1), (1, 0)):
                y, w = given.copy(), known.astype(float)
                if teachers is not None:
                    guide = (teachers.text, teachers.meta)[other]
                    z = views[other] @ guide[1:] + guide[0]
                    take = ~known & (np.abs(z) > sure)
                    y[take], w[take] = z[take] > 0, pseudo_weight  # labels of unlabelled rows are no longer missing
                use = w > 0
                out += logistic_terms(views[i][use], y[use], w[use], now[i])
            return out

        t = totals(rows, terms)
        model.text, model.meta = stepped(model.text, *t[:3]), stepped(model.meta, *t[3:])


def calibrate(rows: DataFrame, model: QualityModel) -> None:
    """Weights of the two views' log-odds, on rows that taught neither."""
    both = np.array([0.0, 0.5, 0.5])
    for _ in range(STEPS):
        def terms(c, both=both):
            return logistic_terms(model.log_odds(c["by_text"], c["by_meta"]), c["y"].astype(float), np.ones(len(c["y"])), both)

        both = stepped(both, *totals(rows, terms))
    model.both = both


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, confident: float = CONFIDENT,
        pseudo_weight: float = PSEUDO_WEIGHT, seen: DataFrame | None = None) -> QualityModel:
    """Learn from all labelled and unlabelled rows; ``seen`` may hold the views of ``docs``."""
    seen = stored(views(docs, key=key, text=text), "quality-views") if seen is None else seen
    marks = (labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("quality").cast("int").alias("y")))
    fold = F.when(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True)).otherwise(False)
    rows = stored(seen.join(marks, key, "left").select("by_text", "by_meta", "y", fold.alias("calibrates")), "quality-rows")
    kinds = {(r.y, r.calibrates) for r in rows.where("y IS NOT NULL").select("y", "calibrates").distinct().collect()}
    model = QualityModel()
    if not {(0, False), (1, False)} <= kinds:
        return model
    model.text, model.meta = np.zeros(len(text_view("x")) + 1), np.zeros(len(metadata_view("x", "", "", 1)) + 1)
    training = rows.where("NOT (calibrates AND y IS NOT NULL)")
    learn_views(training.where("y IS NOT NULL"), model, None, confident, pseudo_weight)
    for _ in range(rounds):
        learn_views(training, model, QualityModel(model.text, model.meta), confident, pseudo_weight)
    # Without both kinds in the calibration fold, calibrate on the training rows.
    labelled = rows.where("y IS NOT NULL")
    calibrate(labelled.where("calibrates") if {(0, True), (1, True)} <= kinds else labelled, model)
    return model


def score(seen: DataFrame, model: QualityModel, *, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key, text_score, meta_score, score, keep`` from the views of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = arrays(batch.select(["by_text", "by_meta"]))
                scores = [pa.array(x) for x in model.scores(c["by_text"], c["by_meta"])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *scores], names=["k", "text_score", "meta_score", "score"])

    kind = seen.schema[key].dataType.simpleString()
    return (seen.select(F.col(key).alias("k"), "by_text", "by_meta").mapInArrow(run, f"k {kind}, text_score double, meta_score double, score double")
            .withColumn("keep", F.col("score") >= threshold).withColumnRenamed("k", key))


def keep_good(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    @F.pandas_udf("double")
    def good(texts, langs, sources, lengths):
        import pandas as pd
        a = np.array([text_view(t) for t in texts]).reshape(len(texts), -1)
        b = np.array([metadata_view(*x) for x in zip(texts, langs, sources, lengths)]).reshape(len(texts), -1)
        return pd.Series(model.scores(a, b)[2])

    return docs.where(good(text_or_empty(text), *inputs(docs)) >= threshold)


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by text, by metadata and by both."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    seen = stored(views(docs), "quality-views")
    return score(seen, fit(docs, labels, seen=seen))
