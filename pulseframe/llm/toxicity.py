"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Learning, from a bounded sample of labelled rows (``train_rows``, taken in hash order):

1. Words and word beginnings are counted by label in Spark.  Those found in toxic rows more often
   than chance allows form the lexicon, of at most ``lexicon`` entries.
2. Words of toxic rows that match the lexicon are the labelled toxic tokens, all others are not.
   A token's observation is the kind and strength of its best lexicon entry.
3. The field's weights (states x observations, transitions, start) are fitted by gradient
   ascent with forward-backward on at most ``chain_rows`` of those rows.
4. A logistic calibration maps the evidence in a document's marginals to a probability.

Scoring reads every whole text.  Runs of ordinary tokens are not walked: their messages settle
after ``SETTLE`` steps, so a run's middle stands for the rest with its count as weight.

Scores use the text alone.  Null and empty texts hold no token and score as the calibration's
intercept says; without labelled rows of both kinds every score is zero.  Labels that are null are
ignored; of several labels for one row the highest counts.  Ties and repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.llm.common import Memo, by_batch, prepare, stored, text_or_empty

TRAIN_ROWS, CHAIN_ROWS, LEXICON = 20_000, 3_000, 20_000
BEGINNINGS = (3, 4, 5, 6, 7)
SETTLE = 24  # ordinary tokens after which a message no longer changes in double precision
KINDS = 9  # nothing, and words or beginnings of four strengths each
THRESHOLD = 0.7
EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def features(word: str) -> list[str]:
    """The bare lower-case word, marked ``=``, and its beginnings, marked ``^``."""
    bare = EDGE.sub("", word)
    if not bare:
        return []
    return ["=" + bare, *("^" + bare[:n] for n in BEGINNINGS if len(bare) >= n)]


def chance(toxic: float, clean: float, share: float) -> float:
    """Natural logarithm of the chance of at most ``clean`` clean rows, bounded as for a binomial (Chernoff)."""
    n = toxic + clean
    q = toxic / n
    if q <= share:
        return 0.0
    return -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0))


@dataclass
class ToxicModel:
    """Lexicon entry -> observation; the field's weights; the calibration."""

    lexicon: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros(KINDS))  # weight of the toxic state over the other
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    calibration: tuple[float, ...] | None = None
    memo: Memo | None = None

    def __getstate__(self):
        return {**self.__dict__, "memo": None}

    def kind(self, word: str) -> int:
        """The strongest observation among the word's lexicon entries; 0 if none."""
        best, strength = 0, -1
        for f in features(word):
            k = self.lexicon.get(f, 0)
            if k and (k - 1) % 4 > strength:
                best, strength = k, (k - 1) % 4
        return best

    def observe(self, text: str) -> list[int]:
        if self.memo is None:
            self.memo = Memo(lambda words: [self.kind(w) for w in words])
        return self.memo.values(text.lower().split())

    def marginals(self, kinds: list[int]) -> list[tuple[int, int, float]]:
        """``(first token, number of tokens, chance of being toxic)`` over the whole text."""
        steps = compress(kinds)
        return list(zip((s[0] for s in steps), (s[2] for s in steps), self.chain([s[1] for s in steps])[0])) if steps else []

    def chain(self, kinds: list[int]) -> tuple[list[float], list[float], list[float]]:
        """Forward-backward in ratios toxic : not.  Marginals, forward and backward ratios."""
        emit = np.exp(self.emit).tolist()
        (a, b), (c, d) = np.exp(self.move).tolist()
        forward, r = [], None
        for k in kinds:
            r = math.exp(self.start) * emit[k] if r is None else emit[k] * (b + r * d) / (a + r * c)
            forward.append(r)
        backward, s = [1.0] * len(kinds), 1.0
        for i in range(len(kinds) - 1, 0, -1):
            e = emit[kinds[i]] * s
            s = (c + d * e) / (a + b * e)
            backward[i - 1] = s
        return [1 - 1 / (1 + f * g) for f, g in zip(forward, backward)], forward, backward

    def summary(self, kinds: list[int]) -> tuple[float, float, list[tuple[int, float]]]:
        """Expected toxic tokens, evidence that some token is toxic, and the tokens that more likely are.

        The evidence is ``log(1 + e)``, e being the negative logarithm of the chance that no token is toxic.
        """
        expected, none, spans = 0.0, 0.0, []
        for at, n, p in self.marginals(kinds):
            if kinds[at]:  # ordinary tokens tell about length, not about insults
                expected += n * p
                none += n * math.log1p(-min(p, 1 - 1e-12))
            if p > 0.5:
                spans.append((at, p))
        return expected, math.log1p(-none), spans

    def score(self, summary: tuple) -> float:
        if self.calibration is None:
            return 0.0
        w0, w1 = self.calibration
        z = w0 + w1 * summary[1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def compress(kinds: list[int]) -> list[tuple[int, int, int]]:
    """``(first token, observation, tokens)``: long runs of 0 keep SETTLE tokens at each end and one for the rest."""
    steps, last = [], 0
    marked = [i for i, k in enumerate(kinds) if k] if any(kinds) else []
    for at in [*marked, len(kinds)]:
        run = at - last
        if run <= 2 * SETTLE + 1:
            steps.extend((i, 0, 1) for i in range(last, at))
        else:
            steps.extend((i, 0, 1) for i in range(last, last + SETTLE))
            steps.append((last + SETTLE, 0, run - 2 * SETTLE))
            steps.extend((i, 0, 1) for i in range(at - SETTLE, at))
        if at < len(kinds):
            steps.append((at, kinds[at], 1))
        last = at + 1
    return steps


def fit_chain(model: ToxicModel, rows: list[tuple[list[int], bool]], *, rounds: int = 25, prior: float = 0.5) -> None:
    """Gradient ascent on the tags' conditional likelihood: tags are toxic where a toxic row's token matched.

    Observed counts less expected counts, each step divided by the counts' size; ``prior`` pulls weights to zero.
    """
    groups = Counter((tuple(s[1] for s in steps), tuple(s[2] for s in steps), toxic) for steps, toxic in ((compress(k), t) for k, t in rows) if steps)
    emit, move, start, n = np.zeros(KINDS), np.zeros((2, 2)), 0.0, sum(groups.values())
    for (kinds, counts, toxic), many in groups.items():
        tags = [1 if k and toxic else 0 for k in kinds]
        for k, c, y in zip(kinds, counts, tags):
            emit[k] += many * c * y
        for i in range(1, len(tags)):
            move[tags[i - 1], tags[i]] += many
        move[0, 0] += many * sum(c - 1 for c in counts)
        start += many * tags[0]
    size = np.zeros(KINDS)
    for (kinds, counts, _), many in groups.items():
        np.add.at(size, list(kinds), [many * c for c in counts])
    # Start from the shares of each observation; the chain then shifts weight to the transitions.
    share = (emit + 0.5) / (size + 1)
    model.emit = np.log(share / (1 - share))
    speed_emit, speed_move, speed_start = (np.zeros(KINDS), np.zeros((2, 2)), 0.0)
    for _ in range(rounds):
        e_emit, e_move, e_start = np.zeros(KINDS), np.zeros((2, 2)), 0.0
        weight = np.exp(model.move)
        odds = np.exp(model.emit)
        for (kinds, counts, toxic), many in groups.items():
            p, forward, backward = model.chain(list(kinds))
            np.add.at(e_emit, list(kinds), many * np.array(counts) * np.array(p))
            e_start += many * p[0]
            f, e = np.array(forward[:-1]), odds[list(kinds[1:])] * np.array(backward[1:])
            joint = np.stack([np.broadcast_to(weight[0, 0], f.shape), weight[0, 1] * e, weight[1, 0] * f, weight[1, 1] * f * e])
            e_move += many * (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            e_move[0, 0] += many * sum(c - 1 for c in counts)
        step = lambda seen, expect, w, of: (seen - expect - prior * w) / (of + 1)
        # Momentum with per-weight scale.
        speed_emit = 0.6 * speed_emit + 2.0 * step(emit, e_emit, model.emit, np.maximum(emit, e_emit))
        speed_move = 0.6 * speed_move + 0.5 * step(move, e_move, model.move, np.maximum(move, e_move))
        speed_start = 0.6 * speed_start + 0.5 * step(start, e_start, model.start, max(start, e_start))
        model.emit = np.clip(model.emit + speed_emit, -12, 12)
        model.move = np.clip(model.move + speed_move, -6, 6)
        model.start = float(np.clip(model.start + speed_start, -12, 12))


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression on rows counted ``n`` times, intercept first, by Newton steps with a ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = prior * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, train_rows: int) -> DataFrame:
    """``k, t, toxic`` of at most ``train_rows`` labelled rows that aren't held out, in hash order."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
             .groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("toxic")))
    # Labelled keys are few beside the documents: choose them first, then read the texts of the chosen.
    chosen = marks.join(docs.select(F.col(key).alias("k")).distinct(), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(train_rows)
    return F.broadcast(chosen).join(docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")), "k").select("k", "t", "toxic")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS,
        chain_rows: int = CHAIN_ROWS, lexicon: int = LEXICON, least: int = 3) -> ToxicModel:
    """Learn from labelled rows outside the held-out third."""
    prepare(docs.sparkSession)
    rows = stored(training_rows(docs, labels, key, text, train_rows), "toxic-training")
    model = ToxicModel()
    n = rows.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in n}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = (Counter(), Counter()), {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set()
                for w in set(t.lower().split()):
                    f = known.get(w)
                    if f is None:
                        f = known[w] = features(w)
                    found.update(f)
                seen[y].update(found)
            if len(known) > 200_000 or len(seen[0]) + len(seen[1]) > 300_000:
                yield made(seen)
                seen, known = (Counter(), Counter()), {}
        yield made(seen)

    def made(seen):
        return pa.RecordBatch.from_arrays([pa.array([*seen[0], *seen[1]], pa.string()), pa.array([*seen[0].values(), *[0] * len(seen[1])], pa.int64()),
                                           pa.array([*[0] * len(seen[0]), *seen[1].values()], pa.int64())], names=["f", "clean", "toxic"])

    counts = (rows.select("t", "toxic").mapInArrow(count, "f string, clean long, toxic long")
              .groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    share = toxic / (toxic + clean)
    # Common to at least ``least`` toxic rows and mostly toxic: the candidates of the lexicon.
    mostly = counts.where(F.col("toxic") >= least)
    tests = mostly.count()
    strong = mostly.where((F.col("toxic") / toxic) > 4 * (F.col("clean") + 0.5) / clean)
    found = strong.orderBy(F.desc(F.col("toxic") - 2 * F.col("clean")), "f").limit(lexicon).collect()
    for r in found:
        if chance(r.toxic, r.clean, share) < -math.log(20 * max(tests, 1)):
            odds = math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1))
            strength = 0 if odds < 2 else 1 if odds < 3.5 else 2 if odds < 5 else 3
            model.lexicon[r.f] = 1 + strength + (4 if r.f[0] == "^" else 0)
    kind = rows.schema["k"].dataType.simpleString()
    seen = by_batch(rows.select("k", "t"), lambda c: {"k": c["k"], "o": [bytes(model.observe(t)) for t in c["t"]]}, f"k {kind}, o binary")
    seen = stored(seen.join(rows.select("k", "toxic"), "k"), "toxic-observations")
    part = [(list(r.o), r.toxic == 1) for r in seen.orderBy(F.xxhash64("k"), "k").limit(chain_rows).collect()]
    fit_chain(model, part)
    # Calibrate on all training rows; each becomes two numbers.
    pairs = by_batch(seen.select("o", "toxic"), lambda c: {"e": [model.summary(list(o))[1] for o in c["o"]], "y": c["toxic"]},
                     "e double, y int").groupBy(F.round("e", 3).alias("e"), "y").count().toPandas()
    w0, w1 = fit_logistic(pairs[["e"]].to_numpy(float), pairs["y"].to_numpy(float), pairs["count"].to_numpy(float))
    # More evidence never lowers a score.
    model.calibration = (float(w0), max(0.0, float(w1)))
    return model


def offsets(text: str, tokens: list[tuple[int, float]]) -> list[dict]:
    """Where in the text the given tokens stand."""
    if not tokens:
        return []
    wanted, out = dict(tokens), []
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i in wanted:
            out.append({"begin": m.start(), "end": m.end(), "chance": wanted[i]})
    return out


def score(docs: DataFrame, model: ToxicModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, spans``: probability that a row is toxic; spans are offending offsets with their marginals."""
    prepare(docs.sparkSession)

    def run(columns):
        scores, spans = [], []
        for t in columns["t"]:
            found = model.summary(model.observe(t))
            scores.append(model.score(found))
            spans.append(offsets(t, found[2]))
        return {"k": columns["k"], "score": scores, "spans": spans}

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return by_batch(rows, run, f"k {kind}, score double, spans array<struct<begin: int, end: int, chance: double>>").withColumnRenamed("k", key)


def keep_clean(docs: DataFrame, model: ToxicModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    @F.pandas_udf("double")
    def toxic(texts):
        return texts.map(lambda t: model.score(model.summary(model.observe(t)))).astype("float64")

    return docs.where(toxic(text_or_empty(text)) < threshold)


def op8_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; labels of the held-out third are never read."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                                     F.transform("spans", lambda s: s["begin"]).alias("span_begins"))
