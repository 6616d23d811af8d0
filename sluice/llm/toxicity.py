"""Toxic passages by maximum-scoring segments.

Words score by log-odds between toxic and clean training texts with an informative Dirichlet prior (the
corpus frequency of the feature). A word's features are itself and its first four to eight bytes,
so that unseen forms of known stems score too; the feature whose likelihood ratio is the most significant
counts, and each repetition in a text halves a positive score. A drift makes an average clean word score below zero, and one linear scan finds every maximal segment of
positive score. The scale of random segments comes from the Karlin-Altschul equation over clean words;
the segments' normalised scores, added up as exponentials, less the logarithm of the text's length, follow
an extreme-value law in clean texts, against which a logistic curve is fitted on a bounded sample of training texts with
log-odds that were learned from the others; the log-odds that score are learned from all.

Defined cases: a null text is an empty text; repeated rows teach once each and calibrate once together;
features whose ratios are equal rank by the order in which a word gives them; a very long text is scanned
whole, in time linear in its words; a text without words gets the score of no evidence; with no
training rows, or rows of one class, every score is that class's share (0 without rows); a label that
is null teaches nothing; of several labels of a document each counts; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import bound_batches, materialise, released, scratch
from sluice.llm.license_scan import words_of

#: Weight of the prior, least texts of a feature, least likelihood ratio (twice the logarithm).
PRIOR, LEAST_TEXTS, LEAST_RATIO = 10.0, 3, 15.0
#: Score taken from each word; largest score of a word; distinct labelled texts that calibrate, about.
DRIFT, CLIP, CALIBRATION = 0.5, 9.0, 20_000
#: Lengths of the stems in bytes.
STEMS = (4, 5, 6, 7, 8)
#: Labels up to this count are sent to every executor instead of shuffling the texts.
BROADCAST_LABELS = 1_000_000
_FLUSH, _MEMO = 200_000, 200_000


def features(word: bytes) -> list[bytes]:
    """A word and its stems; stems carry their length, so they never equal a word."""
    return [word, *(b"%d:%b" % (n, word[:n]) for n in STEMS if len(word) >= n)]


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) in linear time.

    Only positive words can begin or end one. Each new candidate is merged to the left as long as that
    yields a segment whose cumulative sum rises on both sides.
    """
    total = np.concatenate(([0.0], np.cumsum(weights)))
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    below: list[int] = []  # of each entry: the nearest one before it with a smaller sum before, or -1
    for i in np.flatnonzero(weights > 0).tolist():
        first, left, right = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = below[j]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, i, left, right))
                below.append(j)
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:], below[j:]
    return [(a, b, right - left) for a, b, left, right in stack]


@dataclass
class Model:
    """Log-odds by feature with their likelihood ratio, scale of random segments, extreme-value law, logistic curve."""

    weights: dict[bytes, tuple[float, float]]
    scale: float = 1.0
    place: float = 0.0
    spread: float = 1.0
    slope: float = 0.0
    shift: float = -20.0
    memo: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word(self, word: bytes) -> float:
        if (found := self.memo.get(word)) is None:
            seen = [x for f in features(word) if (x := self.weights.get(f))]
            odds = max(seen, key=lambda x: x[1])[0] if seen else 0.0
            found = max(-CLIP, min(CLIP, odds)) - DRIFT
            if len(self.memo) < _MEMO:
                self.memo[word] = found
        return found

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        weights = np.fromiter(map(self.word, words), np.float64, len(words))
        seen: Counter = Counter()
        for i in np.flatnonzero(weights > 0).tolist():
            weights[i] = (weights[i] + DRIFT) * 0.5 ** min(seen[words[i]], 60) - DRIFT
            seen[words[i]] += 1
        return len(words), maximal_segments(weights)

    def evidence(self, n_words: int, segments: list[tuple[int, int, float]]) -> float:
        """All segments together in units of the scale, corrected for length; 0 words give no evidence.

        Each adds the exponential of its score, the inverse of what chance expects of such a segment, so one strong
        passage counts like many weaker ones.
        """
        scores = [self.scale * s for _, _, s in segments]
        most = max(scores, default=0.0)
        return most + math.log(sum(math.exp(s - most) for s in scores) or 1.0) - math.log(max(n_words, 1))

    def p_value(self, evidence: float) -> float:
        """The chance that a clean text has so strong a segment."""
        return -math.expm1(-math.exp(max(-700.0, min(700.0, -(evidence - self.place) / self.spread))))

    def score(self, evidence: float) -> float:
        x = self.slope * (evidence - self.place) / self.spread + self.shift
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class and part (0: the others, 1: calibrating) with each feature, flushed before the counters grow too large."""
    four = tuple(Counter() for _ in range(4))
    memo: dict[bytes, list[bytes]] = {}

    def of(word: bytes) -> list[bytes]:
        if (found := memo.get(word)) is None:
            found = features(word)
            if len(memo) < _MEMO:
                memo[word] = found
        return found

    def out():
        names = list(set().union(*four))
        table = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in four)], names=["feature", "clean0", "toxic0", "clean1", "toxic1"])
        for c in four:
            c.clear()
        return table

    for batch in batches:
        for text, toxic, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            four[2 * part + toxic].update(set(chain.from_iterable(map(of, set(words_of(text.as_py()))))))
            if sum(map(len, four)) > _FLUSH:
                yield out()
    yield out()


def _feature_counts(train: DataFrame) -> DataFrame:
    columns = ["clean0", "toxic0", "clean1", "toxic1"]
    found = train.select("text", "toxic", "part").mapInArrow(released(_counts), "feature binary, " + ", ".join(f"{c} long" for c in columns))
    return found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in columns))


def _log_odds(counts: DataFrame, n_clean: int, n_toxic: int) -> dict[bytes, tuple[float, float]]:
    """All significant features, of counts(feature, clean, toxic); compared on the executors.

    Only these reach the driver: words that tell the classes apart, a vocabulary that no longer grows once the
    labels are many. No feature is cut off, so none depends on what others there are.
    """
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / float(n_clean + n_toxic)
    odds = {}
    for name, n in (("toxic", n_toxic), ("clean", n_clean)):
        have = F.col(name) + prior + 0.01
        odds[name] = have, F.log(have) - F.log(F.greatest(F.lit(n + PRIOR) - F.col(name) - prior, F.lit(0.5)))
    delta = odds["toxic"][1] - odds["clean"][1]
    # twice the log of how much better two rates explain the counts than one
    texts, ratio = F.col("clean") + F.col("toxic"), F.lit(0.0)
    for name, n in (("toxic", n_toxic), ("clean", n_clean)):
        usual = texts * (n / (n_clean + n_toxic))
        ratio = ratio + 2 * F.when(F.col(name) > 0, F.col(name) * F.log(F.col(name) / usual)).otherwise(0.0)
    kept = counts.where(texts >= LEAST_TEXTS).select("feature", delta.alias("delta"), ratio.alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)
    return {bytes(r["feature"]): (r["delta"], r["ratio"]) for r in kept.collect()}


def _word_scores(models_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = models_cast.value
        found: Counter = Counter()
        words: Counter = Counter()

        def count():
            for w, n in words.items():
                for i, model in enumerate(models):
                    found[i, round(model.word(w), 3)] += n
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                words.update(words_of(text.as_py()))
                if len(words) > _FLUSH:
                    count()
        count()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.float64()), pa.array(list(found.values()), pa.int64())], names=["model", "score", "n"])

    return run


def _set_scales(models: list[Model], clean: DataFrame) -> None:
    """The scale of each model from the words of all distinct clean texts; a score has three decimals, so few rows come back."""
    distinct = clean.select("text", F.xxhash64("text").alias("h"), F.length("text").alias("l")).dropDuplicates(["h", "l"])
    cast = clean.sparkSession.sparkContext.broadcast(models)
    rows = distinct.select("text").mapInArrow(released(_word_scores(cast)), "model int, score double, n long").groupBy("model", "score").agg(F.sum("n").alias("n")).collect()
    for i, model in enumerate(models):
        model.scale = _scale({r["score"]: r["n"] for r in rows if r["model"] == i})


def _scale(found: dict[float, int]) -> float:
    """The positive root of E[exp(scale * score)] = 1 over the words of clean texts, counted by score."""
    values, share = np.array(list(found), float), np.array(list(found.values()), float)
    if not len(values) or values.max() <= 0:
        return 1.0
    share /= share.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
    return min(max(low, 0.05), 5.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift with a slight pull to zero, by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def _evidence(model_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_cast.value
        for batch in batches:
            found = [model.evidence(*model.segments(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "y"])

    return run


def fit(train: DataFrame) -> Model:
    """Learn from train(text binary, toxic 0/1).

    The log-odds use every row. The curve uses about CALIBRATION distinct texts, and of few a quarter, picked by a
    hash: their evidence comes from log-odds that were learned without them. Copies count once there, so that
    a frequent text can't fill the sample.
    """
    spark = train.sparkSession
    n = train.select(F.xxhash64("text").alias("h")).distinct().count()
    share = min(0.25, CALIBRATION / max(n, 1))
    train = train.withColumn("part", (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * share)).cast("int"))
    parts = {(r["toxic"], r["part"]): r["count"] for r in train.groupBy("toxic", "part").count().collect()}
    sizes = [parts.get((k, 0), 0) + parts.get((k, 1), 0) for k in (0, 1)]
    if not sizes[0] or not sizes[1]:
        return Model({}, shift=20.0 if sizes[1] else -20.0)
    counts = materialise(_feature_counts(train), "features")
    model = Model(_log_odds(counts.select("feature", (F.col("clean0") + F.col("clean1")).alias("clean"), (F.col("toxic0") + F.col("toxic1")).alias("toxic")), *sizes))
    others = [parts.get((k, 0), 0) for k in (0, 1)]
    apart = Model(_log_odds(counts.select("feature", F.col("clean0").alias("clean"), F.col("toxic0").alias("toxic")), *others) if all(others) else model.weights)
    _set_scales([model, apart], train.where("toxic = 0"))
    once = train.where("part = 1").groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))
    rows = once.select("text", "toxic").mapInArrow(released(_evidence(spark.sparkContext.broadcast(apart))), "x double, y int").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    if not len(x) or y.min() == y.max():
        x, y = np.append(x, [0.0, 10.0]), np.append(y, [0.0, 1.0])
    clean = x[y == 0]
    model.spread = max(float(clean.std()) * math.sqrt(6) / math.pi, 0.05)
    model.place = float(clean.mean()) - 0.5772156649 * model.spread
    model.slope, model.shift = _logistic((x - model.place) / model.spread, y)
    return model


def passages(text: Column, model: Model, most_p: float = 0.01):
    """array<struct(first, last, score)>: the word spans of every significant toxic passage of a text."""
    cast = text_model(model)

    @F.pandas_udf("array<struct<first:long,last:long,score:double>>")
    def run(texts: pd.Series) -> pd.Series:
        own, out = cast.value, []
        for t in texts:
            n, found = own.segments((t or "").encode())
            out.append([{"first": a, "last": b, "score": s} for a, b, s in found if own.p_value(own.scale * s - math.log(max(n, 1))) <= most_p])
        return pd.Series(out)

    return run(text)


def text_model(model: Model):
    """The model as a broadcast value: the significant words and stems."""
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def _score(model_cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_cast.value
        for batch in batches:
            scores, spans = [], []
            for t in batch.column(2):
                n, found = model.segments(t.as_py())
                scores.append(model.score(model.evidence(n, found)))
                spans.append(sum(model.p_value(model.scale * s - math.log(max(n, 1))) <= 0.01 for _, _, s in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_passages"])

    return run


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents not held out, score all: doc_id, held_out, score, predicted, n_passages."""
    bound_batches(documents.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").withColumn("fold", fold).where("fold != 0")
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    model = fit(rows.join(known, "doc_id"))
    return rows.select("doc_id", (fold == 0).alias("held_out"), "text").mapInArrow(released(_score(text_model(model))), "doc_id long, held_out boolean, score double, predicted int, n_passages long")
