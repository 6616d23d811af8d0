"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed letter trigrams, scaled to length one. Each language has several
centroids from spherical k-means over a bounded sample of its labelled texts; a text takes the language
of the centroid with the greatest cosine. A text whose cosine falls below its length's share of that
centroid's least usual similarity is rejected as being in none of the learned languages.

Defined cases: a text that is null or has no letter is `und`, with score 0, and rejected; with no
training rows every text is `und`; of equal cosines the language first in the alphabet wins; repeated
rows get equal results; the input's columns stay as they are, added ones are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import bound_batches, released

#: Hash buckets, centroids a language, most texts sampled for a language.
BUCKETS, CENTROIDS, SAMPLE = 4096, 4, 600
#: Rejected: cosine below this share of the centroid's 1st percentile, scaled by length.
REJECT = 0.5

_PLAIN = bytes(b if chr(b).isalpha() or b >= 0x80 else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased letters; anything else is white space."""
    data = np.frombuffer((b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "), np.uint8).astype(np.uint32)
    grams = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    grams = grams[(data[1:-1] != 32)]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


@dataclass
class Model:
    """Learned languages, centroids (their language in `owner`), least usual similarity of each."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    usual: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        x = np.sqrt(np.array([trigram_counts(t) for t in texts], np.float32).reshape(len(texts), BUCKETS)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        usable = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        for at in range(0, len(usable), 64):
            part = usable[at : at + 64]
            near = self.vectors([texts[i] for i in part]) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, c, s in zip(part, best, near[np.arange(len(part)), best], strict=True):
                short = min(1.0, (len(texts[i]) / 400) ** 0.5)  # a few words fill few buckets
                langs[i], scores[i] = self.languages[self.owner[c]], float(min(1.0, max(0.0, s)))
                rejected[i] = bool(s < REJECT * short * self.usual[c])
        return langs, scores, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; it starts from rows far from those chosen before."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centres = x[chosen]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres[np.isin(np.arange(len(centres)), (x @ centres.T).argmax(axis=1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [trigram_counts(t.as_py()).astype("<f4").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["lang", "counts"])


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows(text, lang) with both set.

    Each language gives `sample` of its distinct texts, or all if it has fewer: those with the least hashes. Their
    trigrams are counted on the executors; the driver gets `sample` vectors of BUCKETS floats a language at most.
    """
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text")).where("lang is not null and text is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    distinct = rows.select("lang", "h").distinct()
    share = F.broadcast(distinct.groupBy("lang").count().select("lang", F.least(F.lit(1.0), (sample + 8 * sample**0.5) / F.col("count")).alias("share")))
    place = F.pmod(F.col("h"), F.lit(1 << 40)) / float(1 << 40)
    # of distinct texts, so that a group of copies counts once; somewhat more than the sample, whose least hashes stay
    first = distinct.join(share, "lang").where(place < F.col("share")).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "h"))).where(F.col("r") <= sample)
    chosen = [(r["lang"], r["h"]) for r in first.select("lang", "h").collect()]
    if not chosen:
        return Model([], np.zeros(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    chosen = F.broadcast(rows.sparkSession.createDataFrame(chosen, "lang string, h long"))
    picked = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    got = sorted((r["lang"], bytes(r["counts"])) for r in picked.select("lang", "text").mapInArrow(released(_count), "lang string, counts binary").collect())
    languages = sorted({lang for lang, _ in got})
    x = np.frombuffer(b"".join(c for _, c in got), "<f4").reshape(len(got), BUCKETS)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = np.sqrt(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    of = np.array([languages.index(lang) for lang, _ in got])
    centroids, owner = [], []
    for i in range(len(languages)):
        own = _clusters(x[of == i], CENTROIDS)
        centroids.append(own)
        owner += [i] * len(own)
    centroids, owner = np.concatenate(centroids).astype(np.float32), np.array(owner)
    near = np.where(owner[None, :] == of[:, None], x @ centroids.T, -1.0)
    best, most = near.argmax(axis=1), near.max(axis=1)
    usual = np.array([np.quantile(most[best == c], 0.01) if (best == c).any() else 0.0 for c in range(len(owner))])
    return Model(languages, idf, centroids, owner, usual)


def language(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = model.predict(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return run(text)


def is_held_out(doc_id: Column) -> Column:
    """The third of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Learn from the documents not held out, predict all: doc_id, held_out, lang_pred, score, rejected."""
    held = is_held_out(F.col("doc_id"))
    model = train(documents.where(~held).select("text", "lang"))
    found = documents.select("doc_id", held.alias("held_out"), language(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.*")
