"""Removal of passages that repeat, by hashing lines and their sentences.

A unit is a line or, where a line holds several, one of its sentences, so that an edit spoils one sentence
and not its whole line. Units are compared in lower case with white space collapsed, by a 128-bit digest.
Of equal units the earliest keeps its place: smallest doc_id, then smallest digest of the whole text, then
position. Consecutive units that an earlier place already holds form a passage, which is removed, with its
offsets in the original text. A caller that wants to keep stock phrases asks for passages of `min_words`
words at least; without it every repeated unit goes.

Units are aggregated by digest with map-side combination. Digests that make up more than a FREQUENT-th of all
units are fewer than FREQUENT by definition: they are broadcast, so that their units stay where they are. The
others that occur twice are joined by a shuffle, in which no digest is frequent.

Defined cases: a null or blank text has no units; rows without a doc_id rank last; rows equal in doc_id
and text count as one document; a text that is removed completely becomes an empty text (the caller
decides about it); further columns of the documents stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import bound_batches, materialise, released, scratch, unused

#: Words of a passage that the query and the pipeline remove, at least.
MIN_WORDS = 20
#: Digests with more than this part of all units are joined by broadcast.
FREQUENT = 1000
#: Documents with passages up to this number are sent to every executor.
BROADCAST_ROWS = 500_000
_LAST = (1 << 63) - 1

_SPACE = re.compile(r"\s+")
_UNITS = "doc_id long, doc_key long, pos int, start int, end int, words int, h1 long, h2 long"


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit that isn't blank, in code points; in time linear in the text.

    White space ends a unit if it holds a line's end or follows a sentence's.
    """
    at = 0
    for gap in _SPACE.finditer(text):
        start = gap.start()
        if "\n" in gap[0] or start and text[start - 1] in ".!?":
            if start > at:
                yield at, start
            at = gap.end()
    if at < len(text):
        yield at, len(text)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.int64(), pa.int64())
    names = [x.split()[0] for x in _UNITS.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    for batch in batches:
        rows = []
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            for pos, (start, end) in enumerate(units(text)):
                words = text[start:end].lower().split()
                digest = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
                rows.append((doc_id, key, pos, start, end, len(words), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            if len(rows) >= 50_000:
                yield table(rows)
                rows = []
        yield table(rows)


def repeated_passages(documents: DataFrame, min_words: int = 0) -> DataFrame:
    """doc_id, doc_key, start, end, n_words, n_units, first_doc_id of every passage to remove.

    start and end are offsets in code points; first_doc_id holds the passage's first unit. doc_key is the
    hash of the whole text that tells apart rows with one doc_id.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text").where("text is not null")
    found = materialise(rows.mapInArrow(released(_split), _UNITS), "units")
    if not found.where("pos = 0").groupBy("doc_id", "doc_key").count().where("count > 1").isEmpty():
        found = found.dropDuplicates(["doc_id", "doc_key", "pos"])  # equal rows are one document
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "doc_key", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first, "first")
    often = F.col("n") * FREQUENT > found.count()
    frequent = F.broadcast(first.where(often).select("h1", "h2", "first"))  # fewer than FREQUENT rows
    others = found.join(frequent.drop("first"), ["h1", "h2"], "left_anti").join(first.where(~often).select("h1", "h2", "first"), ["h1", "h2"])
    both = found.join(frequent, ["h1", "h2"]).unionByName(others)
    later = both.where(place != F.col("first")).select("doc_id", "doc_key", "pos", "start", "end", "words", F.nullif("first.doc", F.lit(_LAST)).alias("first_doc_id"))
    order = Window.partitionBy("doc_id", "doc_key").orderBy("pos")
    runs = later.withColumn("run", F.col("pos") - F.row_number().over(order))
    passages = runs.groupBy("doc_id", "doc_key", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("n_words"), F.count(F.lit(1)).alias("n_units"), F.min(F.struct("pos", "first_doc_id")).alias("f")
    )
    return passages.where(F.col("n_words") >= min_words).select("doc_id", "doc_key", "start", "end", "n_words", "n_units", F.col("f.first_doc_id").alias("first_doc_id"))


def deduplicated(documents: DataFrame, min_words: int = 0) -> DataFrame:
    """The documents without repeated passages; those of which nothing is left go."""
    with scratch(documents.sparkSession) as keep:
        passages = keep(materialise(repeated_passages(documents, min_words), "passages"))
    return without_passages(documents, passages, drop_empty=True)


def without_passages(documents: DataFrame, passages: DataFrame, drop_empty: bool = False) -> DataFrame:
    """The documents with the passages cut out of `text` (and the white space after each).

    With drop_empty, documents whose text is blank, or all of which is cut, go; null texts stay.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is not None:
                kept, at = [], 0
                for span in sorted((s["start"], s["end"]) for s in found):
                    kept.append(text[at : span[0]])
                    at = span[1]
                    while at < len(text) and text[at].isspace():
                        at += 1
                text = "".join([*kept, text[at:]]).rstrip()
            out.append(text)
        return pd.Series(out)

    doc, key, hashed, spans = unused(documents, "_id", "_key", "_hash", "_spans")
    found = passages.groupBy(F.col("doc_id").alias(doc), F.col("doc_key").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(spans))
    found = F.broadcast(found) if passages.count() <= BROADCAST_ROWS else found
    joined = documents.withColumn(hashed, F.xxhash64("text")).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(hashed) == F.col(key)), "left")
    # texts without passages don't travel to Python; as a call that may not be repeated it runs once, also under the filter
    has = F.col(spans).isNotNull()
    changed = cut.asNondeterministic()(F.when(has, F.col("text")), F.col(spans))
    out = joined.withColumn("text", F.coalesce(changed, F.col("text"))).select(documents.columns)
    return out.where(F.col("text").isNull() | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")) if drop_empty else out
