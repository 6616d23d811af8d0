"""Byte-level BPE over overlapping chunks.

Long texts are cut into chunks of `chunk` code points, each with `overlap` more from its successor, and
pre-tokenised in parallel. The pattern looks back at nothing, so once two neighbouring chunks share a
pre-token boundary in their overlap they agree from there on: the smallest such boundary is the cut.
Pieces between cuts are encoded in parallel and their ids put together in order. Chunks without a common
boundary (one pre-token longer than the overlap) are joined and split as one piece. Shorter texts are
one chunk and take no shuffle.

Defined cases: a null text is an empty text without ids; repeated rows give repeated results; a row
without a doc_id is encoded like any other; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import bound_batches, released

CHUNK, OVERLAP = 16_384, 512

_PIECE = "doc_id long, key string, copies long, piece int, text string, starts array<int>, tail array<int>"
_IDS = "doc_id long, key string, copies long, run int, ids binary"
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_codings: dict = {}


def coding(ranks_path: str):
    """The tiktoken encoding of a rank file and the compiled pattern; kept by the worker."""
    if ranks_path not in _codings:
        import regex
        import tiktoken

        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _codings[ranks_path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public_tokenizers.PATTERN)
    return _codings[ranks_path]


def encode(text: str, ranks_path: str) -> list[int]:
    return coding(ranks_path)[0].encode_ordinary(text)


def decode(ids: list[int], ranks_path: str) -> bytes:
    """The bytes of the ids, one after another."""
    return coding(ranks_path)[0].decode_bytes(ids)


def _whole(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, plain = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py(), ranks_path)
                counts.append(len(ids))
                sums.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(decode(ids, ranks_path)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _cut(chunk: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "key", "piece", "text"]
        for frame in frames:
            rows = []
            for doc_id, key, text in frame.itertuples(index=False):
                for i, at in enumerate(range(0, len(text), chunk)):
                    rows.append((doc_id, key, i, text[at : at + chunk + overlap]))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    return run


def _pretokenise(ranks_path: str, chunk: int, overlap: int):
    """Boundaries in the chunk's first `overlap` code points and in those that it shares with the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = coding(ranks_path)[1].finditer
        for frame in frames:
            found = [[m.start() for m in find(text)] for text in frame["text"]]
            yield frame.assign(starts=[[s for s in x if s < overlap] for x in found], tail=[[s - chunk for s in x if s >= chunk] for x in found])

    return run


def _encode_runs(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(encode(text.as_py(), ranks_path), "<u4").tobytes() for text in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(ids, pa.binary())], names=["doc_id", "key", "copies", "run", "ids"])

    return run


def _together(ranks_path: str):
    """The pieces of one document in order: ids one after another, decoded bytes concatenated."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, plain, n = hashlib.sha256(), hashlib.sha256(), 0
        for data in group.sort_values("run")["ids"]:
            piece = np.frombuffer(data, "<u4").tolist()
            ids.update((" " * (n > 0) + " ".join(map(str, piece))).encode())
            plain.update(decode(piece, ranks_path))
            n += len(piece)
        copies = int(group["copies"].iloc[0])
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * copies, "n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": plain.hexdigest()}).astype({"doc_id": "Int64"})

    return run


def stitched_runs(long_texts: DataFrame, ranks_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, key, copies, run, text): the pieces between agreed boundaries of (doc_id, key, text).

    Chunks are dealt out by the aggregate that counts rows equal in doc_id and text.
    """
    plain = "doc_id long, key string, piece int, text string"
    chunks = long_texts.mapInPandas(released(_cut(chunk, overlap)), plain).groupBy("doc_id", "key", "piece").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    cut = chunks.select("doc_id", "key", "copies", "piece", "text").mapInPandas(released(_pretokenise(ranks_path, chunk, overlap)), _PIECE)
    order = Window.partitionBy("doc_id", "key").orderBy("piece")
    # where this chunk starts and ends, from its own start; null: no boundary that both sides found
    begin = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("starts", F.lag("tail").over(order))))
    cut = cut.withColumn("begin", begin)
    cut = cut.withColumn("end", F.lead("begin").over(order)).withColumn("last", F.lead("piece").over(order).isNull())
    cut = cut.withColumn("run", F.sum(F.col("begin").isNotNull().cast("int")).over(order).cast("int"))
    upto = F.when(F.col("last"), F.length("text")).otherwise(F.lit(chunk) + F.coalesce("end", F.lit(0)))
    start = F.coalesce("begin", F.lit(0))
    part = F.col("text").substr(start + 1, upto - start)
    parts = F.sort_array(F.collect_list(F.struct("piece", part.alias("text"))))
    return cut.groupBy("doc_id", "key", "copies", "run").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def round_trip(documents: DataFrame, ranks_path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode documents(doc_id, text), decode the ids again, return counts and digests of both."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(released(_whole(ranks_path)), _RESULT)
    long_texts = rows.where(F.length("text") > chunk).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    runs = stitched_runs(long_texts, ranks_path, chunk, overlap)
    ids = runs.repartition("key", "run").mapInArrow(released(_encode_runs(ranks_path)), _IDS)
    return short.unionByName(ids.groupBy("doc_id", "key").applyInPandas(_together(ranks_path), _RESULT))
