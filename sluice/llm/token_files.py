"""Token ids in Arrow stream files of equal-length sequences.

A shard is one stream of record batches with two fixed-size-list columns, `tokens` and `mask` (one bit
a token: set where one stands, clear on the padding after a shard's last token), and a second stream that
says where each document starts. Mapped into memory, sequence i is a view into batch
i // rows_per_batch, and so are the bits of its mask: nothing is copied. Documents follow one another in ascending doc_id order across shards.

Defined cases: a null text is an empty text and yields the end id alone; rows without a doc_id come
last; repeated rows are written each time, in the order of their texts; an empty table gives no files;
further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._shared import Commit, bound_batches, file_system, materialise, new_folder, released, shard_bounds, shard_of

SEQUENCE, ROWS_PER_BATCH, SHARD_CHARS, END_ID = 2048, 64, 16 << 20, 0  # a sequence is a multiple of 8
#: Bounds of the memos of an executor's Python worker: pieces behind a space, other pieces, pre-tokens of either.
MOST_SPACED, MOST_PIECES, MOST_PRETOKENS = 500_000, 150_000, 200_000

_MANIFEST = "shard int, file string, docs_file string, tokens long, sequences long, documents long"
_RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


class MemoEncoder:
    """Byte-level BPE of the tokenizers library, with memos for pieces and pre-tokens.

    A piece starts at a space. Where that space doesn't stand inside a run of white space, no pre-token
    of the pattern crosses its start and the pattern looks back at nothing, so pieces can be encoded
    one by one, and the pieces of most texts are kept without their space; each pre-token in turn goes
    through the library's own model.
    """

    def __init__(self, path: str, dtype: str):
        import regex
        from tokenizers import Tokenizer

        import public_tokenizers

        self.whole, self.dtype = Tokenizer.from_file(path), dtype
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        model = self.whole.model
        find = regex.compile(public_tokenizers.PATTERN).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves in byte-level vocabularies
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        table = str.maketrans({chr(b): c for b, c in letters.items()})

        last = max(self.whole.get_vocab().values())
        if last > np.iinfo(dtype).max:
            raise ValueError(f"{dtype} doesn't hold the id {last}")
        width, data = np.dtype(dtype).itemsize, np.arange(last + 1).astype(dtype).tobytes()
        as_bytes = [data[i : i + width] for i in range(0, len(data), width)]

        def ids_of(word: str) -> bytes:
            shown = word.encode().decode("latin1").translate(table)
            return b"".join([as_bytes[t.id] for t in model.tokenize(shown)])

        class Pretokens(dict):
            def __missing__(self, word):
                ids = ids_of(word)
                if len(self) < MOST_PRETOKENS and len(word) < 64:
                    self[word] = ids
                return ids

        class Pieces(dict):
            def __init__(self, lead: str, most: int):
                self.lead, self.most = lead, most

            def __missing__(self, piece):
                word = _WORD.fullmatch(piece)
                if not word:
                    ids = b"".join(map(pretokens.__getitem__, find(self.lead + piece)))
                elif word[2]:
                    ids = self[word[1]] + pretokens[word[2]]
                else:
                    ids = ids_of(self.lead + piece)
                if len(self) < self.most and len(piece) < 64:
                    self[piece] = ids
                return ids

        pretokens, self.pieces, self.spaced = Pretokens(), Pieces("", MOST_PIECES), Pieces(" ", MOST_SPACED)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of the encoder's type."""
        if any(t in text for t in self.added):  # the library takes these out before it cuts pre-tokens
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if _RUN.search(text):  # runs of white space stay whole
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.spaced.__getitem__, rest))


#: A space inside a run of white space, and pieces that begin with a whole run.
_RUN, _PIECES = re.compile(r"\s (?=\s|\Z)"), re.compile(r"\s*\S+|\s+")
#: Latin letters with marks after them: a pre-token, and another if there are marks, for which the pattern isn't needed.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
_encoders: dict[tuple[str, str], MemoEncoder] = {}


def encoder(path: str, dtype: str) -> MemoEncoder:
    """A worker keeps its encoder, and so its memos, from task to task."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = MemoEncoder(path, dtype)
    return _encoders[path, dtype]


class ShardWriter:
    """Writes one shard: a stream of sequences and a stream of document places."""

    def __init__(self, commit: Commit, shard: int, dtype: str, sequence: int, rows: int):
        self.commit, self.shard, self.dtype, self.length, self.rows = commit, shard, np.dtype(dtype), sequence, rows
        self.names = f"shard-{shard:06d}.tokens.arrow", f"shard-{shard:06d}.docs.arrow"
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))], {"sequence": str(sequence), "rows_per_batch": str(rows)})
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        (self.temporary, self.out), (self.docs_temporary, self.docs_out) = commit.open(self.names[0]), commit.open(self.names[1])
        self.stream, self.docs_stream = pa.ipc.new_stream(self.out, self.schema), pa.ipc.new_stream(self.docs_out, self.docs_schema)
        self.waiting, self.docs, self.tokens, self.sequences, self.documents = bytearray(), [], 0, 0, 0

    def _batch(self, data: bytes, n_valid: int) -> None:
        tokens = np.frombuffer(data, self.dtype)
        mask = pa.array(np.arange(len(tokens)) < n_valid)
        arrays = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(tokens), mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.sequences += len(tokens) // self.length

    def _flush_docs(self) -> None:
        if self.docs:
            self.docs_stream.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)], schema=self.docs_schema))
            self.docs = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.tokens, n))
        self.tokens, self.documents = self.tokens + n, self.documents + 1
        self.waiting += ids
        step = self.length * self.rows * self.dtype.itemsize
        while len(self.waiting) >= step:
            self._batch(bytes(self.waiting[:step]), self.length * self.rows)
            del self.waiting[:step]
        if len(self.docs) >= 8192:
            self._flush_docs()

    def close(self) -> tuple:
        if self.waiting:
            width = self.length * self.dtype.itemsize
            n = len(self.waiting) // self.dtype.itemsize
            self._batch(bytes(self.waiting) + bytes(-len(self.waiting) % width), n)
        self._flush_docs()
        for x in (self.stream, self.docs_stream, self.out, self.docs_out):
            x.close()
        self.commit.done(self.temporary, self.names[0])
        self.commit.done(self.docs_temporary, self.names[1])
        return self.shard, *self.names, self.tokens, self.sequences, self.documents


def _writer(folder: str, tokenizer: str, end_id: int, dtype: str, sequence: int, rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commit, encode, end, out, done = Commit(folder), encoder(tokenizer, dtype).encode, np.array([end_id], dtype).tobytes(), None, []
        for batch in batches:
            shards, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(batch.column(2)):
                if out is None or out.shard != shards[i]:
                    if out:
                        done.append(out.close())
                    out = ShardWriter(commit, shards[i], dtype, sequence, rows)
                out.add(ids[i], encode(text.as_py()) + end)
        if out:
            done.append(out.close())
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=["shard", "file", "docs_file", "tokens", "sequences", "documents"])

    return write


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, dtype: str = "<u2", sequence: int = SEQUENCE, rows_per_batch: int = ROWS_PER_BATCH, shard_chars: int = SHARD_CHARS) -> list[dict]:
    """Encode documents(doc_id, text), append `end_id` to each, write the shards; returns the manifest.

    Shard bounds follow from text lengths in doc_id order. Texts are shuffled once, sorted inside each
    task, and encoded while they are written. dtype must hold every id of the vocabulary.
    """
    bound_batches(documents.sparkSession)
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slim = materialise(text.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("weight")), "token-slim")
    bounds = shard_bounds(slim, "doc_id", "weight", shard_chars, "token-order")
    ordered = text.withColumn("shard", shard_of(F.col("doc_id"), bounds)).repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "text").select("shard", "doc_id", "text")
    shards = sorted((r.asDict() for r in ordered.mapInArrow(released(_writer(folder, tokenizer, end_id, dtype, sequence, rows_per_batch)), _MANIFEST).collect()), key=lambda r: r["shard"])
    before = 0
    for s in shards:
        s["start"], before = before, before + s["tokens"]
    Commit(folder).text("manifest.json", json.dumps({"dtype": dtype, "sequence": sequence, "rows_per_batch": rows_per_batch, "end_id": end_id, "shards": shards}))
    return shards


class TokenShard:
    """A shard open for reading; a local file is mapped into memory and its sequences are views.

    Of a file elsewhere the batches are read once `sequence` is first asked for, unless it was iterated before.
    """

    def __init__(self, path: str):
        fs, place = file_system(path)
        self.source = pa.memory_map(place) if fs.type_name == "local" else fs.open_input_file(place)
        self.batches = list(pa.ipc.open_stream(self.source)) if fs.type_name == "local" else None
        self._stream = None if self.batches is not None else pa.ipc.open_stream(self.source)

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        """The tokens of each batch, flat, and how many of them the mask holds."""
        for batch in self.batches if self.batches is not None else self._stream:
            tokens, mask = (batch.column(i).flatten() for i in (0, 1))
            yield tokens.to_numpy(zero_copy_only=True), mask.true_count

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of sequence i and the bytes that hold its mask's bits (lowest first), without copying."""
        if self.batches is None:  # not mapped: read as far as the sequences go
            self.batches = list(self._stream)
        rows = self.batches[0].num_rows
        batch = self.batches[i // rows]
        length = batch.column(0).type.list_size
        at = (i % rows) * length
        bits = batch.column(1).flatten()
        mask = np.frombuffer(bits.buffers()[1], np.uint8)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + length], mask[(bits.offset + at) // 8 : (bits.offset + at + length + 7) // 8]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, place = file_system(row["docs_path"])
            parts, have, out = iter(TokenShard(row["path"])), np.empty(0, np.uint16), []
            with fs.open_input_file(place) as docs:
                for places in pa.ipc.open_stream(docs):
                    for doc_id, first, n in zip(*(places.column(i).to_pylist() for i in range(3)), strict=True):
                        crc, need = 0, n
                        while need:
                            if not len(have):
                                tokens, there = next(parts)
                                have = tokens[:there]
                            take = have[:need]
                            crc, need, have = zlib.crc32(take.astype("<u4").tobytes(), crc), need - len(take), have[len(take) :]
                        out.append((doc_id, row["start"] + first, n, crc, row["shard"]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """One row per document of the manifest's shards, from the files alone."""
    rows = [(f"{folder}/{s['file']}", f"{folder}/{s['docs_file']}", s["start"], s["shard"]) for s in shards]
    return spark.createDataFrame(rows, "path string, docs_path string, start long, shard int").repartition(max(1, len(rows))).mapInArrow(released(_read), _RESULT)


def token_round_trip(spark: SparkSession, documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files of `documents` in the shared folder and read them back."""
    folder = new_folder(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(documents, folder, tokenizer))
