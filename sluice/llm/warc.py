"""Deterministic sharded web archives.

Pages are sorted by page_id into shards whose bounds follow from the running payload size alone, so
the archive files depend on the rows and the parameters, not on the cluster. A task writes its shards
as gzip members, rolls a file once its compressed size passes `roll_bytes`, and commits each file by
renaming it; the driver writes the manifest last, and only files of a manifest are ever read.

Defined cases: a null html is an empty payload, a null url an empty target; rows without a page_id come
last and are archived like others; of repeated rows the first is the response; a very long payload is one
record, compressed in one piece; an empty table gives a manifest without files; further columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._shared import Commit, bound_batches, file_system, materialise, new_folder, released, shard_bounds, shard_of

#: Payload bytes per shard and compressed bytes per file.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100
WARC_DATE = "2000-01-01T00:00:00Z"

_MANIFEST = "shard int, part int, file string, bytes long, records long, sha256 string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: tuple[int | None] | None) -> bytes:
    """One archive record, compressed as a gzip member of its own; refers_to makes it a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("revisit" if refers_to else "response"),
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {WARC_DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to[0])}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commit, out, rows = Commit(folder), None, []
        shard = part = size = records = None
        sums = temporary = marker = written = None

        def close():
            out.close()
            name = commit.done(temporary, f"shard-{shard:06d}-{part:05d}.warc.gz")
            rows.append((shard, part, name, size, records, sums.hexdigest()))

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                row_shard, page_id, digest, kind, url, payload, target = (x.as_py() for x in row)
                if kind == 0:  # a marker: the rows of this page and digest revisit `target`
                    marker = (page_id, digest, target)
                    continue
                if row_shard != shard:
                    if out:
                        close()
                    shard, part, out, written = row_shard, -1, None, None
                if out and size >= roll_bytes:
                    close()
                    out = None
                if not out:
                    part, size, records, sums = part + 1, 0, 0, hashlib.sha256()
                    temporary, out = commit.open(f"shard-{shard:06d}-{part:05d}.warc.gz")
                refers = None
                if marker and marker[:2] == (page_id, digest):
                    refers = (marker[2],)
                elif written == (page_id, digest) and len(payload) >= LEAST_REVISIT:
                    refers = (page_id,)
                data = record_bytes(page_id, url, payload, digest, refers)
                out.write(data)
                sums.update(data)
                size, records, written = size + len(data), records + 1, (page_id, digest)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "part", "file", "bytes", "records", "sha256"])

    return write


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Archive every row of pages(page_id, url, html) under `folder`; returns the manifest's files.

    Pages are read twice: once for (page_id, digest, length), which decides shards and revisits, once
    for the payloads, which are shuffled only once. Revisit marks travel as rows of their own, sorted
    just before the row they concern, so the payload side needs no join.
    """
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    full = full.withColumn("digest", F.sha2("payload", 256))
    slim = materialise(full.select("page_id", "digest", F.length("payload").cast("long").alias("bytes")), "warc-slim")
    bounds = shard_bounds(slim.withColumn("weight", F.col("bytes") + F.lit(512)), "page_id", "weight", shard_bytes, "warc-order")

    long_enough = slim.where(F.col("bytes") >= LEAST_REVISIT)
    first = long_enough.groupBy("digest").agg(F.min("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = long_enough.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("target"))).select("page_id", "digest", "target").distinct()
    both = full.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("target")).unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "target")
    )
    ordered = (
        both.withColumn("shard", shard_of(F.col("page_id"), bounds))
        .repartitionById(max(1, len(bounds)), F.col("shard"))
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")
        .select("shard", "page_id", "digest", "kind", "url", "payload", "target")
    )
    files = sorted((r.asDict() for r in ordered.mapInArrow(released(_writer(folder, roll_bytes)), _MANIFEST).collect()), key=lambda r: (r["shard"], r["part"]))
    Commit(folder).text("manifest.json", json.dumps({"format": "WARC/1.1", "files": files}))
    return files


def records(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an open archive file; damage raises ValueError."""
    left = b""
    while True:
        unzip, plain = zlib.decompressobj(31), []
        while not unzip.eof:
            left = left or data.read(1 << 20)
            if not left:
                if plain:
                    raise ValueError("an archive record ends early")
                return
            plain.append(unzip.decompress(left))
            left = unzip.unused_data if unzip.eof else b""
        head, _, rest = b"".join(plain).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if _digest(block) != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def table(rows):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, place = file_system(path)
            rows = []
            with fs.open_input_stream(place, compression=None) as data:
                for head, block in records(data):
                    kind, digest, length = head["WARC-Type"], head["WARC-Payload-Digest"], int(head["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if _digest(payload) != digest or len(payload) != length:
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], length, digest.removeprefix("sha256:"), kind, _page(head["WARC-Refers-To"]) if kind == "revisit" else None))
                    if len(rows) >= 4096:
                        yield table(rows)
                        rows = []
            yield table(rows)


def read_archives(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """The records of a manifest's files, one task for a few files; digests are checked on the way."""
    paths = spark.createDataFrame([(f"{folder}/{f['file']}",) for f in files], "path string").repartition(max(1, len(files)))
    return paths.mapInArrow(released(_read), _RECORDS)


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write `pages` as archives in the shared folder and read them back."""
    folder = new_folder(spark, "warc")
    return read_archives(spark, folder, write_archives(pages, folder))
