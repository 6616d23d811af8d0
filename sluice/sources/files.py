"""Reading sources: formats by majority, globs, JSON lines, Arrow files, tensor headers, manifests."""

from __future__ import annotations

import fnmatch
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File endings and the reader they need.
ENDINGS = {".parquet": "parquet", ".jsonl.gz": "json", ".json.gz": "json", ".jsonl": "json", ".json": "json", ".csv": "csv", ".arrow": "arrow"}


def format_of(path: str) -> str | None:
    return next((f for e, f in ENDINGS.items() if path.endswith(e)), None)


def majority_format(paths: Iterable[str]) -> str:
    """The format of most paths, the first seen of equals; parquet if there are none."""
    found = Counter(f for p in paths if (f := format_of(p)))
    return found.most_common(1)[0][0] if found else "parquet"


def matching(paths: Iterable[str], patterns: Sequence[str]) -> list[str]:
    """Paths of which the whole or the last part matches a pattern; all if there are no patterns."""
    return [p for p in paths if not patterns or any(fnmatch.fnmatch(p, x) or fnmatch.fnmatch(p.rsplit("/", 1)[-1], x) for x in patterns)]


def matches_pattern(path: Column, pattern: str) -> Column:
    """The same as a column expression, for manifests."""
    regex = fnmatch.translate(pattern).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")
    return path.rlike("^" + regex) | F.regexp_extract(path, r"([^/]*)$", 1).rlike("^" + regex)


def read_arrow(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Arrow stream or file format, one task a file; columns are taken by the schema's names."""
    from pyspark.sql.types import StructType

    names = (StructType.fromDDL(schema)).names

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                with system.open_input_file(place) as f:
                    try:
                        reader = pa.ipc.open_file(f)
                        parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                    except pa.ArrowInvalid:
                        f.seek(0)
                        parts = pa.ipc.open_stream(f)
                    for part in parts:
                        yield part.select(names)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(read, schema)


def read_files(spark: SparkSession, paths: Sequence[str], patterns: Sequence[str] = (), schema: str | None = None) -> DataFrame:
    """The files that match, by the reader of most of them; damaged files yield the rows before the damage."""
    chosen = matching(paths, patterns)
    if not chosen:
        raise FileNotFoundError(f"no file matches {list(patterns)}")
    kind = majority_format(chosen)
    chosen = [p for p in chosen if format_of(p) == kind]
    if kind == "arrow":
        if schema is None:
            raise ValueError("Arrow files need a schema")
        return read_arrow(spark, chosen, schema)
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if schema:
        reader = reader.schema(schema)
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(list(chosen))


def read_samples(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """JSON lines, blank lines skipped; with `most`, the first rows by the files' names and places in them."""
    rows = spark.read.schema(schema).json(path)
    if most is None:
        return rows
    order = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}
    return rows.select("*", *(c.alias(n) for n, c in order.items())).orderBy(*order).limit(most).drop(*order)


def resolve(local: Sequence[str], listing: Callable[[], Iterable[str]] | None, load: Callable[[], DataFrame] | None, read: Callable[[Sequence[str]], DataFrame], patterns: Sequence[str] = ()) -> DataFrame:
    """A source by preference: files that are here, else those of a listing, else whatever `load` gives.

    A listing is asked only if no local file matches, `load` only if there is no listing.
    """
    here = [p for p in matching(local, patterns) if format_of(p)]
    if here:
        return read(here)
    if listing is not None:
        found = [p for p in matching(list(listing()), patterns) if format_of(p)]
        if not found:
            raise FileNotFoundError(f"the listing has no file for {list(patterns)}")
        return read(found)
    if load is None:
        raise FileNotFoundError("no local file, no listing and no loader")
    return load()


def paged_listing(page: Callable[[str | None], tuple[list[dict], str | None]], tries: int = 5, wait: Callable[[int], None] = lambda n: None) -> Iterator[dict]:
    """The entries of all pages; `page(cursor)` gives entries and the next cursor, and is asked again when it fails with OSError."""
    cursor = None
    while True:
        for n in range(tries):
            try:
                entries, cursor = page(cursor)
                break
            except OSError:
                if n + 1 == tries:
                    raise
                wait(n)
        yield from entries
        if cursor is None:
            return


def is_data_file(path: Column) -> Column:
    """Whether a path has the ending of a data file."""
    out = F.lit(False)
    for ending in ENDINGS:
        out = out | F.lower(path).endswith(ending)
    return out


def weight_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, shard) of a shard index in JSON."""
    rows = spark.read.schema("weight_map map<string,string>").json(path, multiLine=True)
    return rows.select(F.explode("weight_map").alias("key", "shard"))


def expert_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(layer, old_id, new_id) of a mapping file: for each `layer_<n>` the surviving ids, in their new order."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<surviving_original_ids:array<int>>>")).alias("name", "x"))
    rows = raw.where(F.col("name").startswith("layer_")).select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("layer"), F.posexplode("x.surviving_original_ids").alias("new_id", "old_id"))
    return rows.select("layer", "old_id", "new_id")


def sidecars(paths: Iterable[str], names: Iterable[str]) -> list[str]:
    """The paths whose last part is one of `names`: what is copied beside rewritten weights."""
    wanted = set(names)
    return [p for p in paths if p.rsplit("/", 1)[-1] in wanted]


def tensor_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(key, shard, shape, dtype) from the JSON headers of tensor shards; no tensor is read."""

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
                with system.open_input_file(place) as f:
                    head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
                rows += [(k, path, x["shape"], x["dtype"]) for k, x in head.items() if k != "__metadata__"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()))], names=["key", "shard", "shape", "dtype"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(read, "key string, shard string, shape array<long>, dtype string")


def router_stats(spark: SparkSession, path: str) -> DataFrame:
    """(layer, expert, cnt) of a JSON file of usage counts by layer and expert."""
    layers = spark.read.schema("layers map<string,struct<usage_counts:map<string,bigint>>>").json(path, multiLine=True)
    rows = layers.select(F.explode("layers").alias("layer", "x")).select(F.col("layer").cast("int").alias("layer"), F.explode("x.usage_counts").alias("expert", "cnt"))
    return rows.select("layer", F.col("expert").cast("int").alias("expert"), "cnt")


def known_size(lfs: Column, plain: Column) -> Column:
    """The large-file size if set, else the plain one, else -1."""
    return F.coalesce(F.nullif(lfs, F.lit(0)), F.nullif(plain, F.lit(0)), F.lit(-1))


def format_votes(manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, format): the majority format of each group of paths, ties to the first in the alphabet."""
    kind = F.lit(None).cast("string")
    for ending, name in reversed(ENDINGS.items()):
        kind = F.when(F.col("path").endswith(ending), name).otherwise(kind)
    counts = manifest.withColumn("format", kind).groupBy(*keys, "format").agg(F.count("format").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "format")).alias("b"))
    return best.select(*keys, F.coalesce("b.format", F.lit("parquet")).alias("format"))


def reconciled(remote: DataFrame, local: DataFrame, key: str = "path") -> DataFrame:
    """(key, size, local_size, status): ok, missing, short, or unknown where the remote size is -1."""
    rows = remote.select(key, "size").join(local.select(key, F.col("size").alias("local_size")), key, "left")
    status = F.when(F.col("local_size").isNull(), "missing").when(F.col("size") < 0, "unknown").when(F.col("local_size") < F.col("size"), "short").otherwise("ok")
    return rows.withColumn("status", status)


def profile(manifest: DataFrame, examples: int = 3) -> DataFrame:
    """(directory, files, bytes, examples): counts and the first names of each directory.

    Spark cuts the numbering at `examples` before it shuffles, so a large directory sends a few rows a task.
    """
    rows = manifest.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", ""))
    first = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    named = rows.select("directory", "path").withColumn("r", F.row_number().over(Window.partitionBy("directory").orderBy("path"))).where(F.col("r") <= examples)
    return first.join(named.groupBy("directory").agg(F.sort_array(F.collect_list("path")).alias("examples")), "directory")


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    """(kind, value): the distinct values of several columns, such as sample ids, layers and shards."""
    parts = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(F.explode(parts).alias("x")).select("x.*").where("value is not null").distinct()


def index_ids(df: DataFrame, json_column: str) -> DataFrame:
    """(id): every string under a key `id` or `sample_id`, or key of `samples`, anywhere in JSON texts."""

    def walk(value):
        if isinstance(value, dict):
            for k, v in value.items():
                if k in ("id", "sample_id") and isinstance(v, str):
                    yield v
                elif k == "samples" and isinstance(v, dict):
                    yield from v
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    def read(batches):
        for batch in batches:
            found = {x for text in batch.column(0).to_pylist() if text for x in walk(json.loads(text))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["id"])

    return df.select(json_column).mapInArrow(read, "id string").distinct()
