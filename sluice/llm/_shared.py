"""What the operators of this subpackage share: scratch tables, global order, files."""

from __future__ import annotations

import atexit
import bisect
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The delimiters between words of the word-based contracts, as a byte or code-point class.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

#: The scratch folders that are still there, in the order they were made.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a temporary folder; any other master is an error, because
    a folder of one machine cannot hold tables that other machines read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def bound_batches(spark: SparkSession) -> None:
    """Send at most BATCH_ROWS rows, and about BATCH_BYTES, to a Python worker at once.

    Spark's default of 10,000 rows is tens of megabytes of text, held several times over by the JVM and
    the worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow; after each partition the worker gives freed memory back to the system.

    Workers live on from task to task, and what their allocators keep counts against the executor.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return wrapped


def _delete(spark: SparkSession, folders: Sequence[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder of this program; results that are not written elsewhere go with them."""
    folders, _made[:] = list(_made), []
    _delete(spark, folders)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _made else None
    if spark is not None and getattr(spark.sparkContext, "_jsc", None) is not None:
        drop_scratch(spark)


atexit.register(_at_exit)


@contextmanager
def scratch(spark: SparkSession):
    """Delete on leaving the block what was made in it, except what is handed to the function it gives.

    Only for blocks whose result is written: what is read lazily later has to be kept. Whatever is left
    goes when the program ends, or with drop_scratch.
    """
    before, kept = set(_made), []

    def keep(written: DataFrame) -> DataFrame:
        kept.append(_made[-1])  # a table is kept as soon as it is written
        return written

    yield keep
    gone = [f for f in _made if f not in before and f not in kept]
    _made[:] = [f for f in _made if f not in gone]
    _delete(spark, gone)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the program ends."""
    _made.append(f"{shared_folder(spark)}/sluice-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to be no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_order(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Add `_before`: the sum of `weight` over all rows that come earlier in `order`.

    Rows are range-partitioned and written once with their partition's number. The offsets between
    partitions come from one row per partition, the rest from a window inside each partition, so no
    task sees more than its range.
    """
    ranged = df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    rows = materialise(ranged, name)
    per_part = rows.groupBy("_p").agg(F.sum("_w").alias("_sum"))
    parts = per_part.withColumn("_skip", F.sum("_sum").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_skip", F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "_p")  # one row per partition
        .withColumn("_before", (F.col("_skip") + F.col("_in")).cast("long"))
        .drop("_w", "_p", "_in", "_skip")
    )


def shard_bounds(slim: DataFrame, key: str, weight: str, per_shard: int, name: str) -> list[int]:
    """The smallest key of each shard, when rows in ascending order of `key` fill shards of `per_shard`.

    Depends on the rows alone, not on how they are partitioned. The list has one number per shard.
    """
    with scratch(slim.sparkSession):
        ordered = running_order(slim.where(F.col(key).isNotNull()).select(key, weight), [F.col(key)], F.col(weight), name)
        found = ordered.groupBy(F.floor(F.col("_before") / F.lit(per_shard)).alias("s")).agg(F.min(key).alias("k")).collect()
    return sorted({r["k"] for r in found})


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of the shard that holds `key`; rows without a key follow all others."""
    last = max(len(bounds) - 1, 0)

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series([last if pd.isna(k) else max(bisect.bisect_right(bounds, k) - 1, 0) for k in keys], dtype="int32")

    return find(key)


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class Commit:
    """Files written under a temporary name; `done` moves them to their own name.

    Names depend on the content's place alone, so an attempt that runs twice replaces its files with
    equal ones, and a lost attempt leaves only temporary names that no manifest lists.
    """

    def __init__(self, folder: str):
        self.fs, self.folder = file_system(folder)
        self.fs.create_dir(self.folder, recursive=True)

    def open(self, name: str):
        temporary = f"{self.folder}/.{name}.{uuid.uuid4().hex}.tmp"
        return temporary, self.fs.open_output_stream(temporary)

    def done(self, temporary: str, name: str) -> str:
        self.fs.move(temporary, f"{self.folder}/{name}")
        return name

    def text(self, name: str, text: str) -> None:
        temporary, out = self.open(name)
        with out:
            out.write(text.encode())
        self.done(temporary, name)
