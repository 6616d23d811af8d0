"""Building a corpus: length caps, buckets, duplicates, token quotas, order, ids, reports."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import bucket_of, shuffle_key


#: The folders of intermediate tables that are still there.
_folders: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again, which ends their lineage.

    Results read such tables lazily, so they go when the program ends, or with drop_written.
    """
    path = f"{shared_folder(df.sparkSession)}/sluice-{uuid.uuid4().hex}"
    _folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete every intermediate table of this program; results that are not written elsewhere go with them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if _folders else None
    if spark is not None and getattr(spark.sparkContext, "_jsc", None) is not None:
        drop_written(spark)


atexit.register(_at_exit)


def length_capped(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Rows with at least one and at most `most` tokens."""
    return df.where((F.col(tokens) > 0) & (F.col(tokens) <= most))


def content_key(text: Column, chars: int = 256) -> Column:
    """The duplicate key: SHA-1 of the first `chars` code points."""
    return F.sha1(F.substring(text, 1, chars).cast("binary"))


def message_text(messages: Column) -> Column:
    """The first text that isn't the system's, else the first text: what the key of a chat is made of."""
    others = F.filter(messages, lambda m: m["role"] != "system")
    return F.coalesce(F.try_element_at(others, F.lit(1))["content"], F.try_element_at(messages, F.lit(1))["content"], F.lit(""))


def image_content_key(text: Column, first_image: Column, chars: int = 256) -> Column:
    """As content_key, with the first image's digest, so that templated prompts don't collapse."""
    prefix = F.substring(text, 1, chars)
    return F.sha1(F.when(first_image.isNull(), prefix).otherwise(F.concat(prefix, F.lit("|img:"), first_image)).cast("binary"))


def first_of_each(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key, by a combining aggregate: a frequent key needs no task of its own."""
    columns = [c for c in df.columns if c not in order]
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, *(F.col(c) for c in columns))).alias("_first"))
    return first.select(*(F.col(f"_first.{c}").alias(c) for c in df.columns))


def ordered_offsets(df: DataFrame, order: Sequence[Column], weight: Column) -> DataFrame:
    """Add `before`: the exclusive running sum of `weight` over all rows in `order`.

    Ranges of rows are summed apart; one row per range carries the offsets, so no task holds all rows.
    """
    ranged = written(df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.sum("_w").alias("_s"))
    skips = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_skip"))
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_in", inside).join(F.broadcast(skips), "_p").withColumn("before", (F.col("_in") + F.col("_skip")).cast("long")).drop("_p", "_w", "_in", "_skip")


def _with_offsets(ranged: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `before` to rows that carry their range `_p` and weight `_w`; one row per range and group carries the sums on."""
    sums = ranged.groupBy("_p", *group).agg(F.sum("_w").alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    skips = sums.select("_p", *group, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_skip"))
    names = [f"_g{i}" for i in range(len(group))]
    skips = skips.select(F.col("_p").alias("_q"), *(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), "_skip")
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_p") == F.col("_q")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return ranged.withColumn("_in", inside).join(skips, same).withColumn("before", (F.col("_in") + F.col("_skip")).cast("long")).drop("_in", "_skip", "_q", *names)


def group_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column) -> DataFrame:
    """Add `before`: the exclusive running sum of `weight` within each group, in `order`.

    Rows are dealt out by ranges of (group, order), so that a group of any size spreads over tasks.
    """
    ranged = written(df.withColumn("_w", weight).repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()))
    return _with_offsets(ranged, group, order).drop("_p", "_w")


def quota_cut(df: DataFrame, group: str, order: str, tokens: str, quota: int) -> DataFrame:
    """Rows of each group up to the one that reaches the quota; it may overshoot."""
    return group_offsets(df, [group], [order], F.col(tokens)).where(F.col("before") < quota).drop("before")


def running_buckets(df: DataFrame, group: str, order: str, tokens: str, edges: Sequence[int]) -> DataFrame:
    """Add `bucket` and `bucket_before`: what a group's earlier rows have put into the row's bucket."""
    rows = df.withColumn("bucket", bucket_of(F.col(tokens), edges)).where("bucket is not null")
    return group_offsets(rows, [group, "bucket"], [order], F.col(tokens)).withColumnRenamed("before", "bucket_before")


def provisional_ids(df: DataFrame, group: str, order: str) -> DataFrame:
    """Add `id`: `<group>_<place>`, the place counted from 0 within the group."""
    return group_offsets(df, [group], [order], F.lit(1)).withColumn("id", F.concat_ws("_", F.col(group), F.col("before"))).drop("before")


def harvest(df: DataFrame, sources: Sequence[tuple[str, int]], order: str, tokens: str, key: str, usable: Column | None = None) -> DataFrame:
    """Rows that a sequential build would accept, source after source, as (source order, columns).

    A key blocks later rows only if its row was reached before its source's quota was met. All sources are
    taken at once: each key's first row of each source is placed once, in ranges of (source, order); then every
    source is cut at its quota, keys that a source reached block the sources after it, and sources are cut
    again, until nothing changes. After k rounds the first k sources are final, and a round changes only what
    sources share, so few rounds do unless keys chain through many of them. Rows that are not `usable` (a
    broken image) block their key but add neither a row nor tokens.
    """
    spark = df.sparkSession
    named = spark.createDataFrame([(s, i, q) for i, (s, q) in enumerate(sources)], "source string, source_ord int, _quota long")
    rows = df.join(F.broadcast(named), "source")  # one row per source of the configuration
    first = first_of_each(rows.select(*df.columns, "source_ord", "_quota", F.struct("source_ord", key).alias("_of")), "_of", [order]).drop("_of")
    weight = F.when(usable, F.col(tokens)).otherwise(0) if usable is not None else F.col(tokens)
    of_key = F.count(F.lit(1)).over(Window.partitionBy(key))  # at most one row a source
    placed = first.withColumn("_shared", of_key > 1).withColumn("_w", weight).repartitionByRange("source_ord", order)
    placed = written(placed.withColumn("_p", F.spark_partition_id()))
    slim = placed.select("_p", "_w", "_quota", "_shared", "source_ord", order, key)
    blocked, last = None, None
    for _ in range(len(sources) + 1):
        live = slim if blocked is None else slim.join(blocked, ["source_ord", key], "left_anti")
        taken = _with_offsets(live, ["source_ord"], [order]).where(F.col("before") < F.col("_quota"))
        reached = taken.where("_shared").groupBy(key).agg(F.min("source_ord").alias("_by"))
        found = written(slim.where("_shared").join(reached, key).where("source_ord > _by").select("source_ord", key))
        sign = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("source_ord", key).cast("decimal(38,0)"))).first()
        if sign == last:
            break
        blocked, last = found, sign
        if not sign[0]:
            break
    kept = placed.join(blocked, ["source_ord", key], "left_anti") if last[0] else placed
    out = _with_offsets(kept, ["source_ord"], [order]).where(F.col("before") < F.col("_quota"))
    out = out.where(usable) if usable is not None else out
    return out.select(*df.columns, "source_ord")


def gave_up(df: DataFrame, group: str, order: str, accepted: Column, quota: int) -> DataFrame:
    """Groups that are dropped because none of their first max(2000, quota // 50) rows is accepted."""
    cap = max(2000, quota // 50)
    first = df.groupBy(group).agg(F.min(F.when(accepted, F.col(order))).alias("first_accepted"))
    return first.withColumn("gave_up", F.coalesce(F.col("first_accepted") > cap, F.lit(True)))


def balanced(df: DataFrame, group: str, order: str, tokens: str, quota: int, edges: Sequence[int]) -> DataFrame:
    """The sequential bucket balance of each group: a fold whose state is one total a bucket.

    A row is skipped while its bucket holds more than 1.5 times its share of the quota, unless all buckets
    do, or one holds 10,000 tokens and another none. Inactive for quotas under last edge * buckets. The
    fold is sequential by definition, so a group is one task; it streams sorted (order, tokens) and holds one
    batch and the totals, however long the group. Rows without tokens are never kept; rows without an order
    come last, and rows of equal order by their tokens.
    """
    n = len(edges) - 1
    cap, active = quota / n * 1.5, quota >= edges[-1] * n

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, totals, used = None, [], 0
        for batch in batches:
            keep = []
            for g, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (g,) != of:
                    of, totals, used = (g,), [0] * n, 0
                size = int(size or 0)
                place = next((i for i in range(n) if size <= edges[i + 1]), None)
                full = used >= quota or size <= 0 or place is None
                if not full and active and totals[place] > cap and not (min(totals) == 0 and max(totals) >= 10_000):
                    full = not all(t > cap for t in totals)
                keep.append(not full)
                if not full:
                    totals[place] += size
                    used += size
            yield batch.filter(pa.array(keep, pa.bool_()))

    slim = df.select(group, order, tokens)
    return slim.repartition(group).sortWithinPartitions(group, F.col(order).asc_nulls_last(), tokens).mapInArrow(fold, slim.schema)


def bucket_profile(df: DataFrame, tokens: str, edges: Sequence[int]) -> DataFrame:
    """Rows and tokens of each length bucket."""
    rows = df.withColumn("bucket", bucket_of(F.col(tokens), edges)).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"), F.sum(tokens).alias("tokens"))


def source_report(df: DataFrame, tokens: str) -> DataFrame:
    """Rows and tokens of each source, and of all as source `TOTAL`."""
    rolled = df.rollup("source").agg(F.count(F.lit(1)).alias("samples"), F.sum(tokens).alias("tokens"), F.grouping("source").alias("_all"))
    return rolled.where("samples > 0").withColumn("source", F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("source"))).drop("_all")


def shuffled_ids(df: DataFrame, seed: int, prefix: str, *key: str) -> DataFrame:
    """Ids `<prefix>_<six digits>` in the order of a seeded shuffle."""
    rows = df.withColumn("_k", shuffle_key(seed, *(F.col(c) for c in key)))
    numbered = ordered_offsets(rows, [F.col("_k"), *(F.col(c) for c in key)], F.lit(1))
    return numbered.withColumn("id", F.format_string(prefix + "_%06d", F.col("before"))).drop("_k", "before")
