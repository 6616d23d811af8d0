"""Writing corpora, reports, statistics and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines without the columns whose name starts with an underscore."""
    out = df.drop(*(c for c in df.columns if c.startswith("_")))
    (out.coalesce(files) if files else out).write.mode("overwrite").json(path)


def unique_images(df: DataFrame, image: str = "image") -> DataFrame:
    """(name, image): each distinct image once, named by the first 16 digits of its SHA-1."""
    return df.where(F.col(image).isNotNull()).select(F.concat(F.substring(F.sha1(image), 1, 16), F.lit(".jpg")).alias("name"), F.col(image).alias("image")).dropDuplicates(["name"])


def usage_json(usage: DataFrame, recommended: DataFrame) -> DataFrame:
    """(layer, json): counts by expert and the recommended experts."""
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("expert").cast("string"), "cnt"))))
    rows = usage.groupBy("layer").agg(counts.alias("usage_counts")).join(recommended.withColumnRenamed("experts", "recommended"), "layer", "left")
    return rows.select("layer", F.to_json(F.struct("usage_counts", "recommended")).alias("json"))


def append_log(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines; null metrics leave no key."""
    df.write.mode("append").json(path)


def write_report(parts: list[DataFrame], path: str) -> None:
    """Rows of all parts as one CSV table with the union of their columns, in the order first seen."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """Rows as one JSON file; meant for reports, whose rows are few."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def rewrite_shards(weights: DataFrame, path: str, per_shard: int) -> DataFrame:
    """Write weights(key, ..., bytes) in key order as renumbered shards of about `per_shard` bytes; returns (key, shard).

    Shard numbers follow from the running size alone, so the result doesn't depend on the cluster. A shard is
    written by one task; the whole is never in one place.
    """
    from sluice.operators.corpus import ordered_offsets

    rows = ordered_offsets(weights, [F.col("key")], F.col("bytes")).withColumn("shard", F.floor(F.col("before") / per_shard).cast("int")).drop("before")
    rows.repartition("shard").sortWithinPartitions("shard", "key").write.mode("overwrite").partitionBy("shard").parquet(path)
    return weights.sparkSession.read.parquet(path).select("key", "shard")


def merge_report(stats: DataFrame, warnings: DataFrame) -> DataFrame:
    """(text): a Markdown report of merge statistics by layer, and the warnings below."""
    table = markdown(stats, "layer").select(F.lit(0).alias("o"), "text")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("layer", "warning", "value"))), lambda x: F.format_string("- layer %d: %s (%.3f)", x["layer"], x["warning"], x["value"])), "\n")
    notes = warnings.agg(F.concat(F.lit("## Warnings\n\n"), F.when(F.count(F.lit(1)) > 0, listed).otherwise("none")).alias("text")).select(F.lit(1).alias("o"), "text")
    return table.unionByName(notes).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def markdown(df: DataFrame, order: str) -> DataFrame:
    """(text): a Markdown table of a summary; meant for reports, whose rows are few."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return df.select(F.col(order).alias("o"), line.alias("l")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n")).alias("text"))
