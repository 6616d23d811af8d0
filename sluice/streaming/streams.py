"""Streams over the same operators: quotas, duplicates, incremental runs, logs, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quota_stream(df: DataFrame, group: str, order: str, tokens: str, quota: int) -> DataFrame:
    """Accept rows of each group until their tokens reach the quota; the state is one number a group.

    Within a micro-batch rows are taken in `order`.
    """

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        before = used + rows[tokens].cumsum() - rows[tokens]
        kept = rows[before < quota]
        state.update((int(used + kept[tokens].sum()),))
        yield kept

    slim = df.select(group, order, tokens)
    return slim.groupBy(group).applyInPandasWithState(accept, slim.schema, "used long", "append", "NoTimeout")


def first_seen(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, time: str, delay: str, size: str, keys: list[str], *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates over event-time windows; late rows beyond the delay are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, delay).groupBy(window.alias("window"), *keys).agg(*aggregates)


def sessions(df: DataFrame, time: str, delay: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)


def write_missing(df: DataFrame, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the Parquet table lacks: each micro-batch is an anti join."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.schema(batch.schema).parquet(table).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    return df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def write_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended as JSON lines, exactly once."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def write_chunks(df: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch handed to an idempotent writer, such as a dynamic partition overwrite."""
    return df.writeStream.foreachBatch(lambda batch, _: write(batch)).option("checkpointLocation", checkpoint).start()
