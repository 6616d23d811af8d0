"""Losses as aggregates, smoothed series, early stop, step windows, log rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import bound, cosine, dot, is_finite, micro_step
from sluice.operators.corpus import group_offsets, written


def masked_mean(value: Column, mask: Column | None = None) -> Column:
    """An aggregate: the sum under the mask over at least 1; without a mask the plain mean."""
    if mask is None:
        return F.avg(value)
    m = mask.cast("double")
    return F.sum(value * m) / F.greatest(F.sum(m), F.lit(1.0))


def hidden_metrics(pairs: DataFrame, keys: Sequence[str] = (), mask: Column | None = None) -> DataFrame:
    """Errors, cosine loss and norms of pairs(layer, s, t, ...): tokens, then layers, each averaged evenly."""
    eps = 1e-12
    s, t = F.col("s"), F.col("t")
    cos = cosine(s, t, eps)
    ss, tt, st = dot(s, s), dot(t, t), dot(s, t)
    rows = pairs.withColumns({"_cos": cos, "_ss": ss, "_tt": tt, "_st": st})
    unit = lambda x: F.when(x > 0, 1.0).otherwise(0.0)  # noqa: E731  the squared norm of a normalised vector
    per = rows.groupBy(*keys, "layer").agg(
        masked_mean(unit(F.col("_ss")) + unit(F.col("_tt")) - 2 * F.col("_cos"), mask).alias("hidden_mse"),
        masked_mean((F.col("_ss") + F.col("_tt") - 2 * F.col("_st")) / (F.col("_tt") + 1e-8), mask).alias("nmse"),
        masked_mean(F.col("_cos"), mask).alias("cos"),
        masked_mean(F.sqrt("_tt"), mask).alias("teacher_norm"),
        masked_mean(F.sqrt("_ss"), mask).alias("student_norm"),
    )
    return per.groupBy(*keys).agg(F.avg("hidden_mse").alias("hidden_mse"), F.avg("nmse").alias("nmse"), (1 - F.avg("cos")).alias("cos_loss"), F.avg("teacher_norm").alias("teacher_norm"), F.avg("student_norm").alias("student_norm"))


#: How layers are weighted, by name, and whether deeper ones weigh more.
WEIGHTINGS = {"uniform": False, "linear_deeper_more": True}


def layer_weighting(name: str) -> bool:
    """What weighted_layers takes for a scheme's name; an unknown one raises ValueError."""
    if name not in WEIGHTINGS:
        raise ValueError(f"unknown layer weighting: {name}")
    return WEIGHTINGS[name]


def layer_pairs(student: DataFrame, teacher: DataFrame, keys: Sequence[str] = ("sid", "layer", "pos")) -> DataFrame:
    """(keys, s, t): student and teacher vectors of the layers and tokens that both have."""
    return student.select(*keys, F.col("vec").alias("s")).join(teacher.select(*keys, F.col("vec").alias("t")), list(keys))


def weighted_layers(per_layer: DataFrame, value: str, deeper_more: bool = False) -> DataFrame:
    """A loss over layers: evenly, or weighted by depth rank over the sum of ranks."""
    rank = F.row_number().over(Window.orderBy("layer"))  # one row per layer
    rows = per_layer.withColumn("_w", rank.cast("double") if deeper_more else F.lit(1.0))
    return rows.agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(value))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of one token: the log of the summed exponentials less the label's logit; null for ignored labels."""
    logsum = bound(F.array_max(logits).cast("double"), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))))
    return F.when(label != -100, logsum - F.try_element_at(logits, label.cast("int") + 1).cast("double"))


def shifted_cross_entropy(df: DataFrame, key: str, pos: str, logits: str, label: str) -> DataFrame:
    """Mean loss of predicting each row's next label within its key."""
    rows = df.withColumn("_next", F.lead(label).over(Window.partitionBy(key).orderBy(pos)))
    return rows.agg(F.avg(cross_entropy(F.col(logits), F.col("_next"))).alias("loss"))


def total_loss(parts: dict[str, tuple[float, Column]], fallback: Column) -> Column:
    """The weighted sum of the enabled parts; the fallback if none has a weight."""
    used = [c * w for w, c in parts.values() if w > 0]
    out = used[0] if used else fallback
    for c in used[1:]:
        out = out + c
    return out


def token_stats(df: DataFrame, mask: str) -> DataFrame:
    n = F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.agg(F.sum(n).alias("valid_tokens"), F.avg(n).alias("mean_seq_len"))


def smoothed(df: DataFrame, group: str, step: str, value: str, beta: float = 0.95) -> DataFrame:
    """Add `ema`: beta * last + (1 - beta) * value, from the first value on; after a null it starts anew.

    Ranges of the sorted rows are folded apart, each from 0, with the weight that the state before the range
    still has; one row per range and group carries that state on. So no task holds a whole series.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    order = ["_g", "step", "value"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state, left, n = None, 0.0, 1.0, 0
        for batch in batches:
            own, weight, place = [], [], []
            for g, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (g,) != of:
                    of, state, left, n = (g,), 0.0, 1.0, 0
                if v is None:
                    state, left = None, 0.0
                elif state is None:
                    state = v
                else:
                    state, left = beta * state + (1 - beta) * v, left and max(left * beta, 5e-324)  # an infinite state stays one
                own.append(state)
                weight.append(left)
                place.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64()), pa.array(weight, pa.float64()), pa.array(place, pa.int64())], names=names)

    names = ["_g", "step", "value", "_p", "_own", "_left", "_n"]
    kind = rows.schema["_g"].dataType.simpleString()
    folded = written(ranged.mapInArrow(fold, f"_g {kind}, step long, value double, _p int, _own double, _left double, _n long"))
    ends = folded.groupBy("_g", "_p").agg(F.min_by("value", "_n").alias("first"), F.max_by(F.struct("_own", "_left"), "_n").alias("end"))
    series = ends.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_p", "first", F.col("end._own").alias("own"), F.col("end._left").alias("left")))).alias("x"))
    whole = lambda own, left, before: F.when(left > 0, own + left * before).otherwise(own)
    start = F.struct(F.lit(None).cast("double").alias("state"), F.array().cast("array<struct<p:int,before:double>>").alias("out"))

    def carry(a, x):
        before = F.coalesce(a["state"], x["first"])  # a series' first value counts as its own past
        return F.struct(whole(x["own"], x["left"], before).alias("state"), F.concat(a["out"], F.array(F.struct(x["_p"].alias("p"), before.alias("before")))).alias("out"))

    carried = series.select(F.col("_g").alias("_h"), F.explode(F.aggregate("x", start, carry, lambda a: a["out"])).alias("r")).select("_h", F.col("r.p").alias("_q"), F.col("r.before").alias("_before"))
    out = folded.join(carried, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q")))
    return out.select(F.col("_g").alias(group), "step", "value", whole(F.col("_own"), F.col("_left"), F.col("_before")).alias("ema"))


def early_stop(df: DataFrame, group: str, step: str, value: str, patience: int, threshold: float = float("-inf"), least: float = 1e-6) -> DataFrame:
    """(group, stop_step, best, reason) of a sequential fold over each series.

    A series is one task, which streams its sorted rows and holds one batch. Rows without a value count as no
    better; rows without a step come last, and rows of equal steps by their values.
    """
    kind = dict(df.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, best, waited, stop, reason, done, key = None, float("inf"), 0, None, "none", [], None

        def table() -> pa.RecordBatch:
            types = (key, pa.int64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=[group, "stop_step", "best", "reason"])

        for batch in batches:
            key, done = batch.schema.field(0).type, []
            for g, s, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (g,) != of:
                    if of:
                        done.append((*of, stop, best, reason))
                    of, best, waited, stop, reason = (g,), float("inf"), 0, None, "none"
                if reason != "none":
                    continue
                if v is not None and v < best - least:
                    best, waited = v, 0
                else:
                    waited += 1
                if v is not None and v <= threshold or waited >= patience:
                    stop, reason = s, "threshold" if v is not None and v <= threshold else "patience"
            yield table()
        if of:
            done = [(*of, stop, best, reason)]
            yield table()

    rows = df.select(group, F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value))
    ordered = rows.repartition(group).sortWithinPartitions(group, F.col(step).asc_nulls_last(), value)
    return ordered.mapInArrow(fold, f"{group} {kind[group]}, stop_step long, best double, reason string")


def step_windows(df: DataFrame, step: str, value: str, size: int) -> DataFrame:
    """Mean and count of `value` over windows of `size` steps."""
    return df.groupBy(F.floor(F.col(step) / size).cast("long").alias("window")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def due(df: DataFrame, step: str, every: int) -> DataFrame:
    return df.where((F.col(step) > 0) & (F.col(step) % every == 0))


def evaluation_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, mean, n) over rows that have the metric."""
    long = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(list(keys), list(metrics), "metric", "x")
    return long.where("x is not null").groupBy(*keys, "metric").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def scalar_series(df: DataFrame, step: str, metrics: Sequence[str]) -> DataFrame:
    """(step, tag, value) of finite values."""
    long = df.select(step, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([step], list(metrics), "tag", "value")
    return long.where(is_finite(F.col("value")))


def metric_line(step: Column, parts: dict[str, Column], width: int = 12) -> Column:
    """One fixed-width line of a step and its metrics."""
    cells = [F.concat(F.lit(f"{name}="), F.lpad(F.format_string("%.6g", x.cast("double")), width, " ")) for name, x in parts.items()]
    return F.concat_ws(" ", F.lpad(step.cast("string"), 8, " "), *cells)


def accumulated(df: DataFrame, order: str, metrics: Sequence[str], accumulate: int) -> DataFrame:
    """(step, metrics): the mean over each optimizer step's micro-steps, numbered from 0 in `order`."""
    numbered = df.withColumn("step", micro_step(F.col(order), accumulate))
    return numbered.groupBy("step").agg(*((F.sum(m) / accumulate).alias(m) for m in metrics))


def cycling(df: DataFrame, key: str, epochs: int, seed: int) -> DataFrame:
    """(epoch, key, place): every epoch in another seeded order."""
    rows = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")).cast("binary"))
    placed = group_offsets(rows.withColumn("_k", order), ["epoch"], ["_k", key], F.lit(1))
    return placed.withColumnRenamed("before", "place").drop("_k")
