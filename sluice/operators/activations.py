"""The activation store and drift between layers.

Store: activations(sid, layer, chunk, kind, pos, vec), partitioned by layer and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import cosine, dot, is_finite, nearest_rank

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def with_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Add `chunk`: the key's rank among all keys, divided by `size`."""
    from sluice.operators.corpus import ordered_offsets

    keys = ordered_offsets(df.select(key).distinct(), [F.col(key)], F.lit(1)).select(key, F.floor(F.col("before") / size).cast("int").alias("chunk"))
    return df.join(keys, key)


def write_store(df: DataFrame, path: str) -> None:
    """Write or replace the (layer, chunk) parts that `df` holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "chunk").parquet(path)


def lookup(spark: SparkSession, path: str, index: DataFrame, layers: Sequence[int] | None = None) -> DataFrame:
    """The rows of index(sid, chunk); partition pruning leaves the chunks and layers asked for."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("layer").isin(list(layers))) if layers is not None else rows
    return rows.join(index.select("sid", "chunk"), ["sid", "chunk"])


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the largest version of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(version, *(c for c in rest if c != version))).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def present(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return samples.join(cached.select(key), key, "left_semi")


def missing(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return samples.join(cached.select(key), key, "left_anti")


def layer_blocks(layers: DataFrame) -> DataFrame:
    """block_id, input_layer, output_layer, layer_indices of the blocks that end at cached layers."""
    order = Window.orderBy("layer")  # one row per layer of a model
    rows = layers.select("layer").distinct().select((F.row_number().over(order) - 1).alias("block_id"), F.lag("layer", 1, -1).over(order).alias("input_layer"), F.col("layer").alias("output_layer"))
    return rows.withColumn("layer_indices", F.sequence(F.col("input_layer") + 1, F.col("output_layer")))


def adjacent_pairs(layers: DataFrame) -> DataFrame:
    """(layer, next_layer) over all layers that any sample has."""
    return layers.select("layer").distinct().withColumn("next_layer", F.lead("layer").over(Window.orderBy("layer"))).where("next_layer is not null")


def hidden_layers(outputs: Column) -> Column:
    """(layer, vec) of a model's outputs, whose first element is the embedding."""
    return F.transform(F.slice(outputs, 2, 1 << 30), lambda v, i: F.struct(i.alias("layer"), v.alias("vec")))


def pair_tokens(df: DataFrame, sample: str = "sid", layer: str = "layer", position: str = "pos", vector: str = "vec") -> DataFrame:
    """Each token's vector beside the same token's in the next layer; unequal lengths are cut to the shorter."""
    pairs = F.broadcast(adjacent_pairs(df.select(F.col(layer).alias("layer"))))  # one row per layer
    one = df.select(F.col(sample).alias("sid"), F.col(layer).alias("layer"), F.col(position).alias("pos"), F.col(vector).alias("a")).join(pairs, "layer")
    two = df.select(F.col(sample).alias("sid"), F.col(layer).alias("next_layer"), F.col(position).alias("pos"), F.col(vector).alias("b"))
    both = one.join(two, ["sid", "next_layer", "pos"])
    n = F.least(F.size("a"), F.size("b"))
    return both.withColumns({"cut": F.size("a") != F.size("b"), "a": F.slice("a", F.lit(1), n), "b": F.slice("b", F.lit(1), n)})


def pair_metrics(df: DataFrame, eps: float = 1e-8, **columns: str) -> DataFrame:
    """Drift of every sample between adjacent layers: norms, deltas, cosine, errors and token quantiles."""
    rows = pair_tokens(df, **columns)
    delta = F.zip_with("a", "b", lambda x, y: y.cast("double") - x.cast("double"))
    rows = rows.withColumn("d", delta)
    rows = rows.select(
        "sid", "layer", "next_layer", "cut", F.size("d").alias("n"), dot(F.col("a"), F.col("a")).alias("aa"), dot(F.col("b"), F.col("b")).alias("bb"), dot(F.col("a"), F.col("b")).alias("ab"), dot(F.col("d"), F.col("d")).alias("dd"),
        F.aggregate("d", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("l1"), F.array_max(F.transform("d", lambda x: F.abs(x))).alias("far"), cosine(F.col("a"), F.col("b"), eps).alias("tok_cos"),
    )
    rows = rows.withColumns({"tok_delta": F.sqrt("dd"), "tok_rel": F.sqrt("dd") / F.greatest(F.sqrt("aa"), F.lit(eps))})
    sums = rows.groupBy("sid", "layer", "next_layer").agg(
        F.max("cut").alias("shape_mismatch"), F.sqrt(F.sum("aa")).alias("a_norm"), F.sqrt(F.sum("bb")).alias("b_norm"), F.sqrt(F.sum("dd")).alias("delta_norm"), F.sum("ab").alias("ab"), (F.sum("dd") / F.sum("n")).alias("mse"), (F.sum("l1") / F.sum("n")).alias("mae"), F.max("far").alias("max_abs_diff"),
        *(F.collect_list(c).alias(c) for c in ("tok_delta", "tok_rel", "tok_cos")),
    )
    low = F.lit(eps)
    out = sums.select(
        "sid", "layer", "next_layer", "shape_mismatch", "a_norm", "b_norm", "delta_norm", (F.col("delta_norm") / F.greatest("a_norm", low)).alias("relative_delta_vs_a"), (F.col("delta_norm") / F.greatest("b_norm", low)).alias("relative_delta_vs_b"),
        (F.col("ab") / (F.greatest("a_norm", low) * F.greatest("b_norm", low))).alias("cosine_similarity"), "mse", "mae", "max_abs_diff",
        *(x.alias(f"{to}_{name}") for c, to in (("tok_delta", "token_delta_norm"), ("tok_rel", "token_relative_delta")) for name, x in ([("mean", F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))] + [(n, nearest_rank(F.col(c), q)) for n, q in QUANTILES.items()] + [("max", F.array_max(c))])),
        (F.aggregate("tok_cos", F.lit(0.0), lambda s, x: s + x) / F.size("tok_cos")).alias("token_cosine_mean"),
        *(nearest_rank(F.col("tok_cos"), q).alias(f"token_cosine_{n}") for n, q in (("p50", 0.5), ("p10", 0.1), ("p05", 0.05))), F.array_min("tok_cos").alias("token_cosine_min"),
    )
    return out


def summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one value), least, nearest-rank quantiles and largest of finite values."""
    parts = []
    for m in metrics:
        x = F.when(is_finite(F.col(m)), F.col(m))
        values = F.collect_list(x)
        parts += [F.avg(x).alias(f"{m}_mean"), F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0))).alias(f"{m}_std"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max")]
        parts += [nearest_rank(values, q).alias(f"{m}_{n}") for n, q in QUANTILES.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), *parts)


def finite_counts(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """How many elements are NaN, infinite either way, or finite."""
    x = F.col("x")
    rows = df.select(*keys, F.explode(vector).alias("x"))
    kinds = {"n_nan": F.isnan(x), "n_pos_inf": x == F.lit(float("inf")), "n_neg_inf": x == F.lit(float("-inf")), "n_finite": is_finite(x)}
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))


def anomalies(df: DataFrame, keys: Sequence[str], least_cosine: float = 0.5, most_relative: float = 1.0, most_error: float = 1.0) -> DataFrame:
    """One row for each rule that a pair breaks: (keys, rule, value)."""
    rules = F.array(
        F.when(F.col("cosine_similarity") < least_cosine, F.struct(F.lit("low cosine").alias("rule"), F.col("cosine_similarity").alias("value"))),
        F.when(F.col("relative_delta_vs_a") > most_relative, F.struct(F.lit("large relative delta").alias("rule"), F.col("relative_delta_vs_a").alias("value"))),
        F.when(F.col("mse") > most_error, F.struct(F.lit("large mse").alias("rule"), F.col("mse").alias("value"))),
        F.when(F.col("shape_mismatch"), F.struct(F.lit("shape mismatch").alias("rule"), F.lit(1.0).alias("value"))),
        F.when((F.col("error") if "error" in df.columns else F.lit(None)).isNotNull(), F.struct(F.lit("error").alias("rule"), F.lit(1.0).alias("value"))),
        F.when(~is_finite(F.col("mse")), F.struct(F.lit("not finite").alias("rule"), F.lit(1.0).alias("value"))),
    )
    return df.select(*keys, F.explode(F.array_compact(rules)).alias("x")).select(*keys, "x.*")


def best_candidate(df: DataFrame, keys: Sequence[str], score: str, vector: str) -> DataFrame:
    """The vector with the highest score of each key."""
    return df.groupBy(*keys).agg(F.max_by(vector, score).alias(vector), F.max(score).alias(score))


#: Parts of names that speak for activations, and those that speak against.
HIDDEN_HINTS = ["hidden", "hidden_state", "hidden_states", "activation", "activations", "teacher_hidden"]
OTHER_HINTS = ["router", "router_logits", "logits", "input_ids", "attention_mask", "position_ids", "labels"]
LEAST_WIDTH = 16


def _has(name: Column, hints: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | F.lower(name).contains(h)
    return out


def looks_hidden(name: Column) -> Column:
    """Whether a name alone speaks for activations."""
    return ~_has(name, OTHER_HINTS) & _has(name, HIDDEN_HINTS)


def hidden_candidate(path: Column, shape: Column) -> Column:
    """Whether a tensor may hold activations: by its name, or by two or three dimensions, the last one wide."""
    wide = (F.size(shape) >= 2) & (F.element_at(shape, -1) >= LEAST_WIDTH)
    return wide & ~_has(path, OTHER_HINTS) & (_has(path, HIDDEN_HINTS) | F.size(shape).isin(2, 3))


def with_cache(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Every sample with what the cache holds of it; null columns where it holds nothing."""
    return samples.join(cached, key, "left")


def require_cached(samples: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """The samples; raises ValueError with the first three keys (in order) that the cache lacks."""
    lacking = [str(r[0]) for r in missing(samples, cached, key).select(key).orderBy(key).limit(3).collect()]
    if lacking:
        raise ValueError(f"not in the cache: {', '.join(lacking)}")
    return samples


def layer_union(df: DataFrame, sample: str = "sid", layer: str = "layer") -> DataFrame:
    """(layer, samples): every layer that any sample has, and how many have it."""
    return df.groupBy(layer).agg(F.count_distinct(sample).alias("samples"))


def common_layers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(layer): the layers of both sides."""
    return a.select("layer").intersect(b.select("layer"))


def pair_counts(df: DataFrame, keys: Sequence[str] = ("layer", "next_layer"), error: str = "error") -> DataFrame:
    """(keys, samples, errors, shape_mismatches) of pair rows; `error` is a text where a pair failed."""
    failed = F.count_if(F.col(error).isNotNull()) if error in df.columns else F.lit(0).cast("long")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), failed.alias("errors"), F.count_if("shape_mismatch").alias("shape_mismatches"))


def first_anomalies(found: DataFrame, order: Sequence[str], most: int = 300) -> DataFrame:
    """The report's list: the first `most` anomalies in order."""
    return found.orderBy(*order).limit(most)


def extremes(df: DataFrame, by: str, key: str, n: int = 5) -> DataFrame:
    """(side, place, key, by): the n highest and n lowest rows, as a report shows them."""
    parts = []
    for side, order in (("high", F.desc(by)), ("low", F.asc(by))):
        top = df.where(F.col(by).isNotNull()).select(key, by).orderBy(order, key).limit(n)
        parts.append(top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, key)).alias("place"), key, by))
    return parts[0].unionByName(parts[1])


def append_layer(df: DataFrame, path: str) -> None:
    """Add rows (sid, layer, chunk, ...) to a store: other samples of their parts stay, their own are replaced."""
    from sluice.operators.corpus import written

    spark = df.sparkSession
    parts = df.select("layer", "chunk").distinct()
    old = spark.read.parquet(path).join(F.broadcast(parts), ["layer", "chunk"], "left_semi")  # one row per part written
    stay = old.join(df.select("sid", "layer", "chunk").distinct(), ["sid", "layer", "chunk"], "left_anti")
    write_store(written(stay.unionByName(df)), path)


def snapshot(df: DataFrame, path: str, meta: dict) -> None:
    """Write the tensors of layers (layer, key, ...) and their description; other layers of the folder stay."""
    import json

    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(f"{path}/tensors")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
