"""Router statistics, expert selection, co-occurrence and router losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import softmax, top_indices, total


def top_experts(df: DataFrame, logits: str, k: int) -> DataFrame:
    """Add `experts`: the k experts of each token, ties to the smaller id."""
    return df.withColumn("experts", top_indices(F.col(logits), k))


def usage(df: DataFrame, logits: str, k: int, experts: int, mask: Column | None = None) -> DataFrame:
    """(layer, expert, cnt): how often each expert is among a token's k; unused experts have 0."""
    rows = df.where(mask) if mask is not None else df
    hit = top_experts(rows, logits, k).select("layer", F.explode("experts").alias("expert")).groupBy("layer", "expert").agg(F.count(F.lit(1)).alias("cnt"))
    every = df.select("layer").distinct().select("layer", F.explode(F.sequence(F.lit(0), F.lit(experts - 1))).alias("expert"))
    return every.join(hit, ["layer", "expert"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def ranked(usage_counts: DataFrame) -> DataFrame:
    """Add `rank` from 1: most used first, ties to the smaller id."""
    return usage_counts.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("cnt"), "expert")))


def recommended(usage_counts: DataFrame, n: int) -> DataFrame:
    """(layer, experts): the n most used experts of each layer, ascending."""
    return ranked(usage_counts).where(F.col("rank") <= n).groupBy("layer").agg(F.sort_array(F.collect_list("expert")).alias("experts"))


def selected(layers: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The chosen experts of each layer; layers without any take the first n."""
    return layers.join(chosen, "layer", "left").withColumn("experts", F.coalesce("experts", F.sequence(F.lit(0), F.lit(n - 1))))


def manual(df: DataFrame, experts: int, n: int) -> DataFrame:
    """(layer, error) of a manual selection (layer, experts): wrong count, repeated or out of range."""
    ids = F.col("experts")
    error = F.when(F.size(ids) != n, "wrong count").when(F.size(F.array_distinct(ids)) != n, "repeated").when(F.exists(ids, lambda e: (e < 0) | (e >= experts)), "out of range")
    return df.select("layer", error.alias("error"))


def mapping(chosen: DataFrame) -> DataFrame:
    """(layer, old_id, new_id) of the chosen experts."""
    return chosen.select("layer", F.posexplode(F.array_sort("experts")).alias("new_id", "old_id")).select("layer", "old_id", "new_id")


def mapping_json(mapped: DataFrame) -> DataFrame:
    """(layer, json): old to new ids as a JSON object."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("old_id", "new_id"))))
    return mapped.groupBy("layer").agg(F.to_json(pairs).alias("json"))


def cooccurrence(df: DataFrame, logits: str, k: int) -> DataFrame:
    """(layer, a, b, cnt) with a < b: experts that serve one token together; k bounds a token's pairs."""
    rows = top_experts(df, logits, k).withColumn("e", F.array_sort("experts"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select("layer", F.explode(pairs).alias("p")).groupBy("layer", "p.a", "p.b").agg(F.count(F.lit(1)).alias("cnt"))


def entropy(logits: Column) -> Column:
    """Of the plain softmax, probabilities at least 1e-9 inside the logarithm."""
    return -total(F.transform(softmax(logits), lambda p: p * F.log(F.greatest(p, F.lit(1e-9)))))


def removed_mass(logits: Column, surviving: Sequence[int]) -> Column:
    """Probability on experts that were removed."""
    p = softmax(logits)
    return 1 - total(F.filter(p, lambda _, i: i.isin(list(surviving))))


def gathered(logits: Column, surviving: Sequence[int]) -> Column:
    return F.filter(logits, lambda _, i: i.isin(list(surviving)))


def divergence(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """KL of the teacher's from the student's softmax at a temperature."""
    p, q = softmax(teacher, temperature), softmax(student, temperature)
    return total(F.zip_with(p, q, lambda a, b: a * (F.log(F.greatest(a, F.lit(1e-9))) - F.log(b))))


def layer_mean(df: DataFrame, value: str, layer: str = "layer", mask: Column | None = None) -> DataFrame:
    """The masked mean over tokens of each layer, then the mean over layers, in column `value`."""
    m = mask.cast("double") if mask is not None else F.lit(1.0)
    per = df.groupBy(layer).agg((F.sum(F.col(value) * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("x"))
    return per.agg(F.avg("x").alias(value))


def resolved(layers: DataFrame, experts: int, n: int, how: str, chosen: DataFrame | None = None) -> DataFrame:
    """(layer, experts) by the name of a selection: first_n, manual (checked) or router_top (most used)."""
    if how == "first_n":
        return selected(layers, layers.select("layer", F.lit(None).cast("array<int>").alias("experts")).where("false"), n)
    if chosen is None:
        raise ValueError(f"{how} needs a selection or usage counts")
    if how == "manual":
        bad = manual(chosen, experts, n).where("error is not null").orderBy("layer").first()
        if bad:
            raise ValueError(f"layer {bad['layer']}: {bad['error']}")
        return chosen.select("layer", "experts")
    if how == "router_top":
        return selected(layers, recommended(chosen, n), n)
    raise ValueError(f"unknown selection: {how}")
