"""Operators that no query shows whole: sources, configuration, strategies, stores, samples."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sluice.functions import expressions as x
from sluice.operators import activations, corpus, matching, metrics, routing, samples, tensors, transforms
from sluice.sources import config, files, sinks


def test_sources_by_preference():
    read = lambda paths: ("read", sorted(paths))
    assert files.resolve(["a/x.parquet", "a/y.txt"], None, None, read) == ("read", ["a/x.parquet"])
    assert files.resolve(["a/x.csv"], lambda: ["b/z.jsonl"], None, read, ["*.jsonl"]) == ("read", ["b/z.jsonl"])
    assert files.resolve([], None, lambda: "loaded", read) == "loaded"
    with pytest.raises(FileNotFoundError):
        files.resolve([], lambda: ["b/z.txt"], lambda: "loaded", read)
    with pytest.raises(FileNotFoundError):
        files.resolve([], None, None, read)


def test_listings_are_read_to_the_end():
    failures = [0]

    def page(cursor):
        if cursor == "2" and failures[0] < 4:
            failures[0] += 1
            raise OSError("busy")
        return {None: ([{"path": "a"}], "2"), "2": ([{"path": "b"}, {"path": "c"}], None)}[cursor]

    assert [e["path"] for e in files.paged_listing(page)] == ["a", "b", "c"] and failures == [4]
    with pytest.raises(OSError):
        list(files.paged_listing(lambda cursor: (_ for _ in ()).throw(OSError())))


def test_first_samples_are_the_files_first(spark, tmp_path):
    for name, rows in (("b.jsonl", range(100, 140)), ("a.jsonl", range(40))):
        (tmp_path / name).write_text("\n\n".join(json.dumps({"v": v}) for v in rows))
    got = [r.v for r in files.read_samples(spark, str(tmp_path), "v long", 45).collect()]
    assert sorted(got) == [*range(40), *range(100, 105)]
    assert files.read_samples(spark, str(tmp_path), "v long").count() == 80


def test_shard_index(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"weight_map": {"a": "s1", "b": "s2"}}')
    assert sorted(tuple(r) for r in files.weight_map(spark, str(tmp_path / "i.json")).collect()) == [("a", "s1"), ("b", "s2")]
    assert files.sidecars(["m/tokenizer.json", "m/x.bin"], ["tokenizer.json"]) == ["m/tokenizer.json"]


def test_configuration():
    raw = config.read_config('{"sources": [{"name": "a", "quota": 9000}, {"name": "b", "enabled": false}, {"name": "c", "quota": 10}]}')
    sources = config.sources_of(raw)
    assert [s.name for s in config.selected(sources)] == ["a", "c"] and [s.name for s in config.selected(sources, ["c", "b"])] == ["c"]
    assert [s.quota for s in config.selected(sources, trial=True)] == [5000, 10]
    with pytest.raises(ValueError):
        config.sources_of({"sources": [{"name": "a"}, {"name": "a"}]})
    assert config.violations({"trainable.router": "full", "lr_scheduler.min_lr_ratio": 1.0, "val_split": 0.4, "other": 1}) == []
    assert len(config.violations({"trainable.router": "lora", "val_split": 0.5, "layerwise.batch_size": 0, "eval_steps": -1})) == 4


def test_configured_names_are_transforms(spark):
    assert all(t in transforms.TRANSFORMS for t in transforms.CONFIGURED.values())
    rows = spark.createDataFrame([("a", "['x', 'y']", "1"), ("b", "['x'", "0"), ("c", "5", "0")], "ctx string, endings string, label string")
    got = transforms.apply("hellaswag_mc", rows).collect()
    assert [r.messages[1].content for r in got] == ["B"] and "A. x" in got[0].messages[0].content


def test_adapters_and_their_configuration():
    flat = {"model_type": "qwen2_moe", "num_experts": 8, "moe_topk": 2, "other": 1}
    nested = {"model_type": "qwen3_5_moe", "text_config": {"num_experts": 8}}
    assert tensors.adapter_of(flat) == tensors.adapter_of(nested) == tensors.adapter_of({"architectures": ["Qwen2MoeModel"]}) == "stacked_experts"
    with pytest.raises(ValueError):
        tensors.adapter_of({"model_type": "qwen2_moe"})
    assert tensors.edited_config(flat, 4, 1) == {"model_type": "qwen2_moe", "num_experts": 4, "num_experts_per_tok": 1, "moe_topk": 1, "other": 1}
    assert tensors.edited_config(nested, 4, 1)["text_config"] == {"num_experts": 4, "num_experts_per_tok": 1} and nested["text_config"] == {"num_experts": 8}
    tensors.register_adapter("mine", lambda c: c.get("model_type") == "mine", [(r"^w", "weight")])
    assert tensors.adapter_of({"model_type": "mine"}) == "mine"
    del tensors.ADAPTERS["mine"]


def test_strategies_by_name(spark):
    assert matching.strategy("cosine") is matching.softmax_weights and matching.strategy("local") is matching.local_matches
    assert metrics.layer_weighting("linear_deeper_more") and not metrics.layer_weighting("uniform")
    for f, name in ((matching.strategy, "x"), (metrics.layer_weighting, "x")):
        with pytest.raises(ValueError):
            f(name)
    layers = spark.createDataFrame([(0,), (1,)], "layer int")
    chosen = spark.createDataFrame([(0, [0, 1]), (1, [0, 9])], "layer int, experts array<int>")
    with pytest.raises(ValueError, match="layer 1: out of range"):
        routing.resolved(layers, 4, 2, "manual", chosen)
    assert {r.layer: r.experts for r in routing.resolved(layers, 4, 2, "manual", chosen.where("layer = 0")).collect()} == {0: [0, 1]}
    with pytest.raises(ValueError):
        routing.resolved(layers, 4, 2, "best", chosen)


def test_candidates_come_from_all_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 5))]
    dropped = spark.createDataFrame(list(enumerate(unit(9))), "row long, vec array<double>")
    kept = spark.createDataFrame(list(enumerate(unit(40))), "col long, vec array<double>")
    whole = sorted((r.row, r.slot, r.col) for r in matching.top_candidates(dropped, kept, 6).collect())
    monkeypatch.setattr(matching, "KEPT_BYTES", 600)
    assert sorted((r.row, r.slot, r.col) for r in matching.top_candidates(dropped, kept, 6).collect()) == whole


def test_missing_samples_are_named(spark):
    have = spark.createDataFrame([("a",)], "sid string")
    assert activations.require_cached(have, have, "sid").count() == 1
    with pytest.raises(ValueError, match="b, c, d"):
        activations.require_cached(spark.createDataFrame([(s,) for s in "aedcb"], "sid string"), have, "sid")


def test_snapshots_keep_other_layers(spark, tmp_path):
    rows = spark.createDataFrame([(0, "w", 1.0), (1, "w", 2.0)], "layer int, key string, v double")
    activations.snapshot(rows, str(tmp_path / "s"), {"step": 1})
    activations.snapshot(rows.where("layer = 1").withColumn("v", F.lit(9.0)), str(tmp_path / "s"), {"step": 2})
    assert {r.layer: r.v for r in spark.read.parquet(str(tmp_path / "s" / "tensors")).collect()} == {0: 1.0, 1: 9.0}
    assert json.loads(spark.read.text(str(tmp_path / "s" / "meta")).first().value) == {"step": 2}


def test_anomaly_rules(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.1, 0.1, False, "lost"), (2, 0.1, 2.0, 3.0, True, None)], "sid int, cosine_similarity double, relative_delta_vs_a double, mse double, shape_mismatch boolean, error string")
    found = activations.anomalies(rows, ["sid"])
    assert sorted((r.sid, r.rule) for r in found.collect()) == [(1, "error"), (2, "large mse"), (2, "large relative delta"), (2, "low cosine"), (2, "shape mismatch")]
    assert [r.rule for r in activations.first_anomalies(found, ["sid", "rule"], 2).collect()] == ["error", "large mse"]


def test_invalid_samples(spark):
    chat = [("user", "hi")]
    rows = [("a", "", chat, None), ("b", "", None, None), ("c", None, chat, []), ("d", "t", None, ["x", None]), ("e", "t", chat, None), ("", "t", None, None), ("f", None, [(None, "x")], None)]
    df = spark.createDataFrame(rows, "id string, text string, messages array<struct<role:string,content:string>>, images array<string>")
    assert [r.error for r in samples.violations(df).collect()] == [None, "neither text nor messages", None, "image without path", "both text and messages", "missing id", "message without role or content"]
    assert {r.id: r.images for r in samples.normalised_images(df).collect()}["c"] is None


def test_wide_vectors_take_linear_time(spark):
    rows = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: F.sin(i * F.col("id"))).alias("v")).cache()
    rows.count()
    began = time.time()
    got = rows.select(F.aggregate(x.softmax(F.col("v")), F.lit(0.0), lambda a, p: a + p).alias("s"), x.norm(x.unit(F.col("v"))).alias("n")).collect()
    assert time.time() - began < 5 and all(r.s == pytest.approx(1) for r in got) and all(r.n == pytest.approx(1) for r in got[1:])


def test_shapes(spark):
    row = spark.createDataFrame([([[[1.0, 2.0]]], [1.0, 2.0, 3.0])], "a array<array<array<double>>>, b array<double>").select(
        x.squeezed(F.col("a")).alias("s"), x.reshaped(F.col("b"), 2).alias("no"), x.reshaped(F.col("b"), 3).alias("yes"), F.array(*x.halves(F.col("b"))).alias("h"), x.smart_size(F.lit(1000), F.lit(3), 28, 784, 10**6).alias("thin"), x.smart_size(F.lit(4000), F.lit(4000), 28, 784, 10**6).alias("large"), x.smart_size(F.lit(10), F.lit(10), 28, 3136, 10**6).alias("little")
    ).first()
    assert (row.s, row.no, row.yes, row.h) == ([[1.0, 2.0]], None, [[1.0, 2.0, 3.0]], [[1.0], [2.0, 3.0]])
    assert row.thin is None and row.large.height * row.large.width <= 10**6 and row.large.height % 28 == 0 and (row.little.height, row.little.width) == (56, 56)


def test_reports(spark, tmp_path):
    stats = spark.createDataFrame([(0, 10, 0, 0), (1, 10, 9, 40)], "layer int, total long, hosted long, max_load long")
    warnings = matching.merge_warnings(stats)
    text = sinks.merge_report(stats, warnings).first().text
    assert "| 1 | 10 | 9 | 40 |" in text and "- layer 0: few hosted (0.000)" in text and "- layer 1: crowded host (40.000)" in text
    sinks.write_json_report(stats, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_layers_of_a_model(spark):
    rows = spark.createDataFrame([("model.layers.1.mlp.gate.weight", [1.0]), ("model.layers.11.mlp.gate.weight", [2.0])], "key string, data array<float>")
    assert tensors.layer_keys(rows, "model.layers.", 1).count() == 1
    assert tensors.layer_stack(rows, tensors.router_keys(rows).withColumnRenamed("key", "router"), 11, "router").first().data == [2.0]


def test_harvest_chains_through_sources(spark):
    """A key taken by one source frees tokens in the next, which then reaches a key that the third has too."""
    rows = [("a", 1, 5, "k"), ("b", 1, 5, "k"), ("b", 2, 5, "l"), ("b", 3, 5, "m"), ("c", 1, 5, "l"), ("c", 2, 5, "m"), ("c", 3, 5, "n"), ("d", 1, 5, "n"), ("d", 2, 5, "o")]
    df = spark.createDataFrame(rows, "source string, o int, n long, h string")
    got = sorted((r.source, r.h) for r in corpus.harvest(df, [(s, 10) for s in "abcd"], "o", "n", "h").collect())
    assert got == [("a", "k"), ("b", "l"), ("b", "m"), ("c", "n"), ("d", "o")]
