"""Samples, activations, routing, matching, tensors, metrics and files on small hand-made rows."""

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.functions import expressions as x
from sluice.operators import activations, matching, metrics, routing, samples, tensors
from sluice.plans import queries as library
from sluice.sources import files, sinks


@pytest.mark.parametrize(("spec", "layers", "n", "want"), [("all", 8, 1, list(range(8))), ("every_2", 8, 1, [0, 2, 4, 6]), ("every_n", 8, 3, [0, 3, 6]), ("0,3,5", 8, 1, [0, 3, 5]), ("block_4", 8, 1, [3, 7]), ("block_4", 40, 1, list(range(3, 40, 4))), ("", 3, 1, [0, 1, 2]), (None, 2, 1, [0, 1]), ("[0,3,5]", 8, 1, [0, 3, 5]), ("3,0,3", 8, 1, [0, 3]), (" Every_Layer_Interval ", 8, 3, [0, 3, 6]), ("every_n", 3, 0, [0, 1, 2]), ("every_0", 2, 1, [0, 1])])
def test_layer_spec(spec, layers, n, want):
    assert x.layer_spec(spec, layers, n) == want
    for bad in ("some", "3", "a,b", "every_x"):
        with pytest.raises(ValueError):
            x.layer_spec(bad, 8)


def test_split_is_disjoint_and_stable(spark):
    rows = spark.range(200).select(F.format_string("sample_%06d", "id").alias("id"))
    train, val = ({r.id for r in samples.part(rows, "id", 0.1, w).collect()} for w in ("train", "val"))
    assert not train & val and len(train | val) == 200 and 5 <= len(val) <= 50
    assert samples.part(rows, "id", 0.0, "val").count() == 0
    with pytest.raises(ValueError):
        samples.part(rows, "id", 0.5, "val")


def test_strict_samples(spark):
    good = spark.createDataFrame([("a", "t", None)], "id string, text string, messages array<struct<role:string,content:string>>")
    assert samples.strict(good).count() == 1
    with pytest.raises(Exception, match="missing id"):
        samples.strict(good.withColumn("id", F.lit(None).cast("string"))).collect()


def test_padding_and_positions(spark):
    rows = spark.createDataFrame([(0, 1, [5, 6, 7]), (0, 2, [8])], "b int, i int, ids array<int>")
    got = {r.i: r for r in samples.padded(rows, ["b"], "ids", filler=9, multiple=4).collect()}
    assert got[2].ids == [8, 9, 9, 9] and got[2].attention_mask == [1, 0, 0, 0] and got[2].labels == [8, -100, -100, -100]
    axis = spark.createDataFrame([([[0, 1], [0, 1], [0, 2]],)], "p array<array<int>>").select(samples.padded_positions(F.col("p"), F.lit(4)).alias("p")).first().p
    assert axis == [[0, 1, 2, 2], [0, 1, 2, 2], [0, 2, 3, 3]]


def test_image_count_must_agree(spark):
    rows = spark.createDataFrame([([1, 9, 9], ["a", "b"]), ([1, 9], ["a", "b"])], "ids array<int>, images array<string>")
    assert samples.consistent_images(rows, "ids", 9, "images").count() == 1


def test_incomplete_layers_go(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (0, "a", 2)], "batch int, sid string, layer int")
    assert [tuple(r) for r in samples.complete_layers(rows, "batch", "sid", "layer").collect()] == [(0, 1)]


def test_store_replaces_only_its_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, 2.0)], "sid string, layer int, chunk int, v double")
    activations.write_store(rows, str(tmp_path / "s"))
    activations.write_store(rows.where("chunk = 1").withColumn("v", F.lit(3.0)), str(tmp_path / "s"))
    got = activations.lookup(spark, str(tmp_path / "s"), rows.select("sid", "chunk"), [0]).collect()
    assert {r.sid: r.v for r in got} == {"a": 1.0, "b": 3.0}


def test_equal_layers_do_not_drift(spark):
    rows = spark.createDataFrame([("a", layer, 0, [3.0, 4.0]) for layer in (0, 1)], "sid string, layer int, pos int, vec array<float>")
    got = activations.pair_metrics(rows).first()
    assert (got.delta_norm, got.mse, got.a_norm, got.shape_mismatch) == (0.0, 0.0, 5.0, False) and got.cosine_similarity == pytest.approx(1)


def test_summary_drops_what_is_not_finite(spark):
    rows = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 4.0, math.nan, math.inf, -math.inf)] + [("one", 5.0), ("none", math.nan)], "k string, m double")
    got = {r.k: r for r in activations.summary(rows, ["k"], ["m"]).collect()}
    assert (got["k"].m_mean, got["k"].m_p50, got["k"].m_max) == (pytest.approx(7 / 3), 2.0, 4.0)
    assert got["one"].m_std == 0.0 and got["none"].m_std is None and got["none"].m_p50 is None


def test_selection(spark):
    usage = spark.createDataFrame([(0, 0, 100), (0, 1, 200), (0, 2, 50), (0, 3, 300), (0, 4, 10)] + [(1, e, 1) for e in range(5)], "layer int, expert int, cnt long")
    chosen = routing.recommended(usage, 2)
    layers = spark.createDataFrame([(0,), (1,), (2,)], "layer int")
    assert {r.layer: r.experts for r in routing.selected(layers, chosen, 2).collect()} == {0: [1, 3], 1: [0, 1], 2: [0, 1]}
    bad = spark.createDataFrame([(0, [0, 1]), (1, [0, 99]), (2, [0]), (3, [1, 1])], "layer int, experts array<int>")
    assert {r.layer: r.error for r in routing.manual(bad, 4, 2).collect()} == {0: None, 1: "out of range", 2: "wrong count", 3: "repeated"}
    assert {json.loads(r.json)["3"] for r in routing.mapping_json(routing.mapping(chosen)).where("layer = 0").collect()} == {1}


def test_uniform_router(spark):
    row = spark.createDataFrame([([0.0] * 8,)], "l array<double>").select(routing.entropy(F.col("l")).alias("h"), routing.removed_mass(F.col("l"), [0]).alias("m"), routing.divergence(F.col("l"), F.col("l")).alias("k")).first()
    assert row.h == pytest.approx(math.log(8)) and row.m == pytest.approx(7 / 8) and row.k == pytest.approx(0)


def test_hungarian_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(30):
        cost = rng.random((4, 6))
        got = matching.hungarian(cost)
        best = min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))
        assert cost[np.arange(4), got].sum() == pytest.approx(best)


def test_matchings_are_one_to_one(spark):
    rng = np.random.default_rng(2)
    unit = lambda n: [(v / np.linalg.norm(v)).tolist() for v in rng.normal(size=(n, 6))]
    dropped = spark.createDataFrame(list(enumerate(unit(12))), "row long, vec array<double>")
    kept = spark.createDataFrame(list(enumerate(unit(20))), "col long, vec array<double>")
    found = matching.top_candidates(dropped, kept, 5).withColumn("layer", F.lit(0))
    for match in (matching.greedy_matching(found, "layer"), matching.block_matching(found, "layer", 4)):
        rows = match.collect()
        assert rows and len({r.row for r in rows}) == len(rows) == len({r.col for r in rows})


def test_weights(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 3), (0, 1, 4, 1), (0, 3, 2, 0), (0, 3, 4, 0)], "layer int, dropped int, kept int, cnt long")
    assert {(r.dropped, r.kept): r.w for r in matching.cooccurrence_weights(pairs).collect()} == {(1, 2): 0.75, (1, 4): 0.25, (3, 2): 0.5, (3, 4): 0.5}
    zero = spark.createDataFrame([(0, 0, 0)], "layer int, expert int, cnt long")
    assert matching.alpha_scale(zero, spark.createDataFrame([(0, 0), (1, 0)], "layer int, expert int")).collect()[0].scale == 1.0


def test_cross_entropy_ignores_labels(spark):
    rows = spark.createDataFrame([(0, 0, [0.0, 0.0], 0), (0, 1, [0.0, 0.0], 1), (0, 2, [9.0, 0.0], -100)], "k int, p int, l array<double>, y int")
    assert metrics.shifted_cross_entropy(rows, "k", "p", "l", "y").first().loss == pytest.approx(math.log(2))


def test_early_stop(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.0, 1.0])] + [("b", i, float(-i)) for i in range(5)], "g string, s long, v double")
    got = {r.g: (r.stop_step, r.reason) for r in metrics.early_stop(rows, "g", "s", "v", 2).collect()}
    assert got["a"] == (3, "patience") and got["b"][1] == "none"


def test_schedule_ends(spark):
    rows = spark.createDataFrame([(0,), (10,), (100,), (500,)], "s long").select(x.learning_rate(F.col("s"), "cosine", 10, 100).alias("c"), x.learning_rate(F.col("s"), "linear", 10, 100).alias("l")).collect()
    assert [(round(r.c, 6), round(r.l, 6)) for r in rows] == [(0, 0), (1, 1), (0.1, 0.1), (0.1, 0.1)]
    with pytest.raises(ValueError):
        x.learning_rate(F.col("s"), "step", 0, 1)


def test_overrides_and_keys(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    got = tensors.overridden(base, spark.createDataFrame([("b", 9)], "key string, v int"), "key", "v").collect()
    assert {r.key: (r.v, r.overridden) for r in got} == {"a": (1, False), "b": (9, True)}
    keys = spark.createDataFrame([("model.layers.2.mlp.experts.5.up.weight",), ("model.layers.2.mlp.experts.6.up.weight",), ("model.layers.3.mlp.experts.6.up.weight",), ("lm_head.weight",)], "key string")
    mapped = spark.createDataFrame([(2, 5, 0)], "layer int, old_id int, new_id int")
    assert {r.key for r in tensors.pruned(keys, mapped).collect()} == {"model.layers.2.mlp.experts.0.up.weight", "model.layers.3.mlp.experts.6.up.weight", "lm_head.weight"}


def test_files(spark, tmp_path):
    assert files.majority_format([]) == "parquet" and files.majority_format(["a.csv", "b.jsonl", "c.json.gz"]) == "json"
    assert files.matching(["x/a.csv", "b.csv"], ["x/*"]) == ["x/a.csv"] and files.matching(["x/a.csv"], ["a.*"]) == ["x/a.csv"]
    assert [r.m for r in spark.createDataFrame([("x/a.csv",), ("b.json",)], "p string").select(files.matches_pattern(F.col("p"), "a.*").alias("m")).collect()] == [True, False]
    t = pa.table({"a": [1, 2], "b": ["x", None]})
    for name, writer in (("s.arrow", pa.ipc.new_stream), ("f.arrow", pa.ipc.new_file)):
        with pa.OSFile(str(tmp_path / name), "wb") as f, writer(f, t.schema) as w:
            w.write_table(t)
    got = files.read_files(spark, [str(tmp_path / n) for n in ("s.arrow", "f.arrow")], schema="b string, a long").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, "x"), (1, "x"), (2, None), (2, None)]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_samples(spark, str(tmp_path / "r.jsonl"), "a long").count() == 2
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {}}).encode()
    (tmp_path / "t.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + bytes(24))
    assert [(r.key, r["shape"]) for r in files.tensor_headers(spark, [str(tmp_path / "t.safetensors")]).collect()] == [("w", [2, 3])]


def test_index_and_stats(spark, tmp_path):
    rows = spark.createDataFrame([('{"samples": {"a": {"sample_id": "b"}}, "x": [{"id": "c"}]}',)], "j string")
    assert sorted(r.id for r in files.index_ids(rows, "j").collect()) == ["a", "b", "c"]
    (tmp_path / "s.json").write_text('{"layers": {"0": {"usage_counts": {"3": 7, "1": 2}}}}')
    assert sorted(tuple(r) for r in files.router_stats(spark, str(tmp_path / "s.json")).collect()) == [(0, 1, 2), (0, 3, 7)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2)], "id string, v int, _n int")
    sinks.write_corpus(rows, str(tmp_path / "c"), 1)
    assert spark.read.json(str(tmp_path / "c")).columns == ["id", "v"]
    sinks.write_report([rows.select("id"), rows.select("id", "v")], str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["id", "v"]
    assert sinks.markdown(rows.select("id", "v"), "id").first().text == "| id | v |\n|---|---|\n| a | 1 |"
    images = spark.createDataFrame([(b"x",), (b"x",), (None,)], "image binary")
    assert sinks.unique_images(images).count() == 1


def test_merge_queries_read_every_embedding(spark):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) for r in rows}
    label = {r.vec_id: r.label for r in rows}
    want = {}
    for d in (i for i in unit if i % 2 == 1):
        kept = [k for k in unit if k % 2 == 0 and label[k] == label[d]]
        sims = np.array([unit[d] @ unit[k] for k in kept])
        raised = np.exp((sims - sims.max()) / 0.1)
        want |= {(d, k): (s, w) for k, s, w in zip(kept, sims, raised / raised.sum(), strict=True)}
    got = {(r.dropped, r.kept): (r.sim, r.w) for r in library.QUERIES["merge_cosine_weights"](spark, data).collect()}
    assert got.keys() == want.keys() and max(i for i, _ in got) > 200
    assert all(np.allclose(got[i], want[i], atol=2e-6) for i in want)

    neurons = 4 * sum(i % 2 for i in unit)
    matches = library.QUERIES["merge_local_match"](spark, data).collect()
    assert len(matches) == neurons
    hosts = {d: max((s, -k) for (e, k), (s, _) in want.items() if e == d) for d in {d for d, _ in want}}
    assert {(r.dropped, r.host) for r in matches} == {(d, -k) for d, (_, k) in hosts.items()}
    assert sum(r.total for r in library.QUERIES["merge_stats"](spark, data).collect()) == neurons
    assert sum(r.n for r in library.QUERIES["merge_host_load_histogram"](spark, data).collect()) == 4 * sum(1 - i % 2 for i in unit)
    assert library.QUERIES["merge_weighted_sum"](spark, data).count() == 64 * sum(1 - i % 2 for i in unit)

    part = {4 * i + n: v[16 * n : 16 * n + 16] / np.linalg.norm(v[16 * n : 16 * n + 16]) for i, v in unit.items() for n in range(4)}
    d, k = ([i for i in sorted(part) if i // 4 % 2 == odd] for odd in (1, 0))
    sims = np.array([part[i] for i in d]) @ np.array([part[i] for i in k]).T
    taken, greedy = set(), set()
    for i in sorted(range(len(d)), key=lambda i: (-sims[i].max(), d[i])):
        free = next((j for j in np.argsort(-sims[i], kind="stable")[:8] if j not in taken), None)
        if free is not None:
            taken.add(free)
            greedy.add((d[i], k[free]))
    assert {(r.row, r.col) for r in library.QUERIES["merge_greedy_global"](spark, data).collect()} == greedy
    blocks = [(r.row, r.col) for r in library.QUERIES["merge_block_match"](spark, data).collect()]
    assert len({r for r, _ in blocks}) == len({c for _, c in blocks}) == len(blocks) and max(blocks)[0] > 800


def test_first_is_a_stable_sort():
    rng = np.random.default_rng(3)
    for _ in range(200):
        row = rng.integers(0, 5, rng.integers(1, 20)).astype(float)
        assert matching._first(row, 8).tolist() == np.argsort(-row, kind="stable")[:8].tolist()


def test_sample_queries_read_whole_texts(spark):
    data = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id)
    lengths = {r.doc_id: [len(w) for w in re.split(r"[ \t\n\x0B\f\r]+", r.text) if w] for r in rows}
    assert max(map(len, lengths.values())) > 1000
    by_source, want = {}, {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r.doc_id)
    for ids in by_source.values():
        for at in range(0, len(ids), 8):
            to = -(-max(len(lengths[i]) for i in ids[at : at + 8]) // 4) * 4
            for i in ids[at : at + 8]:
                own = lengths[i]
                want[i] = at // 8, " ".join(map(str, own + [0] * (to - len(own)))), " ".join(map(str, own + [-100] * (to - len(own)))), len(own)
    assert {r.doc_id: (r.batch, r.ids, r.labels, r.valid) for r in library.QUERIES["sample_batch_pad"](spark, data).collect()} == want

    masked = {i: (" ".join(str(n if p % 2 else -100) for p, n in enumerate(own)), " ".join(str(n if p >= len(own) - 3 else -100) for p, n in enumerate(own))) for i, own in lengths.items()}
    assert {r.doc_id: (r.labels, r.tail) for r in library.QUERIES["sample_label_mask"](spark, data).collect()} == masked

    counts = Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in rows)
    got = library.QUERIES["sample_duplicate_ids"](spark, data).collect()
    assert {r.id: r.n for r in got} == {k: n for k, n in counts.items() if n > 1}


@pytest.mark.parametrize("joined", ["true", "false"])
def test_smoothed_is_a_sequential_loop(spark, joined):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", joined)  # false: a series spans ranges

    def loop(rows):
        want = {}
        for g in {r[0] for r in rows}:
            ema = None
            for _, s, v in sorted(r for r in rows if r[0] == g):
                ema = None if v is None else v if ema is None else ema * 0.95 + v * 0.05
                want[g, s] = ema
        return want

    def same(got, want):
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (want[i] is None) and (want[i] is None or math.isclose(got[i], want[i], abs_tol=2e-6)) for i in want)

    data = "/root/testdata/sf0.01"
    events = [(r.event_type, r.event_id, r.value) for r in spark.read.parquet(f"{data}/events.parquet").select("event_type", "event_id", "value").collect()]
    assert len(events) == 10_000
    same({(r.event_type, r.step): r.ema for r in library.QUERIES["metric_ema"](spark, data).collect()}, loop(events))

    odd = [("a", i, None if i in (0, 5, 6, 700, 999) else float(i % 13)) for i in range(1000)] + [("b", 3, 2.0), ("c", 1, None), ("c", 2, 4.0)]
    df = spark.createDataFrame(odd, "g string, s long, v double").repartition(7)
    same({(r.g, r.step): r.ema for r in metrics.smoothed(df, "g", "s", "v").collect()}, loop(odd))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def odd_experts(spark, monkeypatch):
    """Two layers over several tiles, with vectors that are null, of zeros, of another width or hold a null; a layer with one side only."""
    for name, size in (("TILE_ROWS", 7), ("TILE_COLUMNS", 5), ("PLAN_ROWS", 3)):
        monkeypatch.setattr(matching, name, size)
    rng = np.random.default_rng(11)
    rows = [(i % 2 if i < 80 else None, i // 2, i % 4 < 2, rng.normal(size=6).tolist()) for i in range(90)]
    rows += [(0, 100 + i, i % 2 == 0, v) for i, v in enumerate([None, None, [0.0] * 6, [0.0] * 6, [1.0, 2.0], [2.0, 1.0], [1.0] * 5 + [None], [None] + [1.0] * 5])]
    rows += [(7, 200, True, [1.0] * 6), (8, 201, False, [1.0] * 6)]
    df = spark.createDataFrame(rows, "layer int, expert long, kept boolean, vec array<float>")
    return df.where("not kept").drop("kept"), df.where("kept").drop("kept")


def test_cosine_weighted_sums_are_those_of_the_pairs(spark, odd_experts):
    dropped, kept = odd_experts
    flat = lambda d: d.select("layer", "expert", F.posexplode("vec").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    weights = matching.softmax_weights(matching.similarities(dropped, kept), 0.1)
    result = lambda df: {(r.layer, r.kept, r.i): r.value for r in df.collect()}
    want, got = result(matching.weighted_sums(flat(kept), flat(dropped), weights, 0.5)), result(matching.cosine_weighted_sums(kept, dropped, 0.1, 0.5))
    assert got.keys() == want.keys() and {k[0] for k in got} == {0, 1, 7, None}
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or math.isclose(got[k], want[k], abs_tol=1e-9)) for k in want)


def test_parts_of_a_merge_plan_are_the_whole_plan(spark, odd_experts):
    dropped, kept = odd_experts
    dropped, kept = (d.unionByName(spark.createDataFrame([(9, i, [v] * 6)], d.schema)) for d, i, v in ((dropped, 300, math.nan), (kept, 301, 1.0)))
    weights = matching.softmax_weights(matching.similarities(dropped, kept), 0.1)
    whole = {r.layer: json.loads(r.json) for r in matching.merge_plan(weights, 0.5).collect()}
    heads = {r.layer: json.loads(r.json) for r in matching.merge_plan_heads(dropped, kept, 0.5).collect()}
    assert heads == {k: {c: v[c] for c in ("alpha", "dropped", "surviving")} for k, v in whole.items()}
    parts = [(r.layer, r.dropped, json.loads(r.json)) for r in matching.merge_plan_weights(dropped, kept, 0.1).collect()]
    got = [(layer, d, *pair) for layer, d, p in parts for pair in zip(p["kept"], p["w"], strict=True)]
    want = {(layer, w["dropped"], w["kept"]): w.get("w") for layer, plan in whole.items() for w in plan["weights"]}
    assert len(got) == len(want) and {g[:3] for g in got} == want.keys()
    assert all((w is None) == (want[tuple(k)] is None) and (w is None or w == want[tuple(k)] or math.isclose(w, want[tuple(k)], abs_tol=1e-9)) for *k, w in got)
    assert ("NaN", 301) in [(w, k) for *_, k, w in got]
    assert max(len(p["kept"]) for *_, p in parts) < 25  # a tile's kept experts, not all pairs
