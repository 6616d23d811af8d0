"""Further registered queries: stores, readers, sinks, plans and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import expressions as x
from sluice.operators import activations, corpus, matching, metrics, routing, samples, tensors
from sluice.plans.queries import CHOSEN, COUNTED, EDGES, HIDDEN, KEYS, MATCHES, PAIRS, PATHS, SIMS, WORD_LENGTHS, counted, experts, hidden, keys, logits, neurons, paths, query, table, word_lengths
from sluice.sources import files, sinks
from sluice.streaming import streams


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{corpus.shared_folder(spark)}/sluice-{name}-{uuid.uuid4().hex}"


@query(f"SELECT source, path FROM ({PATHS}) WHERE path LIKE '%.parquet' OR path LIKE '%.csv'")
def manifest_data_files(spark, sf_dir):
    wanted = files.matches_pattern(F.col("path"), "*.parquet") | files.matches_pattern(F.col("path"), "*/en/*.csv") | F.col("path").endswith(".csv")
    return paths(spark, sf_dir).where(files.is_data_file(F.col("path")) & wanted).select("source", "path")


@query("SELECT 'source' AS kind, source AS value FROM documents WHERE source IS NOT NULL UNION SELECT 'lang', lang FROM documents WHERE lang IS NOT NULL")
def manifest_distinct(spark, sf_dir):
    return files.distinct_values(table(spark, sf_dir, "documents"), "source", "lang")


PLACES = "CASE WHEN n_tok <= 256 THEN 0 WHEN n_tok <= 512 THEN 1 WHEN n_tok <= 1024 THEN 2 WHEN n_tok <= 2048 THEN 3 END"


@query(f"""SELECT doc_id, source, CAST(b AS INTEGER) AS bucket, CAST(coalesce(sum(n_tok) OVER (PARTITION BY source, b ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bucket_before
    FROM (SELECT doc_id, source, n_tok, {PLACES} AS b FROM ({COUNTED})) WHERE b IS NOT NULL""")
def corpus_running_buckets(spark, sf_dir):
    rows = counted(spark, sf_dir).select("doc_id", "source", "n_tok")
    return corpus.running_buckets(rows, "source", "doc_id", "n_tok", EDGES).select("doc_id", "source", "bucket", "bucket_before")


@query("SELECT doc_id, source || '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents")
def corpus_provisional_ids(spark, sf_dir):
    return corpus.provisional_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "id")


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def cache_left_join(spark, sf_dir):
    return activations.with_cache(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query(f"SELECT layer, count(DISTINCT sid) AS samples FROM ({HIDDEN}) GROUP BY layer")
def cache_layer_union(spark, sf_dir):
    return activations.layer_union(hidden(spark, sf_dir))


@query(f"SELECT layer FROM ({HIDDEN}) WHERE sid < 5 AND layer <> 3 INTERSECT SELECT layer FROM ({HIDDEN}) WHERE sid >= 5 AND layer <> 7")
def cache_common_layers(spark, sf_dir):
    rows = hidden(spark, sf_dir)
    return activations.common_layers(rows.where("sid < 5 and layer <> 3"), rows.where("sid >= 5 and layer <> 7"))


@query("SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS layer, CAST(doc_id // 100 AS INTEGER) AS chunk, n_chars FROM documents WHERE doc_id % 4 IN (1, 2)")
def cache_store_lookup(spark, sf_dir):
    path = place(spark, "store")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), (F.col("doc_id") % 4).cast("int").alias("layer"), F.floor(F.col("doc_id") / 100).cast("int").alias("chunk"), "n_chars")
    activations.write_store(docs.where("layer <> 2").withColumn("n_chars", F.when(F.col("layer") == 1, -1).otherwise(F.col("n_chars"))), path)
    activations.append_layer(docs.where("layer in (1, 2)"), path)
    return activations.lookup(spark, path, docs.select("sid", "chunk"), [1, 2]).select(F.col("sid").alias("doc_id"), "layer", "chunk", "n_chars")


@query(f"""SELECT CAST(s AS BIGINT) AS sid, pos, CASE WHEN pos % 2 = 0 THEN 'rollout' ELSE 'cache' END AS origin, round(CASE WHEN pos % 2 = 0 THEN -v[1] ELSE v[1] END, 6) AS first
    FROM (SELECT sid AS s, pos, v FROM ({HIDDEN}) WHERE layer = 3)""")
def cache_microbatch(spark, sf_dir):
    rows = hidden(spark, sf_dir)
    rolled = rows.where("pos % 2 = 0").withColumn("vec", F.transform("vec", lambda v: -v))
    got = samples.microbatch_inputs(rows.select("sid").distinct(), rows.select("sid", "pos", "vec"), rows, rolled, 4)
    return got.select("sid", "pos", "origin", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS images, CAST((row_number() OVER (PARTITION BY source, doc_id % 3 = 0 ORDER BY n_chars DESC, doc_id) - 1) // 4 AS INTEGER) AS batch FROM documents""")
def sample_length_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return samples.length_batches(docs, "source", "n_chars", "doc_id", F.col("doc_id") % 3 == 0, 4).select("doc_id", "images", "batch")


@query(f"SELECT doc_id, CAST(least(len(ids), 200) AS BIGINT) AS n FROM (SELECT doc_id, {WORD_LENGTHS} AS ids FROM documents) WHERE doc_id % 3 > 0 OR len(ids) <= 200")
def sample_within_length(spark, sf_dir):
    return samples.within_length(word_lengths(spark, sf_dir), "ids", 200, F.col("doc_id") % 3 == 0).select("doc_id", F.size("ids").cast("long").alias("n"))


@query(f"""SELECT doc_id, CAST(CASE doc_id % 3 WHEN 2 THEN 1 ELSE least(len(ids), 500) END AS BIGINT) AS n_ids, CAST(CASE doc_id % 3 WHEN 2 THEN 0 ELSE least(len(ids), 500) END AS BIGINT) AS valid,
    CAST(CASE doc_id % 3 WHEN 0 THEN least(len(ids), 500) WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN least(len(ids), 500) // 2 ELSE least(len(ids), 3) END ELSE 0 END AS BIGINT) AS labelled FROM (SELECT doc_id, {WORD_LENGTHS} AS ids FROM documents)""")
def sample_encoding(spark, sf_dir):
    rows = word_lengths(spark, sf_dir)
    mask = F.when(F.col("doc_id") % 2 == 0, F.transform("ids", lambda _, i: i % 2))
    rows = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("ids")).alias("text_ids"), F.when(F.col("doc_id") % 3 == 1, F.col("ids")).alias("chat_ids"), mask.alias("assistant_mask"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("answer_ids"))
    got = samples.encoded(rows, 500)
    count = lambda c, keep: F.size(F.filter(c, keep)).cast("long")
    return got.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"), count("attention_mask", lambda m: m == 1).alias("valid"), count("labels", lambda v: v != samples.IGNORED).alias("labelled"))


@query("SELECT doc_id, CAST(doc_id % 5 + 18 AS BIGINT) AS n_ids, CAST(14 AS BIGINT) AS image_tokens, CAST(doc_id % 5 + 4 AS BIGINT) AS labelled FROM documents WHERE doc_id % 7 > 0 AND doc_id % 5 + 18 <= 20")
def sample_image_encoding(spark, sf_dir):
    repeat = lambda kind, n: F.array_repeat(F.lit(kind), n)
    ids = F.concat(repeat(7, (F.col("doc_id") % 5 + 1).cast("int")), repeat(9, F.lit(1)), repeat(7, F.lit(2)), repeat(9, F.lit(1)), repeat(7, F.lit(1)))
    grids = F.array(F.array(F.lit(1), F.lit(4), F.lit(6)), F.array(F.lit(2), F.lit(4), F.lit(4)))
    paths_of = F.when(F.col("doc_id") % 7 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), grids.alias("grids"), paths_of.alias("images")).withColumn("assistant_mask", F.transform("ids", lambda _: F.lit(1)))
    got = samples.image_encoded(rows, "ids", "grids", "images", 9, 8, 2, 20)
    count = lambda c, keep: F.size(F.filter(c, keep)).cast("long")
    return got.select("doc_id", F.size("image_ids").cast("long").alias("n_ids"), count("types", lambda t: t == 1).alias("image_tokens"), count("image_labels", lambda v: v != samples.IGNORED).alias("labelled"))


@query("SELECT p_partkey, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS width FROM (SELECT p_partkey, greatest(28, round_even(p_size * 17 / 28.0, 0) * 28) AS h, greatest(28, round_even(p_partkey % 900 / 28.0, 0) * 28) AS w FROM part WHERE p_partkey % 900 > 0 AND greatest(p_size * 17, p_partkey % 900) <= 200 * least(p_size * 17, p_partkey % 900)) WHERE h * w BETWEEN 784 AND 10000000")
def sample_image_size(spark, sf_dir):
    size = x.smart_size(F.col("p_size") * 17, (F.col("p_partkey") % 900).cast("int"), 28, 784, 10_000_000)
    return table(spark, sf_dir, "part").where("p_partkey % 900 > 0").select("p_partkey", size.alias("s")).where("s is not null").select("p_partkey", "s.height", "s.width")


@query(f"{PAIRS} SELECT layer, next_layer, count(*) AS samples, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS shape_mismatches FROM m GROUP BY 1, 2")
def act_pair_counts(spark, sf_dir):
    return activations.pair_counts(activations.pair_metrics(hidden(spark, sf_dir)))


@query(f"""{PAIRS}, r AS (SELECT sid * 100 + layer AS pair, round(mse, 6) AS mse FROM m) SELECT 'high' AS side, CAST(place AS INTEGER) AS place, pair, mse FROM (SELECT *, row_number() OVER (ORDER BY mse DESC, pair) AS place FROM r) WHERE place <= 5
    UNION ALL SELECT 'low', CAST(place AS INTEGER), pair, mse FROM (SELECT *, row_number() OVER (ORDER BY mse, pair) AS place FROM r) WHERE place <= 5""")
def act_extremes(spark, sf_dir):
    rows = activations.pair_metrics(hidden(spark, sf_dir)).select((F.col("sid") * 100 + F.col("layer")).alias("pair"), F.round("mse", 6).alias("mse"))
    return activations.extremes(rows, "mse", "pair")


TENSOR_PATHS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'run/layer_' || p_size || '/hidden_states' WHEN 1 THEN 'layer_3/Router_Logits' WHEN 2 THEN 'block-' || p_size || '/out' ELSE 'x/input_ids/' || p_size END AS path FROM part"


@query(f"""SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 1 THEN 3 ELSE p_size END AS INTEGER) AS layer, p_partkey % 4 = 0 AS named, p_partkey % 4 IN (0, 2) AND p_partkey % 3 > 0 AND p_size >= 16 AND (p_partkey % 3 = 1 OR p_partkey % 4 = 0) AS candidate
    FROM (SELECT p.p_partkey, p_size FROM part p)""")
def act_hidden_candidates(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    parts.createOrReplaceTempView("_parts")
    rows = spark.sql(TENSOR_PATHS.replace("FROM part", "FROM _parts")).join(parts.select("p_partkey", "p_size"), "p_partkey")
    one, four = F.array(F.col("p_size")), F.array(F.lit(2), F.lit(2), F.lit(2), F.col("p_size"))
    shape = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, F.array(F.lit(4), F.col("p_size"))).otherwise(four)
    return rows.select("p_partkey", x.layer_of_path(F.split("path", "/")).alias("layer"), activations.looks_hidden(F.col("path")).alias("named"), activations.hidden_candidate(F.col("path"), shape).alias("candidate"))


@query(f"SELECT layer, string_agg(expert, ',' ORDER BY expert) AS experts FROM ({CHOSEN}) GROUP BY layer UNION ALL SELECT label + 100, '0,1,2,3,4,5,6,7' FROM (SELECT DISTINCT label FROM embeddings)")
def router_strategies(spark, sf_dir):
    rows = logits(spark, sf_dir)
    layers = rows.select("layer").distinct()
    top = routing.resolved(layers, 64, 8, "router_top", routing.usage(rows, "logits", 4, 64))
    first = routing.resolved(layers, 64, 8, "first_n").withColumn("layer", F.col("layer") + 100)
    return top.unionByName(first).select("layer", F.array_join(F.transform("experts", lambda e: e.cast("string")), ",").alias("experts"))


@query(f"SELECT layer, expert AS old_id, CAST(row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS INTEGER) AS new_id FROM ({CHOSEN})")
def router_mapping_file(spark, sf_dir):
    chosen = routing.recommended(routing.usage(logits(spark, sf_dir), "logits", 4, 64), 8)
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("layer_"), "layer"), F.struct(F.col("experts").alias("surviving_original_ids")))))
    path = place(spark, "mapping")
    chosen.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)  # one row per layer of a model
    return files.expert_mapping(spark, path)


@query("SELECT label AS layer, CAST(i AS INTEGER) AS expert FROM (SELECT DISTINCT label FROM embeddings), range(64) r(i) EXCEPT SELECT layer, expert FROM (" + CHOSEN + ")")
def router_complement(spark, sf_dir):
    used = routing.usage(logits(spark, sf_dir), "logits", 4, 64)
    kept = routing.mapping(routing.recommended(used, 8)).withColumnRenamed("old_id", "expert")
    return matching.complement(used, kept)


@query(SIMS + "SELECT layer, '[' || string_agg(DISTINCT dropped, ',' ORDER BY dropped) || ']' AS dropped, '[' || string_agg(DISTINCT kept, ',' ORDER BY kept) || ']' AS surviving, CAST(count(*) AS BIGINT) AS pairs FROM s GROUP BY layer")
def merge_plan_json(spark, sf_dir):
    dropped, kept = experts(spark, sf_dir)
    part = lambda name: F.get_json_object("json", f"$.{name}").alias(name)
    heads = matching.merge_plan_heads(dropped, kept, 0.5).select("layer", part("dropped"), part("surviving"))
    pairs = F.sum(F.size(F.from_json("json", "kept array<long>")["kept"])).cast("long").alias("pairs")
    return heads.join(matching.merge_plan_weights(dropped, kept, 0.1).groupBy("layer").agg(pairs), "layer")


@query(MATCHES + """, g AS (SELECT layer, count(*) AS total, count(*) FILTER (hosted) AS hosted, max(guests) AS most FROM (SELECT *, count(*) FILTER (hosted) OVER (PARTITION BY layer, host, host_neuron) AS guests FROM b) GROUP BY layer)
    SELECT layer, 'few hosted' AS warning, round(hosted / total, 6) AS value FROM g WHERE hosted / total < 0.9 UNION ALL SELECT layer, 'crowded host', CAST(most AS DOUBLE) FROM g WHERE most >= 8""")
def merge_warnings(spark, sf_dir):
    stats = matching.match_stats(matching.local_matches(*neurons(spark, sf_dir), 0.2))
    return matching.merge_warnings(stats, 0.9, 8).withColumn("value", F.round("value", 6))


@query(f"SELECT CAST(p_size AS INTEGER) AS layer, max(key) AS key FROM (SELECT k.*, p_size FROM ({KEYS}) k JOIN part USING (p_partkey)) WHERE p_partkey % 8 = 2 GROUP BY p_size")
def tensor_router_keys(spark, sf_dir):
    return tensors.router_keys(keys(spark, sf_dir))


STACKS = "SELECT DISTINCT 'model.language_model.layers.' || p_size || CASE p_partkey % 3 WHEN 0 THEN '.mlp.experts.gate_up_proj' WHEN 1 THEN '.mlp.experts.down_proj' ELSE '.mlp.gate.weight' END AS key FROM part"


@query(f"""SELECT layer, max(key) FILTER (key LIKE '%gate_up_proj') AS gate_up_proj, max(key) FILTER (key LIKE '%down_proj') AS down_proj FROM (SELECT CAST(regexp_extract(key, 'layers\\.(\\d+)\\.', 1) AS INTEGER) AS layer, key FROM ({STACKS}))
    GROUP BY layer HAVING count(*) FILTER (key LIKE '%gate_up_proj') > 0 AND count(*) FILTER (key LIKE '%down_proj') > 0""")
def tensor_expert_keys(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_parts")
    return tensors.expert_keys(spark.sql(STACKS.replace("FROM part", "FROM _parts")))


@query("SELECT p_brand AS shard, string_agg('student.' || p_partkey, ',' ORDER BY 'student.' || p_partkey) AS keys, count(*) AS n FROM part GROUP BY p_brand")
def tensor_by_shard(spark, sf_dir):
    rows = tensors.prefixed(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("shard")), "student")
    return tensors.by_shard(rows).select("shard", F.array_join("keys", ",").alias("keys"), "n")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 8 NOT IN (0, 1) AND (p_partkey % 3 = 1 OR p_partkey % 3 = 2 AND p_size >= 8) THEN 'matrix' ELSE 'adam' END AS part FROM ({KEYS}) JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)")
def tensor_optimizer_part(spark, sf_dir):
    rows = keys(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    shape = F.when(F.col("p_partkey") % 3 == 0, F.array("p_size")).when(F.col("p_partkey") % 3 == 1, F.array("p_size", F.lit(64))).otherwise(F.array(F.lit(4), F.col("p_size"), F.lit(64)))
    return rows.select("p_partkey", tensors.optimizer_part(F.col("key"), shape).alias("part"))


@query("WITH p AS (SELECT CAST(floor(sum(n_chars) * 1.05) AS BIGINT) AS plain FROM documents) SELECT format, CAST(floor(plain * share) AS BIGINT) AS bytes FROM p, (VALUES ('plain', 1.0::DOUBLE), ('Q8_0', 0.53::DOUBLE), ('Q4_K_M', 0.27::DOUBLE), ('IQ1', 0.55::DOUBLE)) v(format, share)")
def tensor_export_sizes(spark, sf_dir):
    return tensors.export_sizes(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("size")), ["Q8_0", "Q4_K_M", "IQ1"])


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])[1:32]), 4) AS gate, round(list_sum(CAST(embedding AS DOUBLE[])[33:64]), 4) AS up, CAST(8 AS BIGINT) AS rows, round(CAST(embedding[9] AS DOUBLE), 6) AS second FROM embeddings")
def tensor_gate_up(spark, sf_dir):
    rows = tensors.joined_gate_up(tensors.split_gate_up(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("data"))))
    shaped = x.reshaped(F.col("data").cast("array<double>"), 8)
    return rows.select("vec_id", F.round(x.total(F.col("gate")), 4).alias("gate"), F.round(x.total(F.col("up")), 4).alias("up"), F.size(shaped).cast("long").alias("rows"), F.round(shaped[1][0], 6).alias("second"))


@query("SELECT 'part' || p_partkey AS key, CAST(floor(coalesce(sum(p_size * 64) OVER (ORDER BY 'part' || p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000) AS INTEGER) AS shard FROM part")
def tensor_rewrite_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("key"), (F.col("p_size") * 64).cast("long").alias("bytes"))
    return sinks.rewrite_shards(rows, place(spark, "shards"), 20_000)


@query("SELECT event_id // 4 AS step, round(sum(value) / 4, 6) AS value FROM events GROUP BY 1")
def metric_micro_steps(spark, sf_dir):
    return metrics.accumulated(table(spark, sf_dir, "events"), "event_id", ["value"], 4).select("step", F.round("value", 6).alias("value"))


@query(f"SELECT a.layer, count(*) AS tokens, round(avg(list_dot_product(a.v, b.v)), 6) AS dot FROM ({HIDDEN}) a JOIN ({HIDDEN}) b ON a.sid = b.sid + 1 AND a.layer = b.layer AND a.pos = b.pos GROUP BY a.layer")
def metric_layer_pairs(spark, sf_dir):
    rows = hidden(spark, sf_dir)
    both = metrics.layer_pairs(rows, rows.withColumn("sid", F.col("sid") + 1))
    return both.groupBy("layer").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.avg(x.dot(F.col("s"), F.col("t"))), 6).alias("dot"))


@query("SELECT doc_id, source, lang, CAST(length(text) AS BIGINT) AS n FROM documents")
def io_corpus_lines(spark, sf_dir):
    path = place(spark, "corpus")
    sinks.write_corpus(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.lit(1).alias("_n_tok")), path)
    return files.read_samples(spark, path, "doc_id long, source string, lang string, text string").select("doc_id", "source", "lang", F.length("text").cast("long").alias("n"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS key, r_name AS name, CAST(NULL AS VARCHAR) AS nation FROM region UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL, n_name FROM nation")
def io_csv_report(spark, sf_dir):
    path = place(spark, "report")
    parts = [table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation"))]
    sinks.write_report(parts, path)
    return spark.read.option("header", "true").csv(path).select("key", "name", "nation")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, with a time that watermarks take."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives until its source has no more, as a table."""
    spark, path = df.sparkSession, place(df.sparkSession, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    found = streams.windowed(stream(spark, sf_dir), "ts", "1 hour", "1 day", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return drained(found, "windows", "complete").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "value")


@query("SELECT event_type, event_id, value FROM (SELECT *, coalesce(sum(CAST(floor(abs(value)) AS BIGINT) + 1) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b < 3000")
def stream_quota(spark, sf_dir):
    rows = stream(spark, sf_dir).withColumn("n", (F.floor(F.abs("value")) + 1).cast("long")).withColumn("id", F.col("event_id"))
    kept = drained(streams.quota_stream(rows, "event_type", "id", "n", 3000), "quota")
    return table(spark, sf_dir, "events").join(kept.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_type", "event_id", "value")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    return drained(streams.first_seen(stream(spark, sf_dir), "user_id", "ts", "60 days").select("user_id"), "seen")


@query("SELECT event_id, event_type, value FROM events")
def stream_missing_only(spark, sf_dir):
    path = place(spark, "table")
    rows = stream(spark, sf_dir).select("event_id", "event_type", "value")
    for i in range(2):  # the second run finds nothing to add
        running = streams.write_missing(rows, "event_id", path, f"{path}-checkpoint-{i}")
        running.processAllAvailable()
        running.stop()
    return spark.read.parquet(path)
