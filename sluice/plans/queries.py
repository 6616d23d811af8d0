"""The registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import expressions as x
from sluice.operators import activations, corpus, matching, metrics, routing, samples, tensors, transforms
from sluice.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EDGES = [1, 256, 512, 1024, 2048]
N_TOK = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text records with their token count and duplicate key."""
    docs = transforms.apply("plain_text", table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", x.token_count(F.col("text")).alias("n_tok"), corpus.content_key(F.col("text")).alias("h"), "text")


STRIPPED = "SELECT doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"
COUNTED = f"SELECT doc_id, source, {N_TOK} AS n_tok, sha1(substr(text, 1, 256)) AS h, text FROM ({STRIPPED})"


@query(f"SELECT doc_id, source, CAST(n_tok AS BIGINT) AS n_tok, CAST(length(text) AS BIGINT) AS n_chars FROM ({COUNTED}) WHERE n_tok BETWEEN 1 AND 1024")
def corpus_plain_text(spark, sf_dir):
    rows = corpus.length_capped(counted(spark, sf_dir), "n_tok", 1024)
    return rows.select("doc_id", "source", "n_tok", F.length("text").cast("long").alias("n_chars"))


@query("SELECT doc_id, sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.quality IS NULL OR l.quality >= 0.85) AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''")
def corpus_quality_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("language_score")), "doc_id", "left")
    return transforms.apply("scored_text", rows).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"))


TURNS = """
    SELECT conv_id, turn, CASE WHEN role IN ('human', 'user') THEN 'user' WHEN role IN ('gpt', 'assistant', 'bot') THEN 'assistant' WHEN role = 'system' THEN 'system' END AS r,
           regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS c FROM conversations
"""
CHATS = f"""
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, md5(string_agg(r || ':' || c, '|' ORDER BY turn)) AS digest
    FROM ({TURNS}) WHERE r IS NOT NULL AND c <> '' GROUP BY conv_id HAVING count(*) FILTER (r = 'assistant') > 0
"""


def chat_digest(df: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return df.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(said.cast("binary")).alias("digest"))


@query(CHATS)
def corpus_messages_normalise(spark, sf_dir):
    rows = transforms.grouped_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return chat_digest(rows.where("messages is not null"))


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query(CHATS)
def corpus_messages_nested(spark, sf_dir):
    return chat_digest(transforms.apply("messages", nested(spark, sf_dir), messages_field="turns"))


@query(CHATS)
def corpus_sharegpt_json(spark, sf_dir):
    raw = F.to_json(F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value"))))
    rows = nested(spark, sf_dir).select("conv_id", raw.alias("conversations"))
    # the quotes inside these texts would become JSON quotes, so they are taken out on both sides
    return chat_digest(transforms.apply("sharegpt", rows))


@query(f"""
    WITH p AS (SELECT conv_id, turn // 2 AS pair, max(CASE WHEN r = 'user' THEN c END) AS u, max(CASE WHEN r = 'assistant' THEN c END) AS a FROM ({TURNS}) GROUP BY 1, 2)
    SELECT conv_id, CAST(count(u) + count(a) AS BIGINT) AS n_messages, md5(string_agg(concat_ws('|', 'user:' || u, 'assistant:' || a), '|' ORDER BY pair)) AS digest
    FROM p WHERE u <> '' OR a <> '' GROUP BY conv_id HAVING count(a) > 0
""")
def corpus_human_assistant(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    pairs = turns.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("human"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("assistant"))
    rows = pairs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pair", "human", "assistant"))).alias("conversations"))
    return chat_digest(transforms.apply("human_assistant", rows))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_brand AS user_text, p_type AS assistant_text FROM part WHERE p_name <> '' AND p_type <> ''")
def corpus_instruction_io(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("instruction"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.col("p_brand").alias("context"))
    return transforms.apply("instruction", rows).select("p_partkey", F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"))


@query("""
    SELECT p_partkey, p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || CAST(p_size AS VARCHAR) || chr(10) || chr(10) || 'Answer with the letter only.' AS user_text,
           substr('ABC', CAST(p_partkey % 4 AS INTEGER) + 1, 1) AS assistant_text
    FROM part WHERE p_partkey % 4 < 3
""")
def corpus_multiple_choice(spark, sf_dir):
    choices = F.array("p_brand", "p_type", F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), choices.alias("choices"), (F.col("p_partkey") % 4).alias("answer"))
    return transforms.apply("multiple_choice", rows).select("p_partkey", F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"))


@query("""
    SELECT p_partkey, 'Choose the ending that best continues the passage.' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || chr(10) || 'Answer with the letter only.' AS user_text,
           substr('AB', CAST(p_size % 5 AS INTEGER) + 1, 1) AS assistant_text
    FROM part WHERE p_size % 5 < 2
""")
def corpus_best_ending(spark, sf_dir):
    label = F.when(F.col("p_size") % 5 == 4, "none").otherwise((F.col("p_size") % 5).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("ctx"), F.array("p_brand", "p_type").alias("endings"), label.alias("label"))
    return transforms.apply("best_ending", rows).select("p_partkey", F.col("messages")[0]["content"].alias("user_text"), F.col("messages")[1]["content"].alias("assistant_text"))


@query(f"""
    WITH t AS (SELECT conv_id, turn, r, c FROM ({TURNS}) WHERE c <> ''),
    s AS (SELECT conv_id, min_by(c, turn) AS c FROM t WHERE r = 'system' GROUP BY 1),
    a AS (SELECT conv_id, turn, r || ':' || c AS m, r FROM t WHERE r <> 'system' UNION ALL SELECT conv_id, -1, 'system:' || c, 'system' FROM s)
    SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, md5(string_agg(m, '|' ORDER BY turn)) AS digest FROM a GROUP BY 1 HAVING count(*) FILTER (r = 'assistant') > 0
""")
def corpus_glaive_split(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "user", F.concat(F.lit("USER: "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("ASSISTANT: "), "text", F.lit(" <|endoftext|>")))
    chat = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(said.isNotNull(), F.struct("turn", said.alias("s"))))), lambda t: t["s"]), "\n\n\n")
    rows = turns.groupBy("conv_id").agg(chat.alias("chat"), F.concat(F.lit("SYSTEM: "), F.min_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", F.col("turn")))).alias("system"))
    return chat_digest(transforms.apply("marked_chat", rows))


@query("""
    SELECT event_id, 'You have access to the following tools:' || chr(10) || '[' || props || ']' AS system_text, '[' || props || ']' AS assistant_text FROM events WHERE event_id % 3 > 0
""")
def corpus_function_call(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("query"), F.concat(F.lit("["), "props", F.lit("]")).alias("tools"), F.col("props").alias("p"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise("{").alias("answers"))
    return transforms.apply("function_call", rows).select("event_id", F.col("messages")[0]["content"].alias("system_text"), F.col("messages")[2]["content"].alias("assistant_text"))


@query("""
    SELECT doc_id, 'file://img/' || lang || '.png' AS image, lang || '?' AS question, source AS answer, CAST(2 AS BIGINT) AS n_blocks FROM documents WHERE doc_id % 3 > 0
""")
def corpus_image_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    qa = F.array(F.struct(F.concat(F.lit(" "), "lang", F.lit("? ")).alias("user"), F.col("source").alias("assistant")))
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.array(F.concat(F.lit("img/"), "lang", F.lit(".png")))).otherwise(F.array().cast("array<string>")).alias("images"), qa.alias("texts"))
    rows = transforms.resolve_images(transforms.apply("image_pairs", rows))
    blocks = F.col("messages")[0]["blocks"]
    return rows.select("doc_id", blocks[0]["image"].alias("image"), blocks[1]["text"].alias("question"), F.col("messages")[1]["content"].alias("answer"), F.size(blocks).cast("long").alias("n_blocks"))


BUCKET = "CASE WHEN n_tok <= 256 THEN 0 WHEN n_tok <= 512 THEN 1 WHEN n_tok <= 1024 THEN 2 WHEN n_tok <= 2048 THEN 3 END"


@query(f"SELECT CAST({BUCKET} AS INTEGER) AS bucket, count(*) AS samples, CAST(sum(n_tok) AS BIGINT) AS tokens FROM ({COUNTED}) WHERE n_tok <= 2048 GROUP BY 1")
def corpus_bucket_profile(spark, sf_dir):
    return corpus.bucket_profile(counted(spark, sf_dir), "n_tok", EDGES)


@query(f"SELECT min(doc_id) AS doc_id, h FROM ({COUNTED}) GROUP BY h")
def corpus_prefix_dedup(spark, sf_dir):
    return corpus.first_of_each(counted(spark, sf_dir).select("doc_id", "h"), "h", ["doc_id"])


@query(f"SELECT doc_id, source, CAST(n_tok AS BIGINT) AS n_tok FROM (SELECT *, coalesce(sum(n_tok) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({COUNTED})) WHERE b < 2000")
def corpus_token_quota(spark, sf_dir):
    return corpus.quota_cut(counted(spark, sf_dir).select("doc_id", "source", "n_tok"), "source", "doc_id", "n_tok", 2000)


SOURCES = [(f"src{i}", 5000) for i in range(20)]


def chain_sql() -> str:
    """One step a source: first row of each unseen key, cut at the quota."""
    steps = [f"c AS MATERIALIZED (SELECT doc_id, source, n_tok, h FROM ({COUNTED}) WHERE n_tok BETWEEN 1 AND 1024)"]
    for i, (source, quota) in enumerate(SOURCES):
        unseen = "".join(f" AND h NOT IN (SELECT h FROM s{j})" for j in range(i))
        first = f"SELECT * FROM c WHERE source = '{source}'{unseen} QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1"
        steps.append(f"s{i} AS MATERIALIZED (SELECT doc_id, source, n_tok, h FROM (SELECT *, coalesce(sum(n_tok) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({first})) WHERE b < {quota})")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT doc_id, source, CAST(n_tok AS BIGINT) AS n_tok FROM s{i}" for i in range(len(SOURCES)))


@query(chain_sql())
def corpus_dedup_quota_chain(spark, sf_dir):
    rows = corpus.written(corpus.length_capped(counted(spark, sf_dir), "n_tok", 1024).select("doc_id", "source", "n_tok", "h"))
    return corpus.harvest(rows, SOURCES, "doc_id", "n_tok", "h").select("doc_id", "source", "n_tok")


PLACE = "CASE WHEN n_tok <= 256 THEN 1 WHEN n_tok <= 512 THEN 2 WHEN n_tok <= 1024 THEN 3 WHEN n_tok <= 2048 THEN 4 END"


@query(f"""
    WITH RECURSIVE o AS (SELECT source, doc_id, n_tok, {PLACE} AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM ({COUNTED})),
    f AS (SELECT source, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS n_tok, false AS keep, [CAST(0 AS BIGINT), 0, 0, 0] AS t, CAST(0 AS BIGINT) AS used FROM o GROUP BY source
          UNION ALL
          SELECT source, r, doc_id, n_tok, keep, CASE WHEN keep THEN list_transform(t, lambda x, i: CASE WHEN i = b THEN x + n_tok ELSE x END) ELSE t END, CASE WHEN keep THEN used + n_tok ELSE used END
          FROM (SELECT o.source, o.r, o.doc_id, CAST(o.n_tok AS BIGINT) AS n_tok, o.b, f.t, f.used,
                       f.used < 10000 AND o.n_tok > 0 AND o.b IS NOT NULL AND (f.t[o.b] <= 3750 OR (list_min(f.t) = 0 AND list_max(f.t) >= 10000) OR list_min(f.t) > 3750) AS keep
                FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1))
    SELECT source, doc_id, n_tok FROM f WHERE keep
""")
def corpus_bucket_balance(spark, sf_dir):
    return corpus.balanced(counted(spark, sf_dir).select("source", "doc_id", "n_tok"), "source", "doc_id", "n_tok", 10_000, EDGES)


@query("""
    WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, lang FROM documents),
    f AS (SELECT source, min(CASE WHEN lang = 'xx' OR source = 'src1' THEN ordinal END) AS first_accepted FROM r GROUP BY 1)
    SELECT source, CAST(first_accepted AS BIGINT) AS first_accepted, coalesce(first_accepted > 2000, true) AS gave_up FROM f
""")
def corpus_dud_source(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "documents").select("source", "lang", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("ordinal"))
    return corpus.gave_up(rows, "source", "ordinal", (F.col("lang") == "xx") | (F.col("source") == "src1"), 5000)


@query(f"SELECT coalesce(source, 'TOTAL') AS source, count(*) AS samples, CAST(sum(n_tok) AS BIGINT) AS tokens FROM ({COUNTED}) GROUP BY ROLLUP (source)")
def corpus_source_report(spark, sf_dir):
    return corpus.source_report(counted(spark, sf_dir), "n_tok")


@query("SELECT doc_id, source, format('sample_{:06d}', row_number() OVER (ORDER BY sha1('17|' || source || '|' || doc_id), source, doc_id) - 1) AS id FROM documents")
def corpus_ids(spark, sf_dir):
    return corpus.shuffled_ids(table(spark, sf_dir, "documents").select("source", "doc_id"), 17, "sample", "source", "doc_id")


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 50 > 0 THEN 'sample_' || doc_id END AS id, CASE WHEN doc_id % 7 > 0 THEN text WHEN doc_id % 2 = 0 THEN '' END AS text, doc_id % 11 = 0 AS chat, doc_id % 22 = 0 AS bad, doc_id % 26 = 0 AS broken FROM documents)
    SELECT doc_id, CASE WHEN id IS NULL THEN 'missing id' WHEN coalesce(text, '') = '' AND NOT chat THEN 'neither text nor messages' WHEN coalesce(text, '') <> '' AND chat THEN 'both text and messages'
           WHEN chat AND bad THEN 'message without role or content' WHEN broken THEN 'image without path' END AS error FROM s
""")
def sample_validation(spark, sf_dir):
    chat = F.array(F.struct(F.when(F.col("doc_id") % 22 > 0, "user").alias("role"), F.col("lang").alias("content")))
    text = F.when(F.col("doc_id") % 7 > 0, F.col("text")).when(F.col("doc_id") % 2 == 0, "")
    images = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit("a.png"), F.when(F.col("doc_id") % 26 > 0, "b.png")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 50 > 0, F.concat(F.lit("sample_"), "doc_id")).alias("id"), text.alias("text"), F.when(F.col("doc_id") % 11 == 0, chat).alias("messages"), images.alias("images"))
    return samples.violations(rows).select("doc_id", "error")


@query("SELECT sha256(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def sample_duplicate_ids(spark, sf_dir):
    return samples.duplicate_ids(table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("id")))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha1(format('sample_{:06d}', doc_id)), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def sample_holdout(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.format_string("sample_%06d", "doc_id").alias("id"))
    return samples.split(rows, "id", 0.1).select("doc_id", "split")


@query("SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 64 AS INTEGER) AS chunk FROM embeddings")
def sample_chunk_assign(spark, sf_dir):
    return activations.with_chunks(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)


WORD_LENGTHS = "list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), lambda w: CAST(length(w) AS INTEGER))"


def word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the lengths of their words as stand-in for token ids."""
    words = F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(words, lambda w: F.length(w)).alias("ids"))


@query(f"""
    WITH d AS (SELECT doc_id, source, {WORD_LENGTHS} AS ids, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS INTEGER) AS batch FROM documents),
    m AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY source, batch) / 4.0) * 4 AS INTEGER) AS n FROM d)
    SELECT doc_id, batch, array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: 0)), ' ') AS ids,
           array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda i: -100)), ' ') AS labels, CAST(len(ids) AS BIGINT) AS valid FROM m
""")
def sample_batch_pad(spark, sf_dir):
    rows = samples.batches(word_lengths(spark, sf_dir), F.col("doc_id"), 8, "source")
    rows = samples.padded(rows, ["source", "batch"], "ids", multiple=4)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return rows.select("doc_id", "batch", text("ids").alias("ids"), text("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0), lambda a, v: a + v).cast("long").alias("valid"))


@query("SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 4 AS INTEGER) AS batch FROM documents")
def sample_length_sorted_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.struct((-F.col("n_chars")).alias("l"), "doc_id").alias("o"))
    return samples.batches(rows, F.col("o"), 4, "source").select("doc_id", "source", "batch")


@query(f"SELECT doc_id, array_to_string(list_transform(ids, lambda v, i: CASE WHEN i % 2 = 0 THEN v ELSE -100 END), ' ') AS labels, array_to_string(list_transform(ids, lambda v, i: CASE WHEN i > len(ids) - 3 THEN v ELSE -100 END), ' ') AS tail FROM (SELECT doc_id, {WORD_LENGTHS} AS ids FROM documents)")
def sample_label_mask(spark, sf_dir):
    rows = word_lengths(spark, sf_dir)
    mask = F.transform("ids", lambda _, i: i % 2)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return rows.select("doc_id", text(samples.masked_labels(F.col("ids"), mask)).alias("labels"), text(samples.tail_labels(F.col("ids"), F.lit(3))).alias("tail"))


@query("""
    WITH s AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INTEGER) AS a FROM documents),
    t AS (
        SELECT doc_id, i AS pos, i AS t, i AS h, i AS w FROM s, unnest(range(a)) u(i)
        UNION ALL SELECT doc_id, a + i, a, a + i // 3, a + i % 3 FROM s, unnest(range(6)) u(i)
        UNION ALL SELECT doc_id, a + 6 + i, a + 3 + i, a + 3 + i, a + 3 + i FROM s, unnest(range(2)) u(i)
        UNION ALL SELECT doc_id, a + 8 + i, a + 5 + i // 4, a + 5 + (i // 2) % 2, a + 5 + i % 2 FROM s, unnest(range(8)) u(i)
        UNION ALL SELECT doc_id, a + 16, a + 7, a + 7, a + 7 FROM s
    )
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(t AS INTEGER) AS t, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w FROM t
""")
def sample_positions_3d(spark, sf_dir):
    repeat = lambda kind, n: F.array_repeat(F.lit(kind), n)
    ids = F.concat(repeat(7, (F.col("doc_id") % 5 + 1).cast("int")), repeat(9, F.lit(1)), repeat(7, F.lit(2)), repeat(9, F.lit(1)), repeat(7, F.lit(1)))
    grids = F.array(F.array(F.lit(1), F.lit(4), F.lit(6)), F.array(F.lit(2), F.lit(4), F.lit(4)))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"), grids.alias("grids"))
    rows = rows.withColumn("ids", samples.expanded(F.col("ids"), F.col("grids"), 9, 2)).withColumn("types", samples.token_types(F.col("ids"), 9, 8))
    return samples.positions_3d(rows, "doc_id", "types", "grids", 2)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def cache_semi_join(spark, sf_dir):
    return activations.present(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_anti_join(spark, sf_dir):
    return activations.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def cache_latest_rollout(spark, sf_dir):
    return activations.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""
    SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS block_id, CAST(lag(label, 1, -1) OVER (ORDER BY label) AS INTEGER) AS input_layer, label AS output_layer,
           CAST(label - lag(label, 1, -1) OVER (ORDER BY label) AS INTEGER) AS n_layers FROM (SELECT DISTINCT label FROM embeddings WHERE label % 3 = 0)
""")
def cache_blocks(spark, sf_dir):
    layers = table(spark, sf_dir, "embeddings").where("label % 3 = 0").select(F.col("label").alias("layer"))
    return activations.layer_blocks(layers).select("block_id", "input_layer", "output_layer", F.size("layer_indices").alias("n_layers"))


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as activations: label is the layer, ten samples, position by vec_id."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("sid"), F.col("label").alias("layer"), "vec_id", F.col("embedding").alias("vec"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("sid", "layer").orderBy("vec_id")))


HIDDEN = "SELECT vec_id % 10 AS sid, label AS layer, row_number() OVER (PARTITION BY vec_id % 10, label ORDER BY vec_id) AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
PAIRS = f"""
    WITH h AS ({HIDDEN}), l AS (SELECT layer, lead(layer) OVER (ORDER BY layer) AS next_layer FROM (SELECT DISTINCT layer FROM h)),
    k AS (SELECT a.sid, a.layer, b.layer AS next_layer, list_dot_product(a.v, a.v) AS aa, list_dot_product(b.v, b.v) AS bb, list_dot_product(a.v, b.v) AS ab,
                 list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[2] - z[1]) * (z[2] - z[1]))) AS dd, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[2] - z[1]))) AS l1,
                 list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[2] - z[1]))) AS far
          FROM h a JOIN l ON a.layer = l.layer JOIN h b ON b.layer = l.next_layer AND b.sid = a.sid AND b.pos = a.pos),
    t AS (SELECT *, ab / (greatest(sqrt(aa), 1e-8) * greatest(sqrt(bb), 1e-8)) AS tc, sqrt(dd) AS td FROM k),
    m AS (SELECT sid, layer, next_layer, sqrt(sum(aa)) AS a_norm, sqrt(sum(dd)) AS delta_norm, sum(ab) / (sqrt(sum(aa)) * sqrt(sum(bb))) AS cosine_similarity, sum(dd) / (count(*) * 64) AS mse, sum(l1) / (count(*) * 64) AS mae,
                 max(far) AS max_abs_diff, list_sort(list(td)) AS tds, list_sort(list(tc)) AS tcs FROM t GROUP BY 1, 2, 3)
"""
RANK = "[CAST(round_even({q} * (len({v}) - 1), 0) AS BIGINT) + 1]"


@query(f"""{PAIRS} SELECT sid, layer, next_layer, round(a_norm, 6) AS a_norm, round(delta_norm, 6) AS delta_norm, round(delta_norm / a_norm, 6) AS relative, round(cosine_similarity, 6) AS cosine, round(mse, 6) AS mse, round(mae, 6) AS mae,
    round(max_abs_diff, 6) AS max_abs, round(tds{RANK.format(q=0.9, v='tds')}, 6) AS delta_p90, round(tcs{RANK.format(q=0.05, v='tcs')}, 6) AS cos_p05, round(tcs[1], 6) AS cos_min FROM m""")
def act_pair_metrics(spark, sf_dir):
    m = activations.pair_metrics(hidden(spark, sf_dir))
    names = {"a_norm": "a_norm", "delta_norm": "delta_norm", "relative_delta_vs_a": "relative", "cosine_similarity": "cosine", "mse": "mse", "mae": "mae", "max_abs_diff": "max_abs", "token_delta_norm_p90": "delta_p90", "token_cosine_p05": "cos_p05", "token_cosine_min": "cos_min"}
    return m.select("sid", "layer", "next_layer", *(F.round(c, 6).alias(n) for c, n in names.items()))


@query(f"""{PAIRS} SELECT layer, next_layer, count(*) AS samples, round(avg(mse), 6) AS mean, round(coalesce(stddev_samp(mse), 0), 6) AS std, round(min(mse), 6) AS least, round(list_sort(list(mse)){RANK.format(q=0.5, v='list(mse)')}, 6) AS p50,
    round(list_sort(list(mse)){RANK.format(q=0.9, v='list(mse)')}, 6) AS p90, round(list_sort(list(mse)){RANK.format(q=0.95, v='list(mse)')}, 6) AS p95, round(list_sort(list(mse)){RANK.format(q=0.99, v='list(mse)')}, 6) AS p99,
    round(max(mse), 6) AS most FROM m GROUP BY 1, 2""")
def act_pair_summary(spark, sf_dir):
    s = activations.summary(activations.pair_metrics(hidden(spark, sf_dir)), ["layer", "next_layer"], ["mse"])
    names = {"mse_mean": "mean", "mse_std": "std", "mse_min": "least", "mse_p50": "p50", "mse_p90": "p90", "mse_p95": "p95", "mse_p99": "p99", "mse_max": "most"}
    return s.select("layer", "next_layer", "samples", *(F.round(c, 6).alias(n) for c, n in names.items()))


@query(f"""{PAIRS} SELECT sid, layer, rule, round(value, 6) AS value FROM (
    SELECT sid, layer, 'low cosine' AS rule, cosine_similarity AS value FROM m WHERE cosine_similarity < 0.5 UNION ALL SELECT sid, layer, 'large relative delta', delta_norm / a_norm FROM m WHERE delta_norm / a_norm > 1
    UNION ALL SELECT sid, layer, 'large mse', mse FROM m WHERE mse > 1)""")
def act_anomalies(spark, sf_dir):
    return activations.anomalies(activations.pair_metrics(hidden(spark, sf_dir)), ["sid", "layer"]).withColumn("value", F.round("value", 6))


TOP4 = "SELECT label AS layer, vec_id, unnest(list_transform(list_sort(list_transform(embedding, lambda v, i: {'v': -CAST(v AS DOUBLE), 'i': i - 1}))[1:4], lambda s: CAST(s.i AS INTEGER))) AS expert FROM embeddings"
USAGE = f"SELECT l.layer, CAST(e.i AS INTEGER) AS expert, count(t.vec_id) AS cnt FROM (SELECT DISTINCT label AS layer FROM embeddings) l CROSS JOIN range(64) e(i) LEFT JOIN ({TOP4}) t ON t.layer = l.layer AND t.expert = e.i GROUP BY 1, 2"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("layer"), F.col("embedding").alias("logits"))


@query(USAGE)
def router_topk_counts(spark, sf_dir):
    return routing.usage(logits(spark, sf_dir), "logits", 4, 64)


CHOSEN = f"SELECT layer, expert FROM ({USAGE}) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY cnt DESC, expert) <= 8"


@query(f"SELECT layer, string_agg(expert, ',' ORDER BY expert) AS experts FROM ({CHOSEN}) GROUP BY layer")
def router_recommended(spark, sf_dir):
    chosen = routing.recommended(routing.usage(logits(spark, sf_dir), "logits", 4, 64), 8)
    return chosen.select("layer", F.array_join(F.transform("experts", lambda e: e.cast("string")), ",").alias("experts"))


@query(f"SELECT layer, expert AS old_id, CAST(row_number() OVER (PARTITION BY layer ORDER BY expert) - 1 AS INTEGER) AS new_id FROM ({CHOSEN})")
def router_expert_mapping(spark, sf_dir):
    return routing.mapping(routing.recommended(routing.usage(logits(spark, sf_dir), "logits", 4, 64), 8))


@query(f"SELECT a.layer, a.expert AS a, b.expert AS b, count(*) AS cnt FROM ({TOP4}) a JOIN ({TOP4}) b ON a.vec_id = b.vec_id AND a.layer = b.layer AND a.expert < b.expert GROUP BY 1, 2, 3")
def router_cooccurrence(spark, sf_dir):
    return routing.cooccurrence(logits(spark, sf_dir), "logits", 4)


SOFT = "WITH e AS (SELECT vec_id, label AS layer, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT *, list_transform(v, lambda y: exp((y - list_max(v)) / {t})) AS r FROM e), p AS (SELECT *, list_transform(r, lambda y: y / list_sum(r)) AS p FROM x) "


@query(SOFT.format(t=1) + "SELECT round(avg(h), 6) AS entropy, round(avg(g), 6) AS removed FROM (SELECT layer, avg(-list_sum(list_transform(p, lambda y: y * ln(greatest(y, 1e-9))))) AS h, avg(1 - list_sum(p[1:48])) AS g FROM p GROUP BY layer)")
def router_entropy(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumns({"entropy": routing.entropy(F.col("logits")), "removed": routing.removed_mass(F.col("logits"), range(48))})
    return routing.layer_mean(rows, "entropy").join(routing.layer_mean(rows, "removed")).select(F.round("entropy", 6).alias("entropy"), F.round("removed", 6).alias("removed"))


@query("""
    WITH e AS (SELECT vec_id, label AS layer, CAST(embedding AS DOUBLE[])[1:32] AS t, CAST(embedding AS DOUBLE[])[33:64] AS s FROM embeddings),
    x AS (SELECT layer, list_transform(t, lambda y: exp((y - list_max(t)) / 2)) AS t, list_transform(s, lambda y: exp((y - list_max(s)) / 2)) AS s FROM e),
    p AS (SELECT layer, list_transform(t, lambda y: y / list_sum(t)) AS p, list_transform(s, lambda y: y / list_sum(s)) AS q FROM x)
    SELECT round(4 * avg(kl), 6) AS kl FROM (SELECT layer, avg(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * (ln(greatest(z[1], 1e-9)) - ln(z[2]))))) AS kl FROM p GROUP BY layer)
""")
def router_kl(spark, sf_dir):
    rows = logits(spark, sf_dir)
    teacher, student = routing.gathered(F.col("logits"), range(32)), F.slice("logits", 33, 32)
    rows = rows.withColumn("kl", routing.divergence(student, teacher, 2.0))
    return routing.layer_mean(rows, "kl").select(F.round(F.col("kl") * 4, 6).alias("kl"))


EXPERTS = "SELECT label AS layer, CAST(vec_id AS BIGINT) AS expert, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
SIMS = f"""
    WITH x AS ({EXPERTS}), s AS (SELECT d.layer, d.expert AS dropped, k.expert AS kept, list_dot_product(d.v, k.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(k.v, k.v))) AS sim
    FROM x d JOIN x k ON d.layer = k.layer WHERE d.expert % 2 = 1 AND k.expert % 2 = 0)
"""


def experts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as experts of their label's layer: odd ids dropped, even ids kept."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("expert"), F.col("embedding").alias("vec"))
    return rows.where("expert % 2 = 1"), rows.where("expert % 2 = 0")


@query(SIMS + "SELECT layer, dropped, kept, round(sim, 6) AS sim, round(exp((sim - max(sim) OVER w) / 0.1) / sum(exp(sim / 0.1)) OVER w * exp(max(sim) OVER w / 0.1), 6) AS w FROM s WINDOW w AS (PARTITION BY layer, dropped)")
def merge_cosine_weights(spark, sf_dir):
    sims = matching.softmax_weights(matching.similarities(*experts(spark, sf_dir)), 0.1)
    return sims.select("layer", "dropped", "kept", F.round("sim", 6).alias("sim"), F.round("w", 6).alias("w"))


@query(f"SELECT layer, expert, cnt, round(CASE WHEN avg(cnt) OVER (PARTITION BY layer) <= 0 THEN 1 ELSE cnt / avg(cnt) OVER (PARTITION BY layer) END, 6) AS scale FROM ({USAGE}) WHERE expert % 3 = 0")
def merge_alpha_scale(spark, sf_dir):
    usage = routing.usage(logits(spark, sf_dir), "logits", 4, 64)
    return matching.alpha_scale(usage, usage.where("expert % 3 = 0").select("layer", "expert")).withColumn("scale", F.round("scale", 6))


def neurons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each expert's vector as four unit neurons of 16 elements; hosts by whole-expert similarity."""
    dropped, kept = experts(spark, sf_dir)

    unit = lambda i: x.bound(F.slice("vec", F.lit(1 + 16 * i), F.lit(16)), x.unit)
    cut = lambda d: d.select("layer", "expert", F.posexplode(F.array(*map(unit, range(4)))).alias("neuron", "vec"))
    return cut(dropped), cut(kept), matching.hosts(matching.similarities(dropped, kept))


MATCHES = SIMS + """, h AS (SELECT layer, dropped, max_by(kept, (sim, -kept)) AS host FROM s GROUP BY 1, 2),
    n AS (SELECT layer, expert, CAST(i AS INTEGER) AS neuron, v[1 + 16 * i : 16 + 16 * i] AS v FROM x, unnest(range(4)) u(i)),
    c AS (SELECT d.layer, d.expert AS dropped, d.neuron, h.host, k.neuron AS host_neuron, list_dot_product(d.v, k.v) / (sqrt(list_dot_product(d.v, d.v)) * sqrt(list_dot_product(k.v, k.v))) AS sim
          FROM n d JOIN h ON h.layer = d.layer AND h.dropped = d.expert JOIN n k ON k.layer = d.layer AND k.expert = h.host),
    b AS (SELECT layer, dropped, neuron, host, max_by(host_neuron, (sim, -host_neuron)) AS host_neuron, max(sim) AS sim, max(sim) >= 0.2 AS hosted FROM c GROUP BY 1, 2, 3, 4)
"""


@query(MATCHES + "SELECT layer, dropped, neuron, host, host_neuron, round(sim, 6) AS sim, hosted FROM b")
def merge_local_match(spark, sf_dir):
    return matching.local_matches(*neurons(spark, sf_dir), 0.2).withColumn("sim", F.round("sim", 6))


@query(MATCHES + """SELECT n.layer, CAST(least(coalesce(g.guests, 0), 4) AS INTEGER) AS load, count(*) AS n FROM n LEFT JOIN (SELECT layer, host, host_neuron, count(*) AS guests FROM b WHERE hosted GROUP BY 1, 2, 3) g
    ON g.layer = n.layer AND g.host = n.expert AND g.host_neuron = n.neuron WHERE n.expert % 2 = 0 GROUP BY 1, 2""")
def merge_host_load_histogram(spark, sf_dir):
    dropped, kept, host = neurons(spark, sf_dir)
    places = kept.select("layer", F.col("expert").alias("host"), F.col("neuron").alias("host_neuron"))
    return matching.load_histogram(matching.local_matches(dropped, kept, host, 0.2), places)


@query(MATCHES + "SELECT layer, count(*) AS total, count(*) FILTER (hosted) AS hosted, count(*) FILTER (NOT hosted) AS below, round(coalesce(avg(sim) FILTER (hosted), 0), 6) AS sim_mean, round(coalesce(quantile_cont(sim, 0.1) FILTER (hosted), 0), 6) AS sim_p10, round(coalesce(quantile_cont(sim, 0.9) FILTER (hosted), 0), 6) AS sim_p90, coalesce(max(guests), 0) AS max_load FROM (SELECT *, count(*) FILTER (hosted) OVER (PARTITION BY layer, host, host_neuron) AS guests FROM b) GROUP BY layer")
def merge_stats(spark, sf_dir):
    stats = matching.match_stats(matching.local_matches(*neurons(spark, sf_dir), 0.2))
    return stats.withColumns({c: F.round(c, 6) for c in ("sim_mean", "sim_p10", "sim_p90")})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped, kept, _ = neurons(spark, sf_dir)
    d = dropped.select((F.col("expert") * 4 + F.col("neuron")).alias("row"), "vec")
    k = kept.select((F.col("expert") * 4 + F.col("neuron")).alias("col"), "vec")
    return matching.top_candidates(d, k, 8).withColumn("layer", F.lit(0))


@query()
def merge_greedy_global(spark, sf_dir):
    return matching.greedy_matching(candidates(spark, sf_dir), "layer")


@query()
def merge_block_match(spark, sf_dir):
    return matching.block_matching(candidates(spark, sf_dir), "layer", 128)


@query(SIMS + """, z AS (SELECT *, exp(sim / 0.1) / sum(exp(sim / 0.1)) OVER (PARTITION BY layer, dropped) AS w FROM s),
    e AS (SELECT layer, expert, CAST(i - 1 AS INTEGER) AS i, v[i] AS y FROM x, unnest(range(1, 65)) u(i))
    SELECT k.layer, k.expert AS kept, k.i, round(k.y + 0.5 * coalesce(sum(z.w * d.y), 0), 6) AS value FROM e k LEFT JOIN z ON z.layer = k.layer AND z.kept = k.expert LEFT JOIN e d ON d.layer = z.layer AND d.expert = z.dropped AND d.i = k.i
    WHERE k.expert % 2 = 0 GROUP BY k.layer, k.expert, k.i, k.y""")
def merge_weighted_sum(spark, sf_dir):
    dropped, kept = experts(spark, sf_dir)
    return matching.cosine_weighted_sums(kept, dropped, 0.1, 0.5).withColumn("value", F.round("value", 6))


KEYS = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'model.language_model.embed_tokens.weight' WHEN 1 THEN 'lm_head.weight' WHEN 2 THEN 'model.layers.' || p_size || '.mlp.gate.weight' WHEN 3 THEN 'model.layers.' || p_size || '.mlp.experts.' || (p_partkey % 16) || '.up_proj.weight'
    WHEN 4 THEN 'model.language_model.layers.' || p_size || '.linear_attn.in_proj.weight' WHEN 5 THEN 'model.layers.' || p_size || '.input_layernorm.weight' WHEN 6 THEN 'model.language_model.layers.' || p_size || '.mlp.shared_expert.down_proj.weight' ELSE 'visual.norm.' || p_size END AS key FROM part"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter names made from parts."""
    parts = table(spark, sf_dir, "part")
    parts.createOrReplaceTempView("_parts")
    return spark.sql(KEYS.replace("FROM part", "FROM _parts"))


@query(f"""SELECT p_partkey, CAST(nullif(regexp_extract(key, '^model\\.(?:language_model\\.)?layers\\.(\\d+)\\.', 1), '') AS INTEGER) AS layer,
    ['embedding', 'lm_head', 'router', 'routed_expert', 'attention', 'layernorm', 'shared_expert', 'layernorm'][p_partkey % 8 + 1] AS type, CASE WHEN p_partkey % 8 = 3 THEN CAST(p_partkey % 16 AS INTEGER) END AS expert FROM ({KEYS})""")
def tensor_key_classify(spark, sf_dir):
    return tensors.classified(keys(spark, sf_dir)).select("p_partkey", "layer", "type", "expert")


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 16 = 11 THEN replace(key, '.experts.11.', '.experts.0.') ELSE key END AS key FROM ({KEYS}) WHERE p_partkey % 16 <> 3 OR NOT key LIKE '%.experts.3.%'""")
def tensor_prune(spark, sf_dir):
    rows = keys(spark, sf_dir)
    layers = tensors.classified(rows).where("type = 'routed_expert'").select("layer").distinct()
    return tensors.pruned(rows, layers.select("layer", F.lit(11).alias("old_id"), F.lit(0).alias("new_id")))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN -l.toxic - 1 ELSE d.n_chars END AS value, l.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l USING (doc_id)")
def tensor_override_merge(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = table(spark, sf_dir, "labels").select("doc_id", (-F.col("toxic") - 1).cast("long").alias("value"))
    return tensors.overridden(base, new, "doc_id", "value")


@query("SELECT p_type AS type, CAST(sum(p_size * 64) AS BIGINT) AS parameters, count(*) AS tensors FROM part WHERE p_brand NOT LIKE 'Brand#1%' GROUP BY 1")
def tensor_parameter_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("."), "p_partkey").alias("key"), F.col("p_type").alias("type"), F.array(F.col("p_size").cast("long"), F.lit(64).cast("long")).alias("shape"))
    return tensors.parameter_totals(tensors.without_prefixes(rows.unionByName(rows), ["Brand#1"]), ["type"])


@query("SELECT event_type, round(sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) / greatest(count(*) FILTER (user_id % 2 = 0), 1), 6) AS masked, round(avg(value), 6) AS plain FROM events GROUP BY 1")
def metric_masked_mean(spark, sf_dir):
    even = F.col("user_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(metrics.masked_mean(F.col("value"), even), 6).alias("masked"), F.round(metrics.masked_mean(F.col("value")), 6).alias("plain"))


@query("""
    WITH e AS (SELECT label AS layer, CAST(embedding AS DOUBLE[])[1:32] AS s, CAST(embedding AS DOUBLE[])[33:64] AS t FROM embeddings),
    d AS (SELECT layer, list_dot_product(s, s) AS ss, list_dot_product(t, t) AS tt, list_dot_product(s, t) AS st FROM e),
    l AS (SELECT layer, avg(2 - 2 * st / sqrt(ss * tt)) AS h, avg((ss + tt - 2 * st) / (tt + 1e-8)) AS n, avg(st / sqrt(ss * tt)) AS c, avg(sqrt(tt)) AS tn, avg(sqrt(ss)) AS sn FROM d GROUP BY 1)
    SELECT round(avg(h), 6) AS hidden_mse, round(avg(n), 6) AS nmse, round(1 - avg(c), 6) AS cos_loss, round(avg(tn), 6) AS teacher_norm, round(avg(sn), 6) AS student_norm FROM l
""")
def metric_hidden(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.slice("embedding", 1, 32).alias("s"), F.slice("embedding", 33, 32).alias("t"))
    found = metrics.hidden_metrics(rows)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("""
    WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
    e AS (SELECT event_type, event_id, r, value AS ema FROM o WHERE r = 1 UNION ALL SELECT o.event_type, o.event_id, o.r, e.ema * 0.95 + o.value * 0.05 FROM e JOIN o ON o.event_type = e.event_type AND o.r = e.r + 1)
    SELECT event_type, event_id AS step, round(ema, 6) AS ema FROM e
""")
def metric_ema(spark, sf_dir):
    smoothed = metrics.smoothed(table(spark, sf_dir, "events"), "event_type", "event_id", "value")
    return smoothed.select("event_type", "step", F.round("ema", 6).alias("ema"))


@query("""
    WITH RECURSIVE o AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
    e AS (SELECT event_type, r, event_id, value AS best, 0 AS waited FROM o WHERE r = 1
          UNION ALL SELECT o.event_type, o.r, o.event_id, CASE WHEN o.value < e.best - 1e-6 THEN o.value ELSE e.best END, CASE WHEN o.value < e.best - 1e-6 THEN 0 ELSE e.waited + 1 END
          FROM e JOIN o ON o.event_type = e.event_type AND o.r = e.r + 1 WHERE e.waited < 50)
    SELECT event_type, CASE WHEN max(waited) >= 50 THEN max(event_id) END AS stop_step, min(best) AS best, CASE WHEN max(waited) >= 50 THEN 'patience' ELSE 'none' END AS reason FROM e GROUP BY event_type
""")
def metric_early_stop(spark, sf_dir):
    return metrics.early_stop(table(spark, sf_dir, "events"), "event_type", "event_id", "value", patience=50)


@query("""
    SELECT s AS step, round(CASE WHEN s < 100 THEN s / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least((s - 100) / 900.0, 1))) END, 6) AS cosine, round(CASE WHEN s < 100 THEN s / 100.0 ELSE greatest(0.1, 1 - 0.9 * least((s - 100) / 900.0, 1)) END, 6) AS linear,
           round(CASE WHEN s < 100 THEN s / 100.0 ELSE 1.0 END, 6) AS constant FROM range(1200) t(s)
""")
def metric_lr_schedule(spark, sf_dir):
    return spark.range(1200).select(F.col("id").alias("step"), *(F.round(x.learning_rate(F.col("id"), k, 100, 1000), 6).alias(k) for k in ("cosine", "linear", "constant")))


@query('SELECT CAST(event_id // 100 AS BIGINT) AS "window", round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1')
def metric_step_windows(spark, sf_dir):
    return metrics.step_windows(table(spark, sf_dir, "events"), "event_id", "value", 100).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderpriority, metric, round(avg(v), 4) AS mean, count(*) AS n FROM (SELECT o_orderpriority, 'total' AS metric, o_totalprice AS v FROM orders UNION ALL SELECT o_orderpriority, 'open', CASE WHEN o_orderstatus = 'O' THEN o_totalprice END FROM orders) WHERE v IS NOT NULL GROUP BY 1, 2")
def metric_evaluation_means(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("total"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("open"))
    return metrics.evaluation_means(rows, ["o_orderpriority"], ["total", "open"]).withColumn("mean", F.round("mean", 4))


PATHS = "SELECT source, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 5 < 2 THEN '.parquet' WHEN doc_id % 5 < 4 THEN '.jsonl.gz' ELSE '.csv' END AS path, n_chars AS size FROM documents"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest made from documents."""
    ending = F.when(F.col("doc_id") % 5 < 2, ".parquet").when(F.col("doc_id") % 5 < 4, ".jsonl.gz").otherwise(".csv")
    return table(spark, sf_dir, "documents").select("source", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", ending).alias("path"), F.col("n_chars").alias("size"))


@query(f"""SELECT source, format FROM (SELECT source, CASE WHEN path LIKE '%.parquet' THEN 'parquet' WHEN path LIKE '%.csv' THEN 'csv' ELSE 'json' END AS format, count(*) AS n FROM ({PATHS}) GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, format) = 1""")
def manifest_format_vote(spark, sf_dir):
    return files.format_votes(paths(spark, sf_dir), ["source"])


@query("""
    WITH l AS (SELECT l_orderkey AS path, CAST(count(*) * 20000 AS BIGINT) AS local_size FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1),
    r AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders)
    SELECT path, size, local_size, CASE WHEN local_size IS NULL THEN 'missing' WHEN size < 0 THEN 'unknown' WHEN local_size < size THEN 'short' ELSE 'ok' END AS status FROM r LEFT JOIN l USING (path)
""")
def manifest_reconcile(spark, sf_dir):
    local = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("path")).agg((F.count(F.lit(1)) * 20000).alias("size"))
    size = F.when(F.col("o_orderkey") % 7 > 0, F.floor("o_totalprice"))
    remote = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), files.known_size(F.lit(None).cast("long"), size).alias("size"))
    return files.reconciled(remote, local)


@query(f"""WITH p AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS directory FROM ({PATHS}))
    SELECT directory, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, array_to_string(list_sort(list(path))[1:3], ',') AS examples FROM p GROUP BY 1""")
def manifest_profile(spark, sf_dir):
    return files.profile(paths(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


from sluice.plans import extended  # noqa: E402, F401  more queries, registered in the same tables
