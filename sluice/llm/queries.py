"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontam, language_id, license_scan, line_dedup, minhash_forest, syncmers, token_files, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    return token_files.token_round_trip(spark, _table(spark, sf_dir, "documents"), TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of MIN_WORDS words or more that an earlier document already holds, with its place in the original text."""
    return line_dedup.repeated_passages(_table(spark, sf_dir, "documents"), line_dedup.MIN_WORDS).drop("doc_key")


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses."""
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of every document."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four fifths of the labels."""
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages in every document."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over three-word shingles at a similarity of 0.85."""
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS)


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_files, op3_line_dedup, op4_syncmers, op5_license_scan, op6_toxicity, op7_decontam, op8_near_dedup, op9_language_id, op10_bpe)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS target FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.target < p.page_id AND p.payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.target < p.page_id AND p.payload_bytes >= 100 THEN f.target END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op7_decontam": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
        t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
        c AS (SELECT term, count(*) AS n FROM t GROUP BY term),
        win AS (SELECT item_id, w, least(10, len(w)) AS size, w[s + 1 : s + 10] AS words, min(s) AS s FROM i, unnest(range(greatest(len(w) - 10, 0) + 1)) r(s) WHERE len(w) > 0 GROUP BY ALL),
        grams AS (SELECT doc_id, p, size, w[p + 1 : p + size] AS words FROM d, (SELECT DISTINCT size FROM win), unnest(range(len(w) - size + 1)) r(p)),
        found AS (SELECT DISTINCT doc_id, item_id, p, size FROM grams JOIN win USING (size, words)),
        hits AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM found, unnest(range(size)) r(k) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM found GROUP BY doc_id),
        ranked AS (SELECT item_id, w, s, list_sort(list({{'n': n, 'q': q, 'term': term}})) AS r
                   FROM (SELECT item_id, w, s, s + unnest(range(len(words))) AS q, unnest(words) AS term FROM win) JOIN c USING (term) GROUP BY ALL),
        pairs AS (SELECT DISTINCT item_id, r[1].q AS q1, r[1].term AS t1, coalesce(r[2], r[1]).q AS q2, coalesce(r[2], r[1]).term AS t2 FROM ranked),
        near AS (SELECT a.doc_id, count(DISTINCT item_id) AS n_near FROM pairs JOIN t a ON a.term = t1 JOIN t b ON b.doc_id = a.doc_id AND b.term = t2 WHERE abs((a.pos - q1) - (b.pos - q2)) BETWEEN 1 AND 5 GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op8_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) r(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM both_of x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x.n >= 85 * (na.n + nb.n - x.n)),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
    """,
}
