"""The pipeline's stages on their own inputs, and the registered queries of this subpackage."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sluice.llm import bpe, queries
from tests.llm.test_duplicates import brute_components, brute_contamination, brute_passages

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """(input, output) of every stage, as lists of rows."""
    at, out, folder = docs, {}, tmp_path_factory.mktemp("stages")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, DATA).write.parquet(str(folder / str(i)))
        after = spark.read.parquet(str(folder / str(i)))
        out[name] = at.collect(), after.collect(), after.columns
        at = after
    return out


def test_columns_stay(docs, stages):
    *kept, last = stages.values()
    assert all(columns == docs.columns for _, _, columns in kept)
    assert last[2] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_language_keeps_clean_documents(stages):
    before, after, _ = stages["language identification"]
    lost = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {10_001, 10_002, 10_003} <= lost and len([d for d in lost if d and d < 10_000]) <= 2


def test_near_duplicates_stage(stages):
    before, after, _ = stages["near-duplicate removal"]
    want = {c[0] for c in brute_components([(r.doc_id, r.text) for r in before], 5, 80, 100) if c[3]}
    assert {r.doc_id for r in after} == want and len([r for r in after if r.doc_id == 10_005]) == 1


def test_passages_stage(stages):
    before, after, _ = stages["repeated passages"]
    removed = {d for d, *_ in brute_passages([(r.doc_id, r.text) for r in before], 20)}
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after if r.doc_id not in removed)
    assert all(len(r.text) < len(texts[r.doc_id]) and r.n_chars == len(r.text) for r in after if r.doc_id in removed)


def test_contamination_stage(spark, stages):
    before, after, _ = stages["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], items) if not r[5]}
    assert {r.doc_id for r in after} == want


def test_encoding_stage(stages):
    before, after, _ = stages["byte-level BPE"]
    want = {(r.doc_id, len(ids := bpe.encode(r.text, queries.RANKS)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for r in before}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in after} == want


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100


def test_archives_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op1_warc"])
    got = queries.op1_warc(spark, DATA).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_nothing_in_the_documents(spark, empty, tmp_path):
    at = empty
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, DATA).write.parquet(str(tmp_path / str(i)))
        at = spark.read.parquet(str(tmp_path / str(i)))
        assert at.count() == 0


def test_clashing_columns_stay(spark, docs):
    one = docs.where("doc_id = 10004").withColumn("doc_key", F.lit(5)).withColumn("_key", F.lit(6)).withColumn("_h", F.lit(7))
    left = corpus_pipeline.drop_repeated_passages(spark, one, DATA)
    left = corpus_pipeline.drop_contaminated(spark, left, DATA)
    assert left.columns == one.columns and left.first().doc_key == 5
