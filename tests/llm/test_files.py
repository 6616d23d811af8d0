"""Archives, token files and byte-level BPE: exact round trips."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import bpe, token_files, warc
from sluice.llm._shared import new_folder

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>equal</p>" * 20
    rows = [(5, "u5", long), (3, "u3", long), (9, "u9", long), (1, "a\r\nb", "short"), (2, None, "short"), (4, "u", None), (7, "u7", "é" * 100), (7, "u7", "é" * 100), (None, "n", long)]
    rows += [(100 + i, f"u{i}", "".join(random.Random(i).choices("abc ", k=3000))) for i in range(40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "shard": F.lit(3), "kind": F.lit(0), "payload": F.lit("p"), "weight": F.lit(1)})


def test_archives(spark, pages):
    got = {}
    for r in warc.archive_round_trip(spark, pages).collect():
        got.setdefault(r.page_id, []).append(r)
    assert sum(map(len, got.values())) == pages.count()
    assert [(r.record_type, r.refers_to) for i in (3, 5, 9, None) for r in got[i]] == [("response", None), ("revisit", 3), ("revisit", 3), ("revisit", 3)]
    assert [r.record_type for r in got[1] + got[2] + got[4]] == ["response"] * 3
    assert sorted((r.record_type, r.refers_to) for r in got[7]) == [("response", None), ("revisit", 7)]
    assert got[4][0].payload_digest == hashlib.sha256(b"").hexdigest() and got[7][0].payload_bytes == 200


def test_archives_do_not_depend_on_partitions(spark, pages, tmp_path):
    sums = []
    for i, rows in enumerate((pages.repartition(7), pages.coalesce(1))):
        files = warc.write_archives(rows, f"file://{tmp_path}/{i}", shard_bytes=20_000, roll_bytes=2_000)
        sums.append([(f["file"], f["sha256"]) for f in files])
        assert json.loads((tmp_path / str(i) / "manifest.json").read_text())["files"] == files
        assert not [p for p in (tmp_path / str(i)).iterdir() if p.name.endswith(".tmp")]
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_a_damaged_archive_is_noticed(spark, pages, tmp_path):
    files = warc.write_archives(pages, f"file://{tmp_path}/x")
    path = tmp_path / "x" / files[0]["file"]
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends early|damaged"):
        warc.read_archives(spark, f"file://{tmp_path}/x", files).collect()


def test_no_pages(spark, pages):
    assert warc.archive_round_trip(spark, pages.where("false")).collect() == []


def expected(docs):
    tokenizer = Tokenizer.from_file(JSON)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [(i, t, e.ids) for (i, t), e in zip(rows, tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)]


def test_token_files(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/t"
    shards = token_files.write_token_files(docs, folder, JSON, sequence=64, rows_per_batch=8, shard_chars=50_000)
    got = token_files.read_token_files(spark, folder, shards).collect()
    want, start = [], 0
    for i, _, ids in expected(docs):
        want.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted((r.doc_id or 10**9, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((w[0] or 10**9, *w[1:]) for w in want)
    shard = token_files.TokenShard(f"{tmp_path}/t/{shards[0]['file']}")
    tokens, mask = shard.sequence(9)
    assert len(tokens) == 64 and mask.tolist() == [255] * 8 and tokens.base is not None
    assert sum(n for _, n in shard) == shards[0]["tokens"]


def test_no_documents(spark, empty):
    assert token_files.token_round_trip(spark, empty, JSON).collect() == []
    assert bpe.round_trip(empty, RANKS).collect() == []


def test_pieces_agree_with_whole_texts():
    rng = random.Random(5)
    whole = Tokenizer.from_file(JSON)
    memo = token_files.MemoEncoder(JSON, "<u2")
    parts = ["a", "B", " ", "  ", "\n", " \n", "'s", "é", "\x1c", "\x85", "9", ".", "\t", "日", "'ll", "!!", "　"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert np.frombuffer(memo.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids == bpe.encode(text, RANKS)


def test_words_with_marks_are_those_of_the_pattern():
    memo, whole = token_files.MemoEncoder(JSON, "<u2"), Tokenizer.from_file(JSON)
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x251))]
    rng = random.Random(6)
    parts = ["Word", "don't", "'s", "'", ".'", "!?", "`", "~^", "12", "x_y", "ñandú", "×", "÷", "日本", "\n", "\x1c", "\x85", "\u00a0", "\u3000", "e\u0301", "ſ"]
    texts = [t for c in latin for t in (c, f"{c}a,", f"x {c}b.", f" {c}", f"a {c}{c}'")]
    texts += ["".join(rng.choice(parts) + rng.choice(["", "", " ", "  "]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for text, found in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(memo.encode(text), "<u2").tolist() == found.ids, text


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="doesn't hold"):
        token_files.MemoEncoder(JSON, "u1")


def test_added_tokens_are_those_of_the_plain_call():
    whole, memo = Tokenizer.from_file(JSON), token_files.MemoEncoder(JSON, "<u2")
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "a <|endoftext | > b"):
        assert np.frombuffer(memo.encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "overlap"), [(16_384, 512), (2_000, 15)])
def test_chunked_bpe(spark, docs, chunk, overlap):
    got = bpe.round_trip(docs, RANKS, chunk, overlap).collect()
    want = [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t, ids in expected(docs)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_scratch_is_in_the_shared_folder(spark):
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_very_long_page(spark):
    rows = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, rows).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None)}


def test_scratch_goes(spark):
    import os

    from sluice.llm._shared import materialise, scratch

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark) as keep:
        materialise(spark.range(3), "gone")
        kept = keep(materialise(spark.range(4), "kept"))
    assert kept.count() == 4 and len(set(os.listdir(folder)) - before) == 1
