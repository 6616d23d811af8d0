"""Corpus building against sequential folds in plain Python."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.functions import expressions as x
from sluice.operators import corpus, transforms

DATA = "/root/testdata/sf0.001/documents.parquet"


def counted(spark):
    docs = spark.read.parquet(DATA)
    return docs.select("doc_id", "source", x.token_count(F.col("text")).alias("n_tok"), corpus.content_key(F.col("text"), 64).alias("h"))


@pytest.mark.parametrize("quota", [500, 2000, 10**9])
def test_harvest_is_the_sequential_build(spark, quota):
    rows = counted(spark)
    sources = sorted({r.source for r in rows.collect()})
    got = {r.doc_id for r in corpus.harvest(rows, [(s, quota) for s in sources], "doc_id", "n_tok", "h").collect()}
    seen, want = set(), set()
    for s in sources:
        total = 0
        for r in sorted((r for r in rows.collect() if r.source == s), key=lambda r: r.doc_id):
            if total >= quota:
                break
            if r.h not in seen:
                seen.add(r.h)
                want.add(r.doc_id)
                total += r.n_tok
    assert got == want


def test_unusable_rows_block_their_key(spark):
    rows = spark.createDataFrame([("a", 1, 5, "k", False), ("a", 2, 5, "k", True), ("a", 3, 5, "l", True)], "source string, o int, n long, h string, ok boolean")
    got = corpus.harvest(rows, [("a", 100)], "o", "n", "h", F.col("ok")).collect()
    assert [r.o for r in got] == [3]


def test_balance_is_the_sequential_fold(spark):
    rows = [("s", i, (i * 37) % 900 + 1) for i in range(200)]
    got = corpus.balanced(spark.createDataFrame(rows, "g string, o int, n long"), "g", "o", "n", 9000, [1, 256, 512, 1024]).collect()
    totals, used, want = [0, 0, 0], 0, []
    for _, o, n in rows:
        b = 0 if n <= 256 else 1 if n <= 512 else 2
        if used >= 9000:
            break
        if totals[b] > 4500 and not (min(totals) == 0 and max(totals) >= 10_000) and not all(t > 4500 for t in totals):
            continue
        totals[b] += n
        used += n
        want.append(o)
    assert sorted(r.o for r in got) == want


def test_balance_of_odd_rows(spark):
    rows = [("s", None, 3), ("s", 2, None), ("s", 1, 0), (None, 1, 5), ("s", 4, 2), ("s", 4, 9)]
    df = spark.createDataFrame(rows, "g string, o int, n long").repartition(5)
    got = corpus.balanced(df, "g", "o", "n", 10, [1, 256, 512]).collect()
    assert sorted(((r.g or "", r.o or 99, r.n) for r in got)) == [("", 1, 5), ("s", 4, 2), ("s", 4, 9)]
    assert corpus.balanced(df.where("false"), "g", "o", "n", 10, [1, 256]).collect() == []


def test_buckets_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 256, 257, 2048, 2049)], "n int").select("n", x.bucket_of(F.col("n"), [1, 256, 512, 1024, 2048]).alias("b"))
    assert {r.n: r.b for r in rows.collect()} == {0: 0, 1: 0, 256: 0, 257: 1, 2048: 3, 2049: None}


def test_ids_are_a_permutation(spark):
    rows = corpus.shuffled_ids(counted(spark).select("source", "doc_id"), 3, "s", "source", "doc_id").collect()
    assert sorted(r.id for r in rows) == [f"s_{i:06d}" for i in range(len(rows))]


def test_content_keys(spark):
    row = spark.createDataFrame([("héllo" * 100,)], "t string").select(corpus.content_key(F.col("t"), 7).alias("k"), corpus.image_content_key(F.col("t"), F.lit("ab"), 7).alias("i")).first()
    assert row.k == hashlib.sha1(("héllo" * 100)[:7].encode()).hexdigest()
    assert row.i == hashlib.sha1((("héllo" * 100)[:7] + "|img:ab").encode()).hexdigest()


CHAT = "conversations array<struct<from:string,value:string>>"


def test_messages_are_normalised(spark):
    turns = [("human", " hi "), ("tool", "x"), ("gpt", "yo"), ("system", " "), ("user", None)]
    rows = spark.createDataFrame([(turns,), ([("human", "hi")],), ([],), (None,)], CHAT)
    got = transforms.apply("sharegpt", rows).collect()
    assert [[tuple(m) for m in r.messages] for r in got] == [[("user", "hi"), ("assistant", "yo")]]


def test_sharegpt_strings(spark):
    rows = spark.createDataFrame([("[{'from': 'human', 'value': 'a'}, {'from': 'gpt', 'value': 'b'}]",), ("[{'from': 'human', 'value': \"it's\"}, {'from': 'gpt', 'value': 'b'}]",), ("nonsense",), (None,)], "conversations string")
    got = [[tuple(m) for m in r.messages] for r in transforms.apply("sharegpt", rows).collect()]
    assert got == [[("user", "a"), ("assistant", "b")], [("user", "it's"), ("assistant", "b")]]


def test_instruction_falls_through_empty_fields(spark):
    rows = spark.createDataFrame([("", "q", "a", " "), ("i", None, " ", None), ("i", "q", "a", "more")], "instruction string, question string, output string, input string")
    got = [[m.content for m in r.messages] for r in transforms.apply("instruction", rows).collect()]
    assert got == [["q", "a"], ["i\n\nmore", "a"]]


def test_choices(spark):
    rows = spark.createDataFrame([("q", ["x", "y"], 1), ("q", ["x"], 0), ("q", ["x", "y"], 2), ("q", list("abcdefghi"), 0), (None, ["x", "y"], 0)], "question string, choices array<string>, answer int")
    got = [[m.content for m in r.messages] for r in transforms.apply("multiple_choice", rows).collect()]
    assert got[0] == ["q\n\nA. x\nB. y\n\nAnswer with the letter only.", "B"] and len(got) <= 2


def test_marked_chat(spark):
    chat = "USER: hi\n\n\nASSISTANT: call <|endoftext|>\n\n\nFUNCTION RESPONSE: {}\n\n\nnoise\n\n\nASSISTANT: done"
    rows = spark.createDataFrame([("SYSTEM: be kind", chat), (None, " "), (None, "USER: alone")], "system string, chat string")
    got = [[tuple(m) for m in r.messages] for r in transforms.apply("marked_chat", rows).collect()]
    assert got == [[("system", "be kind"), ("user", "hi"), ("assistant", "call"), ("user", "FUNCTION RESPONSE: {}"), ("assistant", "done")]]


def test_function_call(spark):
    rows = spark.createDataFrame([(" q ", '[{"a":1}]', "[2,3]"), ("q", "{}", "[]"), ("q", "bad", "[]")], "query string, tools string, answers string")
    got = [[m.content for m in r.messages] for r in transforms.apply("function_call", rows).collect()]
    assert got == [['You have access to the following tools:\n[{"a": 1}]', "q", "[2, 3]"]]


def test_images(spark):
    rows = spark.createDataFrame([("p.png", " q ", "a"), (None, "q", "a"), ("p.png", " ", "a")], "image string, question string, answer string")
    got = transforms.resolve_images(transforms.apply("image_question", rows)).collect()
    assert len(got) == 1 and got[0].messages[0].blocks[0].image == "file://p.png"
    text = transforms.apply("image_question", rows).select(transforms.countable_text(F.col("messages")[0]).alias("t")).first().t
    assert text == "<image>\nq"


def test_unknown_transform(spark):
    with pytest.raises(KeyError):
        transforms.apply("no such", spark.range(1))


def test_intermediate_tables_can_be_deleted(spark):
    rows = corpus.written(spark.range(3))
    folder = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert rows.count() == 3
    corpus.drop_written(spark)
    assert not Path(folder).exists()
    assert not corpus._folders
