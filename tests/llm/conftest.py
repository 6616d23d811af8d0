import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents with the cases that every operator has a defined result for."""
    from pyspark.sql import functions as F

    some = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = [
        (10_001, None, "en"), (10_002, "", "en"), (10_003, " \n\t ", None), (None, "no id here at all", "en"), (10_004, "word", "en"),
        (10_005, "twice the same row", "en"), (10_005, "twice the same row", "en"), (10_006, "long " * 30_000, "fr"), (10_007, "x" * 40_000, None), (10_008, "!!! ??? 123", "de"),
    ]
    rows = some.unionByName(spark.createDataFrame(odd, some.schema))
    # columns whose names operators use themselves
    return rows.withColumns({"h": F.lit(1), "d": F.lit("x"), "score": F.lit(0.5), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "key": F.lit(0)}).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
