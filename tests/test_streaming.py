from pyspark.sql import functions as F

from sluice.streaming import streams

SCHEMA = "id long, g string, n long, ts timestamp"


def folder(spark, tmp_path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, g string, n long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


T = "2024-01-01 00:00:0"


def test_quota_over_batches(spark, tmp_path):
    df = folder(spark, tmp_path, [(1, "a", 5, T + "1"), (2, "a", 5, T + "2"), (3, "b", 9, T + "3")], [(4, "a", 5, T + "4"), (5, "b", 9, T + "5")])
    got = run(streams.quota_stream(df, "g", "id", "n", 10), "quota")
    assert sum(r.n for r in got if r.g == "a") == 10 and len([r for r in got if r.g == "b"]) == 2


def test_first_seen_and_windows(spark, tmp_path):
    df = folder(spark, tmp_path, [(1, "a", 5, T + "1"), (2, "a", 5, T + "2")], [(1, "a", 5, T + "4")])
    assert sorted(r.id for r in run(streams.first_seen(df, "id", "ts", "1 minute"), "seen")) == [1, 2]
    got = run(streams.windowed(df, "ts", "0 seconds", "2 seconds", ["g"], F.sum("n").alias("n")), "win", "complete")
    assert sorted(r.n for r in got) == [5, 5, 5]


def test_missing_rows_are_added_once(spark, tmp_path):
    df = folder(spark, tmp_path, [(1, "a", 5, T + "1"), (2, "a", 5, T + "2")], [(2, "a", 5, T + "2"), (3, "a", 5, T + "4")])
    q = streams.write_missing(df, "id", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
