"""Streaming refresh times equal the batch scan."""

from tickweave.streaming.refresh import streaming_last_values, streaming_refresh_times


def test_streams(spark, tmp_path):
    rows = [("u", a, float(t), i, float(i)) for i, (a, t) in enumerate([("A", 1), ("B", 2), ("A", 5), ("B", 5), ("A", 6), ("A", 7), ("B", 7), ("B", 9), ("A", 10)])]
    schema = "universe string, asset string, t double, seq long, value double"
    for part, cut in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(cut, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = streaming_refresh_times(stream, ["A", "B"]).writeStream.format("memory").queryName("refresh").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.t for r in spark.sql("select t from refresh").collect()) == [2, 5, 7, 10]
    query = streaming_last_values(stream).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r.asset: r.t for r in spark.sql("select * from latest").collect()} == {"A": 10, "B": 9}
