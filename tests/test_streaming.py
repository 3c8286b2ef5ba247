import datetime as dt

from larder.streaming import nutrition


def test_trailing_means(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 10, 12), 4.0), (1, dt.datetime(2024, 1, 11, 12), None), (2, dt.datetime(2024, 1, 11, 1), 3.0)]
    spark.createDataFrame(rows, "u long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    query = nutrition.trailing_means(stream, "u", "ts", "v", window="1 day", slide="1 day").writeStream.outputMode("complete").format("memory").queryName("means").start()
    query.processAllAvailable()
    query.stop()
    found = {(r.u, r.window.start.day): r["mean"] for r in spark.table("means").collect()}
    assert found == {(1, 10): 4.0, (1, 11): 0.0, (2, 11): 3.0}


def test_new_files(spark, tmp_path):
    source = tmp_path / "csv"
    source.mkdir()
    (source / "a.csv").write_text("title\nx\n")
    seen = []
    for name in ("b.csv", "b.csv"):
        nutrition.import_new_files(spark, str(source), str(tmp_path / "state"), lambda df, _: seen.extend(r.path.rpartition("/")[2] for r in df.collect())).awaitTermination()
        (source / name).write_text("title\ny\n")
    nutrition.import_new_files(spark, str(source), str(tmp_path / "state"), lambda df, _: seen.extend(r.path.rpartition("/")[2] for r in df.collect())).awaitTermination()
    assert sorted(set(seen)) == ["a.csv", "b.csv"]
