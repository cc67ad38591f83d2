from loomaudit.streaming import events


def test_window_counts_as_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", "a" if i % 2 else "b") for i in range(120)] + [(1, "2024-01-01 00:01:00", "a"), (999, "2024-01-02 00:00:00", "z")]
    d = spark.createDataFrame(rows, "event_id long, ts string, kind string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = events.window_counts(stream, "ts", ["kind"], "event_id")
    q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("a", 60), ("b", 60)}
