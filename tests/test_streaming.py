from pyspark.sql import functions as F

from tidewright.streaming import events


def test_windows_match_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(folder))
    run = events.windowed(events.read_events(spark, str(folder)), "1 day", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = events.windowed(spark.read.parquet(str(folder)), "1 day", "1 day")
    total = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.select("start", "event_type", F.col("n")).collect())
    assert total(spark.table("w")) == total(batch)
