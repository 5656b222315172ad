from datetime import datetime, timedelta

from quire.streaming import ingest


def run(spark, df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(60)
    return spark.table(name)


def test_event_windows_and_distinct_events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 50, start + timedelta(minutes=5 * (i % 50)), "click" if i % 2 else "view", 1.0) for i in range(100)]
    rows.append((99, start + timedelta(days=1), "click", 1.0))  # moves the watermark past all others
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    got = run(spark, ingest.event_windows(events), tmp_path, "hours")
    assert got.selectExpr("sum(n)").first()[0] == 100 and got.where("n <> total").count() == 0
    assert run(spark, ingest.distinct_events(events), tmp_path, "once").count() == 51
