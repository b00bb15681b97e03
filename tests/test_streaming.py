from pyspark.sql import functions as F

from wayline.streaming.sessions import session_counts

SCHEMA = "log_id long, ts timestamp"


def test_stream_equals_batch(spark, tmp_path):
    seconds = [0, 1, 2, 9, 10, 40, 100]
    rows = spark.createDataFrame([(1, t) for t in seconds], "log_id long, t long").select("log_id", F.timestamp_seconds("t").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = [(r.log_id, r.n) for r in session_counts(rows, ["log_id"]).orderBy("start").collect()]
    assert batch == [(1, 3), (1, 2), (1, 1), (1, 1)]
    stream = session_counts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), ["log_id"])
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    found = [(r.log_id, r.n) for r in spark.table("sessions").orderBy("start").collect()]
    assert found == batch[:-1]  # the last session is still open
