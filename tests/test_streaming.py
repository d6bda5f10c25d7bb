from pyspark.sql import functions as F

from tracelink.streaming import links


def test_stream_agrees_with_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(data).withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = spark.read.parquet(f"{data}/customer.parquet").where("c_nationkey < 12").selectExpr("c_custkey AS user_id")
    stream = links.watermarked(links.cited_by(stream, wanted, "user_id"), "ts", "1 hour")
    out = links.counts(links.once(stream, ["event_id"]), "ts", "1 day", "event_type")
    query = out.writeStream.outputMode("append").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.join(wanted.distinct(), "user_id", "left_semi").dropDuplicates(["event_id"]).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = {(r.window.start, r.event_type): r.n for r in spark.table("seen").collect()}
    every = {(r.window.start, r.event_type): r.n for r in links.counts(batch, "ts", "1 day", "event_type").collect()}
    assert seen and all(every[k] == n for k, n in seen.items())
    closed = max(start for start, _ in every)  # the watermark leaves the last window open
    assert set(every) - set(seen) <= {k for k in every if k[0] == closed}
