"""Workers that fall silent are told after ten minutes of event time, and come back as new ones."""

from brightledger.streaming import heartbeats


def test_silence(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", heartbeats.PROVIDER)
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"

    def send(*rows):
        spark.createDataFrame([(w, f"2024-03-01 {t}:00") for w, t in rows], "worker string, t string").selectExpr("worker", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(source)
        stream = heartbeats.liveness(spark.readStream.schema("worker string, ts timestamp").parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["worker"], r["state"], r["last_ms"] // 60_000 % 1440) for r in spark.read.parquet(out).collect())

    try:
        assert send(("a", "10:00"), ("b", "10:00"), ("a", "10:05")) == [("a", "alive", 605), ("b", "alive", 600)]
        # the watermark passes 10:10 for b, not 10:15 for a
        found = send(("c", "10:13"))
        assert ("b", "expired", 600) in found and ("a", "expired", 605) not in found
        found = send(("b", "10:14"), ("c", "10:30"))
        assert found.count(("b", "alive", 614)) == 1 and ("a", "expired", 605) in found and ("c", "alive", 613) in found
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
