"""The expiring stream against the batch rule."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming.expiry import expiring


def test_deadlines_fire_in_event_time(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shape = "key string, seq long, ts timestamp, cmd string, expire_at_ms long"
    batches = [
        [("a", 1, 10, "SET", 20_000), ("b", 2, 10, "SET", 90_000), ("c", 3, 11, "SET", 30_000), ("d", 4, 11, "SET", 25_000)],
        [("c", 5, 12, "PERSIST", None), ("d", 6, 12, "DEL", None), ("e", 7, 40, "SET", 60_000), ("e", 8, 40, "SET", None)],
        [("z", 9, 70, "SET", None)],
        [("z", 10, 71, "SET", None)],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(k, s, t, c, e) for k, s, t, c, e in rows], "key string, seq long, t long, cmd string, expire_at_ms long")
        frame.select("key", "seq", F.timestamp_seconds("t").alias("ts"), "cmd", "expire_at_ms").coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    log = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source / "b=*"))
    try:
        query = expiring(log).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    got = {(r["key"], r["at_ms"]) for r in spark.sql("SELECT * FROM expired WHERE event = 'expired'").collect()}
    assert got == {("a", 20_000)}
    assert spark.sql("SELECT * FROM expired WHERE event = 'del'").count() == 1


if __name__ == "__main__":
    pytest.main([__file__])
