import pytest
from pyspark.sql import functions as F

from hayloft.streaming import watch


def events(spark, folder):
    rows = [("a", "upsert", "2024-01-01 00:00:00.0"), ("a", "delete", "2024-01-01 00:00:00.2"), ("b", "upsert", "2024-01-01 00:00:00.1"), ("a", "upsert", "2024-01-01 00:00:10.0"), ("z", "upsert", "2024-01-01 01:00:00.0")]
    made = spark.createDataFrame(rows, "path_key string, action string, ts string").selectExpr("path_key", "action", "cast(ts as timestamp) ts")
    made.coalesce(1).write.parquet(folder)
    return made


def test_bursts_coalesce(spark, tmp_path):
    made = events(spark, f"{tmp_path}/e")
    batch = sorted((r.path_key, r.action, r.n) for r in watch.coalesced(made).collect())
    assert batch == [("a", "delete", 2), ("a", "upsert", 1), ("b", "upsert", 1), ("z", "upsert", 1)]
    seen = []
    stream = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/e")
    watch.watch(stream, lambda df, n: seen.extend((r.path_key, r.action) for r in df.collect()), f"{tmp_path}/c").awaitTermination(120)
    # the last event only moves the watermark
    assert sorted(seen) == [("a", "upsert"), ("b", "upsert")]


def test_failed_batch_is_repeated(spark, tmp_path):
    made = events(spark, f"{tmp_path}/e")
    stream = lambda: spark.readStream.schema(made.schema).parquet(f"{tmp_path}/e")

    def fail(df, n):
        raise ValueError("no")

    with pytest.raises(Exception):
        watch.watch(stream(), fail, f"{tmp_path}/c").awaitTermination(120)
    seen = []
    watch.watch(stream(), lambda df, n: seen.extend(r.path_key for r in df.collect()), f"{tmp_path}/c").awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_rolling_percentiles_of_a_stream(spark, tmp_path):
    """The stateful form, micro-batch by micro-batch, against the table form after the last row of each key."""
    import random

    rng, rows = random.Random(3), []
    for k in range(900):
        rows.append(("a" if k % 3 else "b", k, float(rng.randint(0, 1000))))
    made = spark.createDataFrame(rows, "key string, n long, value double").withColumn("ts", F.timestamp_seconds("n"))
    for part in range(3):
        made.where(F.floor(F.col("n") / 300) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    seen = {}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = watch.rolling_percentiles(stream.select("key", "ts", "value"))
        query = found.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        query.foreachBatch(lambda df, n: seen.update({r.key: (r.n, r.p50, r.p95) for r in df.collect()})).start().awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    table = watch.running_percentiles(made, "key", ["ts"])
    last = {r.key: (r.p50, r.p95) for r in table.groupBy("key").agg(F.max_by("p50", "ts").alias("p50"), F.max_by("p95", "ts").alias("p95")).collect()}
    assert {k: v[1:] for k, v in seen.items()} == last and {v[0] for v in seen.values()} == {watch.KEPT}
