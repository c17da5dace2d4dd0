"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from weftgraph.streaming.refresh import append_new, counted_windows


def test_append_new_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, v string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    for i in range(2):
        append_new(spark.readStream.schema(rows.schema).parquet(source), target, ["id"], str(tmp_path / f"check{i}")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b")]


def test_counted_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:12:00", "x")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in counted_windows(rows, "ts", ["k"]).collect()) == [1, 2]
