"""Streams in several batches give what one batch gives; a stream without data gives an empty table."""

from pyspark.sql import functions as F

from matchloom.streaming import live

SF = "/root/testdata/sf0.001"


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def test_prefix_state_over_batches(spark, tmp_path):
    events, path = spark.read.parquet(f"{SF}/events.parquet"), str(tmp_path / "events")
    events.repartition(3, "event_id").write.parquet(path)
    rows = live.drained(live.prefix_state(stream_of(spark, path, events.schema)), "update")
    last = rows.groupBy("match_id", "t").agg(F.max("events").alias("events"), F.max("purchases").alias("purchases"))
    day = F.day("ts") - 1
    grid = events.select(F.col("user_id").alias("match_id"), "event_type", day.alias("m")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(5))))
    want = grid.groupBy("match_id", "t").agg(F.count_if(F.col("m") <= F.col("t")).alias("events"), F.count_if((F.col("m") <= F.col("t")) & (F.col("event_type") == "purchase")).alias("purchases"))
    assert last.count() == want.count() and last.exceptAll(want).isEmpty()


def test_windows_over_batches_count_each_event_once(spark, tmp_path):
    events, path = spark.read.parquet(f"{SF}/events.parquet"), str(tmp_path / "events")
    events.union(events).repartition(2).write.parquet(path)
    late = live.sliding_counts(stream_of(spark, path, events.schema), late="10000 days")
    assert live.drained(late, "complete").agg(F.sum("n")).first()[0] == 2 * events.count()  # each in two windows


def test_a_stream_without_data(spark, tmp_path):
    events, path = spark.read.parquet(f"{SF}/events.parquet"), str(tmp_path / "events")
    events.where("false").write.parquet(path)
    for mode, stream in (("update", live.prefix_state), ("complete", live.sliding_counts)):
        assert live.drained(stream(stream_of(spark, path, events.schema)), mode).isEmpty()
