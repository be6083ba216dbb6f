"""Streaming twins of the in-play operators: windows with a bound on lateness, and prefix state as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.sources.files import shared_folder


def read_events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream; its timestamps are in UTC."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_counts(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "60 days") -> DataFrame:
    """Counts by sliding window and type, each event id once; events later than `late` are left out."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(38,6)")).alias("total"))


def prefix_state(events: DataFrame, step: int = 5) -> DataFrame:
    """(match_id, t, events, purchases) as of the last batch: a row for each grid minute a match has crossed so far.

    The state of a match is its counts by grid cell, of which there are few; a cell's row sums those up to it.
    """
    out = "match_id long, t int, events long, purchases long"
    state = "cells array<long>, bought array<long>"
    cells = 31 // step + 2

    def update(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        n, b = (np.array(x, dtype=np.int64) for x in s.get) if s.exists else np.zeros((2, cells), dtype=np.int64)
        for pdf in batches:
            cell = (-(-pdf["minute"] // step)).to_numpy(dtype=np.int64)
            n = n + np.bincount(cell, minlength=cells)
            b = b + np.bincount(cell[(pdf["event_type"] == "purchase").to_numpy()], minlength=cells)
        s.update((n.tolist(), b.tolist()))
        upto = slice(0, cells - 1)
        yield pd.DataFrame({"match_id": key[0], "t": np.arange(cells - 1) * step, "events": n.cumsum()[upto], "purchases": b.cumsum()[upto]})

    rows = events.select(F.col("user_id").alias("match_id"), (F.day("ts") - 1).alias("minute"), "event_type")
    return rows.groupBy("match_id").applyInPandasWithState(update, out, state, "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """All that the stream has to give now, as a table: every update or appended row, or the last state of a complete stream.

    Each batch is written from the executors to a folder of its own in the shared folder, so a batch that is run again
    replaces its rows and nothing goes through the driver. A stream without data gives an empty table. With a path of
    a call before, the stream goes on from its checkpoint, and the table has the rows of both.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    keep(spark.createDataFrame([], stream.schema), -1)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
