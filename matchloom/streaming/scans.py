"""A scan in the order of a file: entities whose rows stand together are summed up as they end, and reported if they come again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from matchloom.sources.files import kept, shared_folder

#: What is summed up of a match: its rows, those of a purchase, all values.
SUMS = ["events", "purchases", "total"]
_OUT = "match_id long, first long, events long, purchases long, total double, contiguous boolean"


def positions(files: DataFrame) -> DataFrame:
    """files (a scan of Parquet files) with pos: each row's place from 0, file by file in the order of their names.

    Places within a file come from the reader; only the number of rows of each file is counted, so nothing is sorted.
    """
    rows = files.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    w = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_file").withColumn("pos", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def runs(rows: DataFrame) -> DataFrame:
    """The scan's result for rows (pos, match_id, type, value) by one aggregation: a match is contiguous if its places have no gap."""
    n = F.count(F.lit(1))
    return rows.groupBy("match_id").agg(
        F.min("pos").alias("first"), n.alias("events"), F.count_if(F.col("type") == "purchase").alias("purchases"), F.sum("value").alias("total"),
        (F.max("pos") - F.min("pos") + 1 == n).alias("contiguous"),
    )


class Scan(StatefulProcessor):
    """The state of a match: where it began and stands, its sums so far, whether it has ended."""

    def __init__(self, strict: bool):
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("match", "first long, last long, events long, purchases long, total double, whole boolean, ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        m = pd.concat(list(rows)).sort_values("pos")
        if pd.isna(key[0]):  # filtering such rows before would keep their places from the watermark
            return
        pos = m["pos"].to_numpy()
        first, last, events, purchases, total, whole, ended = self.state.get() if self.state.exists() else (int(pos[0]), int(pos[0]) - 1, 0, 0, 0.0, True, False)
        together = pos[0] == last + 1 and pos[-1] - pos[0] + 1 == len(pos)
        if self.strict and not together:
            raise ValueError(f"match {key[0]} is not contiguous: it comes again by row {pos[-1]}, after it ended at row {last}")
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        now = (events + len(m), purchases + int((m["type"] == "purchase").sum()), total + float(m["value"].sum()))
        self.state.update((first, int(pos[-1]), *now, bool(whole and together), False))
        self.handle.registerTimer(int(pos[-1] + 2) * 1000)
        yield pd.DataFrame({c: [] for c in ("match_id", "first", *SUMS, "contiguous")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, *sums, whole, _ = self.state.get()
        self.state.update((first, last, *sums, whole, True))
        yield pd.DataFrame([(key[0], first, *sums, whole)], columns=["match_id", "first", *SUMS, "contiguous"])

    def close(self) -> None:
        pass


def scan_stream(rows: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each match of a stream (pos, match_id, type, value) in the order of pos, as soon as a later row shows that it has ended.

    Places are the stream's event time: the watermark is the last place seen, and a timer ends a match once that is beyond its rows. What a batch cuts
    off is carried over as state. A match that comes again fails the query, or, if not strict, is given again with contiguous
    false and all its rows. A row without match_id only moves the place, as one at the end of a file does.
    """
    at = F.timestamp_seconds(F.col("pos") + 1)  # what is at the watermark, 0 at first, would count as late
    timed = rows.select("pos", "match_id", "type", "value", at.alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("match_id").transformWithStateInPandas(Scan(strict), _OUT, "Append", "EventTime")


def in_slices(rows: DataFrame, slices: int) -> tuple[str, DataFrame]:
    """rows (pos, ...) written as files that a stream reads one after another, with last rows that mark the end."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    rows = kept(rows)
    n = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    for i in range(slices):
        part = rows.where((F.col("pos") >= i * n // slices) & (F.col("pos") < (i + 1) * n // slices))
        part.coalesce(1).write.mode("append").parquet(path)  # a slice is what one batch reads
    for i in (1, 2):  # a batch's places count from the next one on
        spark.range(1).coalesce(1).select(*[F.lit(n + i if f.name == "pos" else None).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(path)
    return path, rows
