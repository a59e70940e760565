"""Continuous ingest: new rows are counted in windows, appended, or upserted into an index table, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.sinks import IndexTable


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and time window, with a watermark; also of a table that doesn't stream."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def append_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str):
    """Stream Parquet files of ``source`` into ``target`` once; a restart goes on where it ended."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_new(stream: DataFrame, index: IndexTable, checkpoint: str):
    """Upsert a stream's rows into an index table, batch by batch; a batch that is repeated changes nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: index.upsert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_states(events: DataFrame) -> DataFrame:
    """A stream of events (task_id long, event_id long, ts, status) to each task's state, kept between batches: (task_id, state, events)."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (0, -1, "", 0)
        for rows in parts:
            for at, event, status in sorted(zip(rows["ts"].astype("int64"), rows["event_id"], rows["status"])):
                last = (int(at), int(event), status, last[3] + 1) if (at, event) >= last[:2] else (*last[:3], last[3] + 1)
        state.update(last)
        yield pd.DataFrame({"task_id": [key[0]], "state": [last[2]], "events": [last[3]]})

    grouped = events.select("task_id", "event_id", "ts", "status").groupBy("task_id")
    return grouped.applyInPandasWithState(step, "task_id long, state string, events long", "at long, event long, status string, n long", "update", "NoTimeout")
