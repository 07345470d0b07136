"""Bounded replays of the streaming rules: drain what is there, then complete what stays open.

In append mode a window is emitted once the watermark (latest event time minus the delay) has
passed its end. When a replay ends, the windows after that point are still in state. They are
computed by the same query in batch mode over just the events that can be in them, so stream
output and completion together equal the batch result and overlap nowhere."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farewatch.functions.time import epoch_seconds
from farewatch.session import ensure_checkpoint_dir
from farewatch.sources.fixture import tx_from_events


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, schema: str) -> DataFrame:
    """Drain a streaming frame with ``availableNow`` into Parquet under the checkpoint folder."""
    root = os.path.join(ensure_checkpoint_dir(spark), "farewatch", spark.sparkContext.applicationId, name)
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(root, "_checkpoint"))
         .trigger(availableNow=True).start(os.path.join(root, "out")))
    q.awaitTermination()
    return spark.read.schema(schema).parquet(os.path.join(root, "out"))


def watermark_seconds(events: DataFrame, delay_seconds: int):
    """Where the watermark of a replay of ``events`` ends, in epoch seconds (scalar subquery)."""
    return tx_from_events(events).agg(F.max(epoch_seconds("dt")) - delay_seconds).scalar()


def open_rows(events: DataFrame, width_seconds: int, delay_seconds: int) -> "TxRows":
    """The taps whose tumbling window of ``width_seconds`` ends after the final watermark."""
    tx = tx_from_events(events)
    end = (F.floor(epoch_seconds("dt") / width_seconds) + 1) * width_seconds
    return TxRows(tx.where(end > watermark_seconds(events, delay_seconds)))


class TxRows:
    """Taps that are mapped already, for a query that otherwise maps events."""

    def __init__(self, tx: DataFrame):
        self.tx = tx


def taps(source: "DataFrame | TxRows") -> DataFrame:
    return source.tx if isinstance(source, TxRows) else tx_from_events(source)
