"""Streams run over the tables as they stand, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.tables import table
from tidewright.streaming import messages as st


def _stream(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/messages.parquet"
    schema = table(spark, root, "messages").schema
    import os

    local = path.removeprefix("file://")
    # A stream reads folders and patterns; a single file is matched by a pattern of itself.
    return st.source(spark, path if os.path.isdir(local) else f"{root}/messages.parque[t]", schema).filter("received_at is not null")


def x2_stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Messages by quarter of an hour and channel, from a stream in complete mode."""
    d = st.drained(st.window_counts(_stream(spark, root)), "complete", ["start", "channel"])
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "channel", "n")


def x5_sender_states(spark: SparkSession, root: str) -> DataFrame:
    """Last state of each sender, from a custom stateful operator."""
    return st.drained(st.sender_states(_stream(spark, root)), "update", ["sender_hash"])


SQL = {
    "x2_stream_windows": "select time_bucket(interval '15 minutes', received_at) as start, channel, count(*) as n from messages where received_at is not null group by 1, 2",
    "x5_sender_states": "select sender_hash, count(*) as n, min(epoch_us(received_at)) as first_us, max(epoch_us(received_at)) as last_us from messages where sender_hash is not null and received_at is not null group by 1",
}
QUERIES = {"x2_stream_windows": x2_stream_windows, "x5_sender_states": x5_sender_states}
