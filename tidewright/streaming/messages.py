"""Streams of messages: deduplication, windows, and state of groups.

Times are TIMESTAMP_NTZ in the tables; watermarks need TIMESTAMP, so they are
cast in UTC.  A message later than the watermark is dropped by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.session import shared_dir

LATE = "90 minutes"


def source(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """Stream of the Parquet files that match `path`."""
    return spark.readStream.schema(schema).parquet(path)


def timed(df: DataFrame, time: str = "received_at") -> DataFrame:
    return df.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", LATE)


def redeliveries_removed(df: DataFrame, ident: str = "message_id") -> DataFrame:
    """Each message once, as long as its repeats come within the watermark."""
    return timed(df).dropDuplicatesWithinWatermark([ident])


def window_counts(df: DataFrame, width: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Messages by window of event time and channel."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return timed(df).groupBy(w.alias("w"), "channel").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "channel", "n")


def sender_sessions(df: DataFrame, gap: str = "20 minutes") -> DataFrame:
    """Sessions of each sender: runs of messages with no longer gap."""
    g = timed(df).groupBy(F.session_window("at", gap).alias("w"), "sender_hash").agg(F.count(F.lit(1)).alias("n"))
    return g.select("sender_hash", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tally(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running number of reports, first and last time of one sender."""
    n, first, last = state.get if state.exists else (0, None, None)
    for b in batches:
        n += len(b)
        lo, hi = int(b["us"].min()), int(b["us"].max())
        first = lo if first is None else min(first, lo)
        last = hi if last is None else max(last, hi)
    state.update((n, first, last))
    yield pd.DataFrame({"sender_hash": [key[0]], "n": [n], "first_us": [first], "last_us": [last]})


def sender_states(df: DataFrame) -> DataFrame:
    """State of each sender after each batch, by a custom stateful operator."""
    d = df.filter("sender_hash is not null and received_at is not null").select("sender_hash", F.expr("unix_micros(cast(received_at as timestamp))").alias("us"))
    out = "sender_hash string, n bigint, first_us bigint, last_us bigint"
    return d.groupBy("sender_hash").applyInPandasWithState(tally, out, "n bigint, first_us bigint, last_us bigint", "update", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, mode: str = "append", keep_last: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there, through a Parquet sink in the shared
    folder, and return what it wrote; with `keep_last` (keys), only the rows of
    the last batch that wrote each key."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number:06}")  # a repeated batch replaces itself

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/b=*")
    if keep_last:
        cols = [c for c in got.columns if c not in keep_last]
        got = got.groupBy(*keep_last).agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select(*keep_last, "r.*")
    return got.drop("_batch")
