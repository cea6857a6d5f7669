"""Tumbling hourly aggregates on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.hourly import hours_from_values, value_counts
from pulseloom.schemas import HOUR_SECONDS

KEYS = ["src_ip", "dst_ip", "dst_port", "protocol", "service"]


def hourly_stream(rows: DataFrame, lateness: str = "10 minutes", window_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Cleaned rows (``ts`` in seconds) to one row per key and hour, written when the hour is final."""
    timed = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    agg = timed.groupBy(*KEYS, F.window("event_time", f"{window_seconds} seconds")).agg(
        F.count(F.lit(1)).alias("connection_count"),
        F.sum("duration").alias("total_duration"),
        F.sum("octets").alias("total_bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    return agg.select(*KEYS, F.unix_timestamp("window.start").alias("window_start"), "connection_count",
                      "total_duration", "total_bytes", "first_ts", "last_ts")


def hourly_aggregate_stream(rows: DataFrame, lateness: str = "10 minutes", window_seconds: int = HOUR_SECONDS) -> DataFrame:
    """The whole hourly aggregate of cleaned rows, written when the hour is final: sums, the most frequent state, history and
    label (first seen on ties) and the files of every key.

    The state of an open hour is a count, a first position and sums for every distinct value, not its rows; modes are decided
    when the hour closes.  Rows without a time have no hour that could close and are left out.
    """
    keys = [*KEYS, "window"]
    timed = rows.where(F.col("ts") > 0).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    single = timed.select(
        *KEYS, F.window("event_time", f"{window_seconds} seconds").alias("window"), "conn_state", "history", "label", "source_file",
        F.lit(1).cast("long").alias("n"), F.col("row_no").alias("first"), "duration", "octets", "orig_pkts", "resp_pkts",
        F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    closed = hours_from_values(value_counts(single, keys), keys)
    return closed.withColumn("window_start", F.unix_timestamp("window.start")).drop("window", "first_ts", "last_ts")
