"""Analyse captures as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.operators.connections import connections_from_packets
from pulseloom.plans.beacons import beacon_alerts
from pulseloom.plans.hotgroups import join_null_safe
from pulseloom.schemas import GROUP_KEYS, IDLE_SECONDS, PACKETS, SORT_COLUMN
from pulseloom.session import _delete, shared_folder

#: Groups of a capture and two hosts share no connection with any other rows.
HOSTS = ["source_file", "lo_ip", "hi_ip"]


def _hosts(a: str, b: str) -> dict:
    return {"lo_ip": F.least(a, b), "hi_ip": F.greatest(a, b)}


def start_arrivals(spark: SparkSession, folder: str, out: str, threshold: float, *, checkpoint: str | None = None,
                   files_per_trigger: int = 100, available_now: bool = False,
                   idle_seconds: float = IDLE_SECONDS):
    """Watch a folder of packet tables; alerts are those of the batch plan over all packets so far.

    Every micro-batch appends its packets to ``out/packets`` and analyses the hosts that it touched again, with all
    their packets.  It writes its alerts and the hosts they stand for; :func:`current_alerts` takes the latest of each.
    So the result does not depend on how files fall into batches.  A batch that is repeated after a failure overwrites
    its own folders.
    """
    root = out.rstrip("/")

    def analyse(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.withColumns(_hosts("src_ip", "dst_ip")).write.mode("overwrite").parquet(f"{root}/packets/batch_id={batch_id}")
        own = session.read.parquet(f"{root}/packets/batch_id={batch_id}")
        own.select(*HOSTS).distinct().write.mode("overwrite").parquet(f"{root}/touched/batch_id={batch_id}")
        touched = session.read.parquet(f"{root}/touched/batch_id={batch_id}")
        # only earlier batches: a batch that runs again must not see later ones
        seen = session.read.option("basePath", f"{root}/packets").parquet(f"{root}/packets").where(F.col("batch_id") <= batch_id)
        again = join_null_safe(seen, touched, HOSTS, "left_semi").select(*PACKETS.fieldNames())
        connections = connections_from_packets(again, idle_seconds).select(*GROUP_KEYS, "conn_start", SORT_COLUMN)
        # counted by group and then scored, so they are built once
        starts = f"{root}/starts/batch_id={batch_id}"
        connections.write.mode("overwrite").parquet(starts)
        alerts = beacon_alerts(session.read.schema(connections.schema).parquet(starts), ["conn_start"], threshold)
        alerts.write.mode("overwrite").parquet(f"{root}/alerts/batch_id={batch_id}")
        _delete(session, [starts])

    stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    writer = stream.writeStream.foreachBatch(analyse).option(
        "checkpointLocation", checkpoint or f"{shared_folder(spark)}/arrivals")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The alerts that hold now: of each capture and pair of hosts those of the last batch that touched it."""
    root = out.rstrip("/")
    latest = spark.read.parquet(f"{root}/touched").groupBy(*HOSTS).agg(F.max("batch_id").alias("_latest"))
    alerts = spark.read.parquet(f"{root}/alerts").withColumns(_hosts("src", "dst"))
    joined = join_null_safe(alerts, latest, HOSTS, "inner").where(F.col("batch_id") == F.col("_latest"))
    return joined.drop("_latest", "batch_id", "lo_ip", "hi_ip")
