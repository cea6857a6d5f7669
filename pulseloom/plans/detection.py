"""Both detectors merged, with evidence and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators import highrisk, merge, scoring


def merged_threats(beacon_rows: DataFrame | None, sequence_alerts: DataFrame, mixtape: DataFrame | None = None,
                   order: str = "row_no") -> DataFrame:
    """Threats of one run; without usable beacon rows the sequence detector stands alone.

    Alerts of several captures are reduced to the highest confidence per connection first.
    """
    strongest = scoring.strongest_alerts(sequence_alerts).withColumn("ord", F.lit(0))
    sequence = merge.sequence_alerts(strongest)
    if beacon_rows is None:
        empty = merge.rule_alerts(highrisk_schema(sequence_alerts.sparkSession))
        return merge.threat_order(merge.merge_alerts(empty, sequence))
    risky = highrisk.high_risk_rows(beacon_rows, order=order).withColumn("ord", F.col(order))
    evidence = highrisk.display_evidence(beacon_rows, order)
    if mixtape is not None:
        evidence = merge.overlay_evidence(evidence, mixtape)
    return merge.threat_order(merge.merge_alerts(merge.rule_alerts(risky), sequence, evidence))


def highrisk_schema(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "ord long, src_ip string, dst_ip string, dst_port string, protocol string, beacon_score double, "
            "long_conn_value double, c2_over_dns_value double, threat_category string, connection_count long, "
            "total_bytes long")
