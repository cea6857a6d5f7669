"""Numbers and tables behind the overview page and the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.rules import RULE_DETECTOR, SEQUENCE_DETECTOR, tier

# Notes next to the key numbers.
BEACON_NOTES = ["强周期特征", "中等周期特征", "低周期特征"]
SEQUENCE_NOTES = ["高置信异常", "中等置信异常", "低置信异常"]
ATTRIBUTION_NOTES = ["较高归因可信度", "中等归因可信度", "低归因可信度"]


def key_numbers(threats: DataFrame, below_alert: DataFrame) -> DataFrame:
    """Threats, highest scores (never below 0) and threats found by both detectors.

    Rows below the alert level take part in the beacon maximum only.
    """
    has_rule = F.array_contains("detection_sources", RULE_DETECTOR)
    both = has_rule & F.array_contains("detection_sources", SEQUENCE_DETECTOR)
    zero = F.lit(0.0)
    head = threats.agg(
        F.count(F.lit(1)).alias("threat_count"),
        F.greatest(zero, F.coalesce(F.max("lstm_confidence"), zero)).alias("max_confidence"),
        F.count_if(both).alias("dual_engine_count"),
        F.max(F.when(has_rule, F.col("beacon_score"))).alias("_alerts"),
    )
    raw = below_alert.agg(F.max("beacon_score").alias("m")).scalar()
    return head.withColumn(
        "max_beacon", F.greatest(zero, F.coalesce("_alerts", zero), F.coalesce(raw, zero))).drop("_alerts")


def key_notes(max_beacon: Column, max_confidence: Column, attribution: Column) -> list[Column]:
    def note(value, texts, high, middle):
        return tier(value, [(high, texts[0]), (middle, texts[1])], texts[2])

    return [
        note(max_beacon, BEACON_NOTES, 80, 50).alias("beacon_note"),
        note(max_confidence, SEQUENCE_NOTES, 80, 50).alias("sequence_note"),
        note(attribution, ATTRIBUTION_NOTES, 70, 40).alias("attribution_note"),
    ]


def topology_nodes(threats: DataFrame, order: list[str]) -> DataFrame:
    """Distinct hosts; the role of the last mention in threat order counts, target after source."""
    at = F.struct(*order)
    ends = F.explode(F.array(
        F.struct(F.col("src_ip").alias("node"), F.lit(0).alias("role")),
        F.struct(F.col("dst_ip").alias("node"), F.lit(1).alias("role"))))
    mentions = threats.select(at.alias("at"), ends.alias("e")).select("at", "e.*")
    return mentions.groupBy("node").agg(F.max_by("role", F.struct("at", "role")).alias("role"))


def topology_edges(threats: DataFrame) -> DataFrame:
    return threats.select(
        F.col("src_ip").alias("source"), F.col("dst_ip").alias("target"), "dst_port", "protocol", "threat_category")


def top_threats(threats: DataFrame, n: int = 10) -> DataFrame:
    """The report's n strongest threats by beacon score."""
    return threats.orderBy(F.desc("beacon_score"), "src_ip", "dst_ip", "dst_port", "protocol").limit(n)


def keyword_filter(rows: DataFrame, column: str, keyword: str) -> DataFrame:
    """Literal, case-insensitive containment; a blank keyword keeps everything."""
    word = keyword.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(word))) if word else rows


def listing_totals(rows: DataFrame, page_size: int) -> DataFrame:
    """Rows and pages of a listing; an empty listing has one page."""
    n = F.count(F.lit(1))
    return rows.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / F.lit(max(1, page_size)))).cast("long")
                    .alias("total_pages"))


def history_page(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """One page, newest first, with the totals of the whole listing on every row."""
    page, size = max(1, page), max(1, page_size)
    totals = listing_totals(rows, size)
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).withColumns(
        {c: totals.select(c).scalar() for c in totals.columns})
