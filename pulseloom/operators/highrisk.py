"""Threshold rules on beacon-tool rows, and the nullable evidence rows for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import casts, endpoints, rules
from pulseloom.plans.hotgroups import join_null_safe
from pulseloom.session import materialise

# Accepted names per field, first match wins.
ALIASES = {
    "src": ["src", "src_ip", "source", "source_ip"],
    "dst": ["dst", "dst_ip", "destination", "destination_ip"],
    "port": ["dst_port", "port"],
    "protocol": ["protocol", "proto", "ip_protocol"],
    "severity": ["severity"],
    "beacon": ["beacon_score", "score", "beacon"],
    "long": ["long_conn_score", "long_connection_score", "duration", "total_duration"],
    "dns_score": ["c2_over_dns_score", "c2_dns_score"],
    "subdomains": ["subdomains", "subdomain_count"],
    "count": ["connection_count", "count"],
    "bytes": ["total_bytes", "bytes"],
    "ja3": ["ja3"],
    "host": ["fqdn", "domain", "hostname"],
    "timestamp_score": ["timestamp_score", "time_score"],
    "datasize_score": ["datasize_score", "data_size_score"],
    "duration_score": ["duration_score"],
    "histogram_score": ["histogram_score", "hist_score"],
    "duration": ["duration", "total_duration"],
    "long_score": ["long_conn_score", "long_connection_score"],
    "intel": ["threat_intelligence", "threat_intel_score"],
}


def pick(df: DataFrame, field: str) -> Column:
    """First non-blank of the field's aliases that exist in ``df``; null if none."""
    have = [F.col(n) for n in ALIASES.get(field, [field]) if n in df.columns]
    return casts.first_non_blank(*have) if have else F.lit(None).cast("string")


def _service(df: DataFrame) -> Column:
    return F.coalesce(casts.first_non_blank("port_proto_service"), F.lit("")) if (
        "port_proto_service" in df.columns) else F.lit("")


def port_text(df: DataFrame, missing: str) -> Column:
    blank_to_null = F.nullif(endpoints.service_port(_service(df)), F.lit(""))
    return F.coalesce(pick(df, "port"), blank_to_null, F.lit(missing))


def protocol_text(df: DataFrame) -> Column:
    return F.coalesce(pick(df, "protocol"), endpoints.service_protocol(_service(df)))


def scored_rows(df: DataFrame, capture: str = "source_file") -> DataFrame:
    """Add numeric rule inputs.  Scores of a capture whose maximum is at most 1.5 are 0-1 scores."""
    raw = df.withColumns({
        "_raw": casts.number_or_zero(pick(df, "beacon")),
        "severity_text": F.lower(F.trim(F.coalesce(pick(df, "severity"), F.lit("")))),
        "long_value": casts.number_or_zero(pick(df, "long")),
        "dns_score": casts.number_or_zero(pick(df, "dns_score")),
        "subdomain_value": casts.number_or_zero(pick(df, "subdomains")),
    })
    top = raw.groupBy(capture).agg(F.max("_raw").alias("_top"))
    # one row per capture, written first: broadcast if it is small, else a join that Spark splits on large captures
    joined = join_null_safe(raw, materialise(top), [capture], "inner")
    return joined.withColumns({
        "beacon_value": F.when(F.col("_top") <= 1.5, F.col("_raw") * 100.0).otherwise(F.col("_raw")),
        "dns_value": rules.dns_value(F.col("subdomain_value"), F.col("dns_score")),
    }).drop("_raw", "_top")


def _triggers():
    return rules.high_risk_triggers(
        F.col("beacon_value"), F.col("long_value"), F.col("dns_value"), F.col("dns_score"),
        F.col("subdomain_value"), F.col("severity_text"))


def high_risk_rows(df: DataFrame, capture: str = "source_file", order: str = "row_no") -> DataFrame:
    """Rows that meet any rule, with their reasons, category and the raw row as a map."""
    scored = scored_rows(df, capture)
    triggers = _triggers()
    raw = F.create_map(*[x for c in df.columns if c not in (capture, order) for x in (F.lit(c), F.col(c))])
    return scored.where(rules.any_of([c for c, _ in triggers])).select(
        capture,
        order,
        F.coalesce(pick(df, "src"), F.lit("unknown")).alias("src_ip"),
        F.coalesce(pick(df, "dst"), F.lit("unknown")).alias("dst_ip"),
        port_text(df, "unknown").alias("dst_port"),
        F.lower(protocol_text(df)).alias("protocol"),
        F.col("beacon_value").alias("beacon_score"),
        F.col("long_value").alias("long_conn_value"),
        F.col("dns_value").alias("c2_over_dns_value"),
        F.coalesce(pick(df, "ja3"), F.lit("")).alias("ja3"),
        casts.integer_or_zero(pick(df, "count")).alias("connection_count"),
        casts.integer_or_zero(pick(df, "bytes")).alias("total_bytes"),
        rules.threat_category(
            F.col("beacon_value"), F.col("long_value"), F.col("dns_value"), F.col("severity_text")
        ).alias("threat_category"),
        rules.chosen(triggers).alias("reasons"),
        raw.alias("raw_row"),
    )


EVIDENCE_KEYS = ["src", "dst", "port"]


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last in input order.  Partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def display_evidence(df: DataFrame, order: str = "row_no", capture: str | None = None) -> DataFrame:
    """All rows with both endpoints, missing values left null, last row per key."""
    number = {
        name: casts.number_if_present(pick(df, field)) for name, field in (
            ("beacon_score", "beacon"), ("timestamp_score", "timestamp_score"),
            ("datasize_score", "datasize_score"), ("duration_score", "duration_score"),
            ("histogram_score", "histogram_score"), ("connection_count", "count"),
            ("total_duration", "duration"), ("total_bytes", "bytes"), ("long_connection", "long_score"),
            ("c2_over_dns", "dns_score"), ("subdomain_count", "subdomains"))
    }
    keys = ([capture] if capture else []) + EVIDENCE_KEYS
    rows = df.select(
        *([capture] if capture else []),
        order,
        pick(df, "src").alias("src"),
        pick(df, "dst").alias("dst"),
        port_text(df, "").alias("port"),
        F.lower(F.nullif(protocol_text(df), F.lit(""))).alias("protocol"),
        pick(df, "host").alias("destination_host"),
        *[c.alias(n) for n, c in number.items()],
        casts.json_numbers(pick(df, "ts_intervals")).alias("ts_intervals"),
        casts.json_numbers(pick(df, "ts_interval_counts")).alias("ts_interval_counts"),
        pick(df, "intel").alias("threat_intelligence"),
        F.lit("rita_view_csv").alias("evidence_source"),
    ).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return last_wins(rows, keys, order)


def below_alert_rows(evidence: DataFrame) -> DataFrame:
    """Detector output for display only; it never enters the alert table."""
    details = F.struct(*[c for c in evidence.columns if c not in EVIDENCE_KEYS])
    return evidence.select(
        F.col("src").alias("src_ip"),
        F.col("dst").alias("dst_ip"),
        F.col("destination_host").alias("dst_host"),
        F.col("port").alias("dst_port"),
        F.coalesce("protocol", F.lit("")).alias("protocol"),
        "beacon_score", "connection_count", "total_duration", "total_bytes",
        F.lit("below_alert_threshold").alias("display_state"),
        details.alias("rita"),
    )
