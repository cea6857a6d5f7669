"""Hourly aggregates of connection rows, their scores, gates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import casts, rules
from pulseloom.schemas import C2_SCORE_MIN, HOUR_SECONDS, SAMPLE_SEED, SAMPLES_PER_LABEL

KEYS = ["src_ip", "dst_ip", "dst_port", "protocol", "service", "window_start"]


def clean_rows(rows: DataFrame, window_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Typed rows with their hour; rows without an endpoint are dropped.

    Byte counts fall back to the IP-level counts only when both are 0.
    """
    def text(*names):
        have = [F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns]
        return F.trim(F.coalesce(*have, F.lit("")))

    ts = casts.number_or_zero("ts")
    orig, resp = casts.integer_or_zero("orig_bytes"), casts.integer_or_zero("resp_bytes")
    octets = orig + resp
    if "orig_ip_bytes" in rows.columns:
        fallback = casts.integer_or_zero("orig_ip_bytes") + casts.integer_or_zero("resp_ip_bytes")
        octets = F.when((orig == 0) & (resp == 0), fallback).otherwise(octets)
    w = F.lit(window_seconds)
    label = text("mitre_attack_tactics")
    return rows.select(
        "row_no",
        "source_file",
        text("src_ip").alias("src_ip"),
        text("dest_ip", "dst_ip").alias("dst_ip"),
        text("dest_port", "dst_port").alias("dst_port"),
        F.lower(text("protocol")).alias("protocol"),
        F.lower(text("service")).alias("service"),
        F.when(ts == 0, F.lit(0)).otherwise(F.floor(ts / w) * w).cast("long").alias("window_start"),
        ts.alias("ts"),
        casts.number_or_zero("duration").alias("duration"),
        octets.alias("octets"),
        casts.integer_or_zero("orig_pkts").alias("orig_pkts"),
        casts.integer_or_zero("resp_pkts").alias("resp_pkts"),
        text("conn_state").alias("conn_state"),
        text("history").alias("history"),
        F.when(label == "", "none").otherwise(label).alias("label"),
    ).where((F.col("src_ip") != "") & (F.col("dst_ip") != ""))


def hourly_aggregates(clean: DataFrame) -> DataFrame:
    """One row per key and hour; the most frequent state, history and label, first seen on ties.

    Rows are first combined per distinct text combination, so the later steps see few rows even for
    a key that holds most of the data.
    """
    combos = clean.groupBy(*KEYS, "conn_state", "history", "label", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first"),
        F.sum("duration").alias("duration"), F.sum("octets").alias("octets"),
        F.sum("orig_pkts").alias("orig_pkts"), F.sum("resp_pkts").alias("resp_pkts"),
        F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("first_ts"),
        F.max(F.when(F.col("ts") > 0, F.col("ts"))).alias("last_ts"),
    )
    return hours_from_values(value_counts(combos, KEYS), KEYS)


_SUMS = {"duration": "total_duration", "octets": "total_bytes", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts"}
_TEXTS = ("conn_state", "history", "label", "source_file")


def value_counts(combos: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, text column and value: rows, first position, sums and times.

    ``combos`` has rows or sums of rows: ``n`` rows, the least position ``first``, sums, ``first_ts`` and ``last_ts``.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _TEXTS]))
    return (
        combos.withColumn("_f", fields).select(*combos.columns, "_f.field", "_f.value")
        .groupBy(*keys, "field", "value").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), *[F.sum(c).alias(c) for c in _SUMS],
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    )


def hours_from_values(per_value: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from the counts of its values."""
    once = F.col("field") == "label"  # every row has exactly one label
    rank = F.struct("n", (-F.col("first")).alias("f"))

    def mode(field):
        counts = (F.col("field") == field) & (F.col("value") != "")
        return F.coalesce(F.max_by(F.when(counts, F.col("value")), F.when(counts, rank)), F.lit(""))

    agg = per_value.groupBy(*keys).agg(
        F.sum(F.when(once, F.col("n"))).alias("connection_count"),
        *[F.sum(F.when(once, F.col(c))).alias(a) for c, a in _SUMS.items()],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        mode("conn_state").alias("conn_state"), mode("history").alias("history"), mode("label").alias("label"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "source_file", F.col("value")))).alias("source_files"),
    )
    window = F.coalesce(F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(0.0)), F.lit(0.0))
    n = F.col("connection_count")
    return agg.withColumn("dst_port", F.when(F.col("dst_port") == "", "unknown").otherwise(F.col("dst_port"))).withColumns({
        "active_window": window,
        "avg_interval": F.when(n > 1, window / (n - 1)).otherwise(F.lit(0.0)),
    })


def _scored(df: DataFrame) -> tuple[Column, Column]:
    return rules.c2_likelihood(
        F.col("connection_count"), F.col("active_window"), F.col("avg_interval"), F.col("total_bytes"),
        F.col("dst_port"), F.col("protocol"), F.col("service"))


def with_c2_score(aggregates: DataFrame) -> DataFrame:
    score, reasons = _scored(aggregates)
    return aggregates.withColumns({"c2_score": score, "c2_reasons": reasons})


def with_beacon_features(scored: DataFrame) -> DataFrame:
    """Heuristic beacon score, DNS and duration values and the category of a scored aggregate."""
    n = F.col("connection_count")
    is_dns = (F.col("service") == "dns") | (F.col("dst_port") == "53")
    df = scored.withColumns({
        "beacon_score": rules.heuristic_beacon_score(n, F.col("avg_interval")),
        "c2_over_dns_value": F.when(is_dns & (F.col("c2_score") >= 50), n.cast("double")).otherwise(F.lit(0.0)),
        "long_conn_value": F.greatest(
            F.col("total_duration"), F.when(n >= 5, F.col("active_window")).otherwise(F.lit(0.0))),
    })
    beacon, dns = F.col("beacon_score"), F.col("c2_over_dns_value")
    category = (
        F.when((beacon >= 90) | (dns >= 800) | (F.col("long_conn_value") >= 28800), "high")
        .when((beacon >= 70) | (dns >= 500), "medium").otherwise(F.lit("low"))
    )
    return df.withColumn("threat_category", category)


def c2_gate(scored: DataFrame, threshold: float = C2_SCORE_MIN, include_low: bool = False) -> DataFrame:
    return scored if include_low else scored.where(F.col("c2_score") >= threshold)


def labelled_only(aggregates: DataFrame) -> DataFrame:
    return aggregates.where(F.lower("label") != "none")


def sample_key(seed: int = SAMPLE_SEED) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in KEYS]), 256)


def stratified_sample(aggregates: DataFrame, per_label: int = SAMPLES_PER_LABEL, seed: int = SAMPLE_SEED) -> DataFrame:
    """The ``per_label`` smallest hashes of each label; the limit runs before the shuffle."""
    keyed = aggregates.withColumn("sample_key", sample_key(seed))
    w = Window.partitionBy("label").orderBy("sample_key")
    return keyed.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= per_label)


def sample_order(samples: DataFrame, limit: int = 0) -> DataFrame:
    """Labelled first, busiest first; optionally only the first ``limit`` rows of the report."""
    ordered = samples.orderBy(
        F.lower("label") == "none", F.desc("connection_count"), "label", "sample_key")
    return ordered.limit(limit) if limit > 0 else ordered


def rows_by(clean: DataFrame, column: str) -> DataFrame:
    return clean.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
