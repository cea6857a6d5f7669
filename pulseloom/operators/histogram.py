"""Interval histograms of the beacon tool: weighted statistics and row projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions import casts, endpoints
from pulseloom.operators.highrisk import EVIDENCE_KEYS, last_wins
from pulseloom.schemas import OLD_FEATURES


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def with_histogram_statistics(df: DataFrame, intervals: str, counts: str) -> DataFrame:
    """Add the fifteen interval statistics of one histogram; pairs with a count of 0 or less do not count.

    The steps are separate projections, so that no array is worked out more than once per row.
    """
    zipped = F.zip_with(intervals, counts, lambda v, c: F.struct(v.alias("v"), c.alias("c")))
    df = df.withColumn("_pairs", F.filter(zipped, lambda p: p["v"].isNotNull() & (p["c"] > 0)))
    df = df.withColumns({"_v": F.col("_pairs.v"), "_w": F.col("_pairs.c")})
    df = df.withColumns({
        "_n": _sum(F.col("_w")), "_total": _sum(F.transform("_pairs", lambda p: p["v"] * p["c"])),
        "_top": F.sort_array("_w", asc=False)})
    df = df.withColumn("_mean", F.when(F.col("_n") > 0, F.col("_total") / F.col("_n")))
    variance = _sum(F.transform("_pairs", lambda p: F.pow(p["v"] - F.col("_mean"), 2) * p["c"])) / F.col("_n")
    results = [F.col("_total"), F.array_min("_v"), F.array_max("_v"), F.col("_mean"), F.sqrt(variance)]
    results += [F.get("_top", F.lit(i)) / F.col("_n") for i in range(10)]
    some = F.col("_n") > 0
    return df.withColumns({
        n: F.coalesce(F.when(some, r), F.lit(0.0)) for r, n in zip(results, OLD_FEATURES)
    }).drop("_pairs", "_v", "_w", "_n", "_total", "_top", "_mean")


def histogram_features(mixtape: DataFrame) -> DataFrame:
    """Fifteen-feature rows from stored interval histograms; rows without one are left out."""
    usable = mixtape.where((F.size("ts_intervals") > 0) & (F.size("ts_interval_counts") > 0))
    usable = with_histogram_statistics(usable.withColumns({
        "_intervals": casts.numbers_or_zero(F.col("ts_intervals")),
        "_counts": casts.numbers_or_zero(F.col("ts_interval_counts")),
    }), "_intervals", "_counts")
    service = F.coalesce(F.get("port_proto_service", F.lit(0)), F.lit(""))
    parts = F.split(service, ":")
    complete = F.size(parts) >= 2
    return usable.select(
        F.coalesce("src", F.lit("")).alias("src"),
        F.coalesce("dst", F.lit("")).alias("dst"),
        F.when(complete, F.get(parts, F.lit(0))).otherwise(F.lit("")).alias("port"),
        F.when(complete, F.get(parts, F.lit(1))).otherwise(F.lit("")).alias("proto"),
        F.coalesce(F.col("count").cast("long"), F.lit(0).cast("long")).alias("packet_nb"),
        *OLD_FEATURES,
    )


def mixtape_evidence(mixtape: DataFrame, order: str = "row_no") -> DataFrame:
    """Display evidence from stored detector rows: canonical endpoints, unknown stays null."""
    def first(*names):
        have = [F.col(n) for n in names if n in mixtape.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    numeric = {f.name for f in mixtape.schema.fields if isinstance(f.dataType, T.NumericType)}

    def number(*names):
        """The first value present; text that is no number is null, numbers need no parsing."""
        have = [n for n in names if n in mixtape.columns]
        if have and all(n in numeric for n in have):
            return F.coalesce(*[F.col(n).cast("double") for n in have])
        texts = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in have]
        return casts.number_or_null(F.coalesce(*texts)) if have else F.lit(None).cast("double")

    def filled(name):
        return F.when(F.size(name) > 0, casts.numbers_or_zero(F.col(name)))

    service = F.coalesce(F.get("port_proto_service", F.lit(0)), F.lit(""))
    parts = F.split(service, ":")
    rows = mixtape.select(
        order,
        endpoints.canonical("src").alias("src"),
        endpoints.canonical("dst").alias("dst"),
        F.get(parts, F.lit(0)).alias("port"),
        F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("protocol"),
        F.nullif(first("fqdn", "domain", "hostname"), F.lit("")).alias("destination_host"),
        number("beacon_score", "score", "beacon").alias("beacon_score"),
        number("ts_score", "timestamp_score", "time_score").alias("timestamp_score"),
        number("ds_score", "datasize_score", "data_size_score").alias("datasize_score"),
        number("dur_score", "duration_score").alias("duration_score"),
        number("histogram_score", "hist_score").alias("histogram_score"),
        number("count", "connection_count").alias("connection_count"),
        number("duration", "total_duration").alias("total_duration"),
        number("total_bytes", "bytes").alias("total_bytes"),
        number("long_conn_score", "long_connection_score").alias("long_connection"),
        number("c2_over_dns_score", "c2_dns_score").alias("c2_over_dns"),
        number("subdomains", "subdomain_count").alias("subdomain_count"),
        filled("ts_intervals").alias("ts_intervals"),
        filled("ts_interval_counts").alias("ts_interval_counts"),
        filled("ds_sizes").alias("ds_sizes"),
        filled("ds_size_counts").alias("ds_size_counts"),
        first("threat_intelligence", "threat_intel_score").cast("string").alias("threat_intelligence"),
    ).where((F.col("src") != "") & (F.col("dst") != ""))
    return last_wins(rows, EVIDENCE_KEYS, order)
