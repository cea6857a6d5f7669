"""Connection, TLS, DNS and HTTP logs: summaries, flow rows, sequences and evidence facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import casts, endpoints
from pulseloom.functions.rules import MISSING, UNKNOWN_PROTOCOL
from pulseloom.plans.hotgroups import DEFAULT, Limits, join_null_safe, spread
from pulseloom.schemas import OLD_FEATURES

PAIR = ["orig_h", "resp_h"]


def first_rows(df: DataFrame, keys: list[str], order: str, columns: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` values per key as arrays in row order.

    The row limit is applied before the shuffle, so a key of any size ships at most ``n`` rows
    per task.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    top = df.select(*keys, order, *columns).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *columns))).alias("_rows"))
    return listed.select(
        *keys, *[F.col(f"_rows.{c}").alias(c) for c in columns])


def connection_summary(conn: DataFrame) -> DataFrame:
    """Per pair: connections, total duration and bytes, mean spacing of the start times."""
    ts = casts.number_or_zero("ts")
    octets = casts.integer_or_zero("orig_bytes") + casts.integer_or_zero("resp_bytes")
    n = F.count(F.lit(1))
    return conn.groupBy(*PAIR).agg(
        n.alias("conn_count"),
        F.sum(casts.number_or_zero("duration")).alias("total_duration"),
        F.sum(octets).alias("total_bytes"),
        F.when(n > 1, (F.max(ts) - F.min(ts)) / (n - 1)).otherwise(F.lit(0.0)).alias("avg_interval"),
    )


def tls_summary(ssl: DataFrame, order: str = "row_no") -> DataFrame:
    """TLS fields of the first record per pair."""
    blank = F.lit("")
    info = F.struct(*[F.coalesce(c, blank).alias(c) for c in ("ja3", "cipher", "server_name")])
    first = ssl.groupBy(*PAIR).agg(F.min_by(info, order).alias("_t"))
    return first.select(*PAIR, F.col("_t.ja3").alias("tls_ja3"), F.col("_t.cipher").alias("tls_cipher"),
                        F.col("_t.server_name").alias("tls_server_name"))


def dns_summary(dns: DataFrame, order: str = "row_no") -> DataFrame:
    return first_rows(dns, ["orig_h"], order, ["query"]).withColumnRenamed("query", "dns_queries")


def http_summary(http: DataFrame, order: str = "row_no") -> DataFrame:
    """User agents (distinct among the first ten rows, sorted) and the first ten URIs per pair."""
    rows = first_rows(http, PAIR, order, ["user_agent", "uri"])
    return rows.select(*PAIR, F.array_sort(F.array_distinct("user_agent")).alias("http_user_agents"),
                       F.col("uri").alias("http_uris"))


def connection_details(pairs: DataFrame, conn: DataFrame, ssl: DataFrame, dns: DataFrame, http: DataFrame,
                       order: str = "row_no") -> DataFrame:
    """Details of each pair from four logs; every log is aggregated before it is joined."""
    none = F.array().cast("array<string>")
    joined = (
        pairs.join(connection_summary(conn), PAIR, "left")
        .join(tls_summary(ssl, order), PAIR, "left")
        .join(dns_summary(dns, order), ["orig_h"], "left")
        .join(http_summary(http, order), PAIR, "left")
    )
    defaults = {
        "conn_count": F.lit(0).cast("long"), "total_duration": F.lit(0.0), "total_bytes": F.lit(0).cast("long"),
        "avg_interval": F.lit(0.0), "tls_ja3": F.lit(""), "tls_cipher": F.lit(""), "tls_server_name": F.lit(""),
        "dns_queries": none, "http_user_agents": none, "http_uris": none,
    }
    return joined.select(*pairs.columns, *[F.coalesce(n, d).alias(n) for n, d in defaults.items()])


def web_flow_rows(conn: DataFrame, source: str | Column) -> DataFrame:
    """Feature rows of TCP connections to ports 80 and 443, packet gaps spread evenly."""
    duration = casts.number_or_zero("duration")
    orig, resp = casts.integer_or_zero("orig_pkts"), casts.integer_or_zero("resp_pkts")
    flows = conn.where(
        (F.col("proto") == "tcp") & F.col("resp_p").isin("80", "443")
        & (F.col("orig_h") != "") & (F.col("resp_h") != "")
    ).select(
        (F.lit(source) if isinstance(source, str) else source).alias("source_file"),
        casts.number_or_zero("ts").alias("start_time"),
        F.col("orig_h").alias("src_ip"), F.col("orig_p").alias("src_port"),
        F.col("resp_h").alias("dst_ip"), F.col("resp_p").alias("dst_port"),
        F.col("proto").alias("ip_protocol"),
        (orig + resp).alias("packet_nb"), orig.alias("packet_nb_orig"), resp.alias("packet_nb_resp"),
        duration.alias("_duration"),
    )
    return flows.select(*[c for c in flows.columns if c != "_duration"],
                        *even_gaps(F.col("_duration"), F.col("packet_nb")))


def even_gaps(duration: Column, packets: Column) -> list[Column]:
    """Interval statistics when a duration is spread evenly over the packets (float32 gap)."""
    known = (duration > 0) & (packets >= 2)
    gap = (duration / (packets - 1)).cast("float").cast("double")
    zero = F.lit(0.0)
    columns = [F.when(known, duration)] + [F.when(known, gap)] * 3 + [zero]
    columns += [F.when(known & (packets - 1 > i), gap) for i in range(10)]
    return [F.coalesce(c, zero).alias(n) for c, n in zip(columns, OLD_FEATURES)]


def series_rows(threats: DataFrame, conn: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Behaviour of every threat, one row per connection in time order.

    ``threats`` has ``threat_id, src_ip, dst_ip, dst_port``; a wildcard destination matches every
    destination of the source and port.  Blank bytes count as 0, unparsable bytes drop the row.
    The series stays in rows: an array per threat would put a busy threat into one value.
    """
    def octets(name):
        if name not in conn.columns:
            return F.lit(0).cast("long")
        text = F.trim(F.coalesce(F.col(name), F.lit("")))
        number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
        whole = number.try_cast("long")
        return F.when(whole < 0, F.lit(0).cast("long")).otherwise(whole)

    address = endpoints.canonical
    c = conn.select(
        address("orig_h").alias("_src"), address("resp_h").alias("_dst"), F.col("resp_p").alias("_port"),
        F.trim("ts").try_cast("double").alias("ts"),
        (octets("orig_bytes") + octets("resp_bytes")).alias("total_bytes"),
        *([F.col("row_no")] if "row_no" in conn.columns else [F.monotonically_increasing_id().alias("row_no")]))
    c = c.where(F.col("ts").isNotNull() & F.col("total_bytes").isNotNull())
    t = threats.select(
        "threat_id", address("src_ip").alias("_src"), address("dst_ip").alias("_dst"), F.col("dst_port").alias("_port"))
    wild = endpoints.is_wildcard(F.col("_dst"))
    exact = c.join(t.where(~wild), ["_src", "_port", "_dst"])
    loose = c.drop("_dst").join(t.where(wild).drop("_dst"), ["_src", "_port"])
    columns = ["threat_id", "ts", "row_no", "total_bytes"]
    matched = exact.select(*columns).unionByName(loose.select(*columns))
    # a threat has at most the connections of its source and port, which are counted without the join
    s = spread(matched, ["threat_id"], "ts", tie=["row_no"], rows_back=1, limits=limits,
               probe=(c, ["_src", "_port"]))
    w = s.window("ts", "row_no")
    gap = F.greatest(F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(0.0)), F.lit(0.0))
    out = s.with_df(s.df.withColumns({
        "interval_seconds": gap,
        "index": s.index(w) + 1,
    })).finish()
    return out.select(
        "threat_id", "index", "ts", "interval_seconds",
        F.when(F.col("interval_seconds") > 0, 60.0 / F.col("interval_seconds")).otherwise(F.lit(0.0))
        .alias("frequency_per_minute"),
        "total_bytes",
    )


def http_tls_facts(http: DataFrame, ssl: DataFrame, capture: str = "source_file", order: str = "row_no") -> DataFrame:
    """Per capture: request and session counts, first records, mismatches, TLS value lists."""
    def value(name):
        return casts.clean_value(name, "")

    target = F.struct("host", "resp_h", "resp_p")
    flagged = http.withColumn("_target", value("resp_h")).withColumn(
        "_mismatch", (value("host") != "") & endpoints.is_private("_target"))
    mismatch = F.col("_mismatch")
    h = flagged.groupBy(capture).agg(
        F.count(F.lit(1)).alias("http_requests"),
        F.min_by(F.struct("orig_h", "resp_h", "resp_p", "host"), order).alias("first_http"),
        F.count_if(mismatch).alias("mismatches"),
        F.min_by(F.when(mismatch, target), F.when(mismatch, F.col(order))).alias("first_mismatch"),
    )
    s = ssl.groupBy(capture).agg(
        F.count(F.lit(1)).alias("tls_sessions"),
        F.min_by(F.struct("orig_h", "resp_h", "resp_p"), order).alias("first_tls"),
    )
    # distinct first, so a list holds each value once whatever the number of sessions
    lists = {"tls_sni": "server_name", "tls_targets": "resp_h", "tls_versions": "version"}
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), value(c).alias("v")) for n, c in lists.items()]))
    distinct = ssl.select(capture, named.alias("x")).select(capture, "x.n", "x.v").where(F.col("v") != "").distinct()
    listed = distinct.groupBy(capture).agg(*[
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") == n, F.col("v")))), ", ").alias(n) for n in lists])
    joined = h.select(capture).unionByName(s.select(capture)).distinct()
    for facts in (h, s, listed):  # rows without a capture are one capture
        joined = join_null_safe(joined, facts, [capture], "left")
    n_http, n_tls = (F.coalesce(c, F.lit(0).cast("long")) for c in ("http_requests", "tls_sessions"))

    def profile(field):
        return casts.clean_value(F.coalesce(
            F.nullif(F.col(f"first_http.{field}"), F.lit("")), F.col(f"first_tls.{field}")), MISSING)

    return joined.select(
        capture,
        n_http.alias("http_requests"), n_tls.alias("tls_sessions"),
        F.when(n_http > 0, "HTTP").when(n_tls > 0, "TLS/HTTPS").otherwise(F.lit(UNKNOWN_PROTOCOL)).alias("protocol"),
        profile("orig_h").alias("source"), profile("resp_h").alias("target"), profile("resp_p").alias("port"),
        casts.clean_value(F.col("first_http.host"), MISSING).alias("first_host"),
        F.coalesce("mismatches", F.lit(0).cast("long")).alias("mismatches"),
        F.col("first_mismatch.host").alias("mismatch_host"),
        F.col("first_mismatch.resp_h").alias("mismatch_target"),
        F.col("first_mismatch.resp_p").alias("mismatch_port"),
        *[F.coalesce(n, F.lit("")).alias(n) for n in ("tls_sni", "tls_targets", "tls_versions")],
    )
