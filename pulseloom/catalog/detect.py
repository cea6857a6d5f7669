"""Beacon-tool rows, logs, evidence, merge, facts and overview."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.functions import casts, endpoints, rules, texts
from pulseloom.operators import evaluation, highrisk, histogram, logs, merge, networks, overview
from pulseloom.plans.hotgroups import DEFAULT
from pulseloom.schemas import ALERT_KEYS, OLD_FEATURES
from pulseloom.sources import lines, sinks, tables

BEACON = """
b0 AS (
  SELECT o_custkey AS c, o_orderpriority AS prio, count(*) AS n, max(round(o_totalprice * 100)::BIGINT) AS top,
         min(o_orderkey) AS k FROM orders GROUP BY ALL),
b AS (
  SELECT k AS row_no, c, n, top, 'cap' || (c % 3) AS source_file,
         (['', 'High', 'low', 'critical', ' medium ', ''])[c % 6 + 1] AS severity, 'c' || c AS source_ip,
         CASE WHEN c % 10 = 0 THEN '::' WHEN c % 10 = 1 THEN '' ELSE prio END AS dst,
         CASE WHEN c % 8 = 3 THEN '' ELSE (k % 5 + 440)::VARCHAR END AS port,
         (k % 7 + 8000)::VARCHAR || CASE WHEN c % 5 = 0 THEN '' ELSE ':TCP:http' END AS pps,
         CASE WHEN c % 9 = 4 THEN 0.0::DOUBLE WHEN c % 3 = 2 THEN (top // 5000) / 100.0::DOUBLE
              ELSE (top // 5000) / 10000.0::DOUBLE END AS raw,
         (top // 12) / 100.0::DOUBLE AS long_value, (n % 4) * 0.25::DOUBLE AS dns_score,
         CASE WHEN c % 7 = 0 THEN c * 3.0::DOUBLE ELSE 0.0 END AS sub
  FROM b0),
s AS (
  SELECT *, lower(trim(severity)) AS sev, k0.beacon_value,
         CASE WHEN sub > 0 THEN sub WHEN dns_score <= 1 THEN dns_score * 1000 ELSE dns_score END AS dns_value
  FROM (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY source_file) <= 1.5 THEN raw * 100 ELSE raw END AS beacon_value
        FROM b) k0),
risky AS (
  SELECT * FROM s WHERE sev IN ('high', 'medium') OR beacon_value >= 50 OR long_value >= 14400 OR dns_value >= 500
                     OR dns_score >= 0.5 OR sub >= 100)"""
CATEGORY = """CASE WHEN sev IN ('high', 'medium', 'low', 'base') THEN sev
     WHEN beacon_value >= 100 THEN 'high' WHEN beacon_value >= 90 THEN 'medium'
     WHEN long_value >= 43200 THEN 'high' WHEN long_value >= 28800 THEN 'medium'
     WHEN dns_value >= 1000 THEN 'high' WHEN dns_value >= 800 THEN 'medium' ELSE 'low' END"""
PORT = "CASE WHEN port <> '' THEN port ELSE split_part(pps, ':', 1) END"
EVIDENCE = BEACON + f""",
ev AS (
  SELECT source_ip AS src, dst, {PORT} AS port, lower(nullif(split_part(pps, ':', 2), '')) AS protocol, raw, n, top, c,
         long_value, dns_score, sub, row_no
  FROM b WHERE dst <> ''
  QUALIFY row_number() OVER (PARTITION BY source_ip, dst, {PORT} ORDER BY row_no DESC) = 1)"""
DETECTIONS = BEACON + """,
r0 AS (
  SELECT row_no AS ord, source_ip AS src_ip, dst AS dst_ip, port AS dst_port,
         CASE WHEN c % 5 = 0 THEN '' ELSE 'tcp' END AS protocol,
         raw * 100 AS beacon_score, long_value AS long_conn_value, dns_score * 1000 AS c2_over_dns_value,
         (['low', 'medium', 'high', 'base'])[row_no % 4 + 1] AS threat_category, n AS connection_count,
         row_no AS total_bytes FROM b),
r AS (
  SELECT *, min(ord) OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol) AS first_ord FROM r0
  QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY ord DESC) = 1),
q0 AS (
  SELECT max(o_orderkey) AS ord, min(o_orderkey) AS k, o_custkey AS c, o_orderpriority AS prio FROM orders GROUP BY ALL),
q AS (
  SELECT ord, CASE WHEN c % 3 = 1 THEN 'd' ELSE 'c' END || c AS src_ip, prio AS dst_ip,
         CASE WHEN c % 8 = 3 THEN '' ELSE (k % 5 + 440)::VARCHAR END AS dst_port,
         CASE WHEN c % 6 = 0 THEN '' WHEN c % 6 = 2 THEN 'udp' ELSE 'tcp' END AS protocol,
         (ord % 1000) / 10.0::DOUBLE AS lstm_confidence, (['Low', 'Medium', 'High', 'Critical'])[ord % 4 + 1] AS lstm_risk
  FROM q0),
cand AS (
  SELECT r.src_ip, r.dst_ip, r.dst_port, r.protocol, count(q.src_ip) AS n, min(q.dst_ip) AS t_dst,
         min(q.protocol) AS t_proto
  FROM r LEFT JOIN q ON q.src_ip = r.src_ip AND q.dst_port = r.dst_port
       AND (r.dst_ip IN ('', '::', 'unknown', '-') OR q.dst_ip = r.dst_ip)
       AND (r.protocol = '' OR q.protocol = '' OR q.protocol = r.protocol)
  WHERE r.dst_ip IN ('', '::', 'unknown', '-') OR r.protocol = ''
  GROUP BY ALL),
al0 AS (
  SELECT r.* REPLACE (CASE WHEN n = 1 THEN t_dst ELSE r.dst_ip END AS dst_ip,
                      CASE WHEN n = 1 THEN t_proto ELSE r.protocol END AS protocol), coalesce(n = 1, false) AS moved
  FROM r LEFT JOIN cand ON cand.src_ip = r.src_ip AND cand.dst_ip = r.dst_ip AND cand.dst_port = r.dst_port
       AND cand.protocol = r.protocol),
al AS (
  SELECT * FROM al0
  QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, protocol ORDER BY moved DESC, first_ord DESC) = 1),
m0 AS (
  SELECT coalesce(al.src_ip, q.src_ip) AS src_ip, coalesce(al.dst_ip, q.dst_ip) AS dst_ip,
         coalesce(al.dst_port, q.dst_port) AS dst_port, coalesce(al.protocol, q.protocol) AS protocol,
         al.src_ip IS NOT NULL AS has_r, q.src_ip IS NOT NULL AS has_q,
         coalesce(beacon_score, 0) AS beacon_score, coalesce(long_conn_value, 0) AS long_conn_value,
         coalesce(c2_over_dns_value, 0) AS c2_over_dns_value, coalesce(threat_category, 'lstm_only') AS base,
         coalesce(connection_count, 0) AS connection_count, coalesce(total_bytes, 0) AS total_bytes,
         coalesce(lstm_confidence, 0) AS lstm_confidence, coalesce(lstm_risk, 'Not Detected') AS lstm_risk,
         CASE WHEN lstm_confidence >= 90 THEN 'high' WHEN lstm_confidence >= 75 THEN 'medium' ELSE 'low' END AS other
  FROM al FULL JOIN q ON al.src_ip = q.src_ip AND al.dst_ip = q.dst_ip AND al.dst_port = q.dst_port
       AND al.protocol = q.protocol),
prio(name, rank) AS (VALUES ('high', 0), ('critical', 0), ('medium', 1), ('lstm_only', 1), ('low', 2), ('base', 3),
                            ('unknown', 4)),
merged AS (
  SELECT m0.*, CASE WHEN has_r AND has_q THEN 'RITA;LSTM' WHEN has_r THEN 'RITA' ELSE 'LSTM' END AS sources,
         CASE WHEN has_q AND o.rank < p.rank THEN other ELSE base END AS threat_category
  FROM m0 JOIN prio p ON p.name = base JOIN prio o ON o.name = other)"""
LOG = """
lg AS (
  SELECT event_id AS row_no, epoch_us(ts) / 1e6 AS ts, '10.1.0.' || user_id AS orig_h, 'srv-' || event_type AS resp_h,
         (['80', '443', '53', '8443'])[event_id % 4 + 1] AS resp_p,
         CASE WHEN event_id % 4 = 2 THEN 'udp' ELSE 'tcp' END AS proto,
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS duration,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS orig_bytes,
         event_id % 3000 AS resp_bytes, event_id % 13 AS orig_pkts, event_id % 17 AS resp_pkts,
         event_id, user_id, event_type, value
  FROM events)"""
WEB = """
web AS (
  SELECT event_id AS n, 'cap' || (user_id % 5) AS source_file, '10.1.0.' || user_id AS orig_h,
         CASE WHEN event_id % 3 = 0 THEN '8.8.8.' ELSE '192.168.1.' END || json_extract(props, '$.k')::BIGINT AS resp_h,
         (['80', '443'])[event_id % 2 + 1] AS resp_p,
         CASE WHEN event_id % 4 < 2 THEN '' ELSE 'www.' || event_type END AS host,
         'ua' || (event_id % 5) AS user_agent, '/p/' || event_id AS uri, 'q' || event_id || '.example' AS query,
         'ja3-' || json_extract(props, '$.k')::BIGINT AS ja3, 'cipher-' || (event_id % 3) AS cipher,
         CASE WHEN event_id % 6 = 0 THEN '' ELSE 'sni-' || (user_id % 7) END AS sni,
         CASE WHEN event_id % 9 = 0 THEN '' ELSE (['TLSv12', 'TLSv13'])[event_id % 2 + 1] END AS version
  FROM events)"""


def beacon_rows(spark, d):
    return A.beacon_csv_from_orders(spark, d)


def _merged(spark, d):
    rule, sequence = A.detections_from_orders(spark, d)
    return merge.merge_alerts(merge.rule_alerts(rule), merge.sequence_alerts(sequence))


def _conn_log(spark, d):
    return A.log_rows_from_events(spark, d)


@query("src1_csv_after_preamble", """
SELECT 'f' || (user_id % 3) AS path, 'u' || user_id AS src_ip, value AS duration, event_type AS note FROM events""")
def src1(spark, d):
    e = A.table(spark, d, "events")
    path = F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string"))
    at = F.struct(F.lit(1).alias("block"), F.col("event_id").alias("line"))
    body = e.select(path.alias("path"), at.alias("at"), F.concat_ws(
        ",", F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("value").cast("string"),
        F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).alias("value"))
    head = e.select(path.alias("path")).distinct().select("path", F.explode(F.array(
        F.struct(F.lit(0).alias("l"), F.lit("Viewing database: x").alias("value")),
        F.struct(F.lit(1).alias("l"), F.lit("").alias("value")),
        F.struct(F.lit(2).alias("l"), F.lit("Source IP,duration,Note (x)").alias("value")))).alias("h")).select(
            "path", F.struct(F.lit(0).alias("block"), F.col("h.l").cast("long").alias("line")).alias("at"), "h.value")
    parsed = lines.parse_csv_with_preamble(body.unionByName(head))
    return parsed.select("path", F.col("source_ip").alias("src_ip"), F.col("duration").cast("double").alias("duration"),
                         F.col("note_x").alias("note"))


@query("src2_beacon_csv", """
SELECT o_orderkey AS row_no, lower(o_orderpriority) AS severity, o_totalprice AS score FROM orders""")
def src2(spark, d):
    o = A.table(spark, d, "orders")
    body = o.select(
        F.lit("f").alias("path"),
        F.struct(F.lit(1).alias("block"), F.col("o_orderkey").alias("line")).alias("at"),
        F.concat_ws(",", F.lower("o_orderpriority"), F.col("o_orderkey").cast("string"),
                    F.col("o_totalprice").cast("string")).alias("value"))
    head = o.groupBy(F.lit("f").alias("path")).agg(
        F.struct(F.lit(0).alias("block"), F.min("o_orderkey").alias("line")).alias("at"),
        F.lit("Severity,Row,Beacon Score").alias("value"))
    parsed = lines.parse_csv_with_preamble(body.unionByName(head), header_prefix="Severity,")
    return parsed.select(F.col("row").cast("long").alias("row_no"), "severity",
                         F.col("beacon_score").cast("double").alias("score"))


@query("src3_tsv_log", f"""WITH {LOG}
SELECT row_no, orig_h, resp_h, resp_p, proto, orig_bytes, CASE WHEN event_id % 2 = 0 THEN resp_bytes END AS resp_bytes
FROM lg WHERE event_id % 10 <> 9""")
def src3(spark, d):
    rows = _conn_log(spark, d)
    # two file layouts: the odd files lack the last column; every tenth row has a wrong width
    odd = F.col("row_no") % 2 == 1
    fields = [F.col(c) for c in ("ts", "orig_h", "resp_h", "resp_p", "proto", "orig_bytes")] + [
        F.col("row_no").cast("string")]
    text = F.concat_ws("\t", *fields, F.when(~odd, F.col("resp_bytes")),
                       F.when(F.col("row_no") % 10 == 9, F.lit("extra")))
    body = rows.select(F.when(odd, "odd").otherwise(F.lit("even")).alias("path"),
                       F.struct(F.lit(1).alias("block"), F.col("row_no").alias("line")).alias("at"),
                       text.alias("value"))
    names = ["#fields", "ts", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "row"]
    head = rows.select(F.when(odd, "odd").otherwise(F.lit("even")).alias("path")).distinct()
    head = head.select("path", F.struct(F.lit(0).alias("block"), F.lit(0).cast("long").alias("line")).alias("at"),
                       F.when(F.col("path") == "odd", "\t".join(names)).otherwise(
                           F.lit("\t".join([*names, "resp_bytes"]))).alias("value"))
    noise = head.withColumn("value", F.lit("#types\tstring"))
    parsed = lines.parse_tsv_logs(body.unionByName(head).unionByName(noise),
                                  {**lines.CONN_FIELDS, "row": "row_no"})
    return parsed.select(
        F.col("row_no").cast("long").alias("row_no"), "orig_h", "resp_h", "resp_p", "proto",
        F.col("orig_bytes").try_cast("long").alias("orig_bytes"), F.col("resp_bytes").try_cast("long").alias("resp_bytes"))


@query("agg8_score_scale", f"WITH {BEACON} SELECT source_file, max(raw) AS top FROM b GROUP BY ALL")
def agg8(spark, d):
    raw = casts.number_or_zero("beacon_score")
    return beacon_rows(spark, d).groupBy("source_file").agg(F.max(raw).alias("top"))


@query("sc4_scaled_score", f"WITH {BEACON} SELECT row_no, round(beacon_value, 6) AS beacon_value FROM s")
def sc4(spark, d):
    return rounded(highrisk.scored_rows(beacon_rows(spark, d)), 6, "beacon_value").select("row_no", "beacon_value")


@query("sc5_dns_value", f"WITH {BEACON} SELECT row_no, dns_value FROM s")
def sc5(spark, d):
    return highrisk.scored_rows(beacon_rows(spark, d)).select("row_no", "dns_value")


@query("sc6_threat_category", f"WITH {BEACON} SELECT row_no, {CATEGORY} AS threat_category FROM s")
def sc6(spark, d):
    s = highrisk.scored_rows(beacon_rows(spark, d))
    return s.select("row_no", rules.threat_category(
        F.col("beacon_value"), F.col("long_value"), F.col("dns_value"), F.col("severity_text")).alias("threat_category"))


@query("flt1_high_risk_rows", f"WITH {BEACON} SELECT row_no FROM risky")
def flt1(spark, d):
    return highrisk.high_risk_rows(beacon_rows(spark, d)).select("row_no")


@query("flt2_trigger_reasons", f"""WITH {BEACON}
SELECT row_no, array_to_string(list_filter([
  CASE WHEN sev IN ('high', 'medium') THEN 'severity=' || sev END, CASE WHEN beacon_value >= 70 THEN 'beacon≥70' END,
  CASE WHEN long_value >= 14400 THEN 'long_conn≥14400' END, CASE WHEN dns_value >= 500 THEN 'c2_dns≥500' END,
  CASE WHEN beacon_value >= 50 THEN 'beacon≥base(50)' END, CASE WHEN dns_score >= 0.5 THEN 'c2_dns_score≥0.5' END,
  CASE WHEN sub >= 100 THEN 'subdomain≥100' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM risky""")
def flt2(spark, d):
    return highrisk.high_risk_rows(beacon_rows(spark, d)).select(
        "row_no", F.array_join("reasons", ", ").alias("reasons"))


@query("prj14_high_risk_projection", f"""WITH {BEACON}
SELECT row_no, source_ip AS src_ip, CASE WHEN dst <> '' THEN dst ELSE 'unknown' END AS dst_ip, {PORT} AS dst_port,
       lower(split_part(pps, ':', 2)) AS protocol, round(beacon_value, 6) AS beacon_score, long_value AS long_conn_value,
       dns_value AS c2_over_dns_value, '' AS ja3, n AS connection_count,
       CASE WHEN c % 6 = 1 THEN 0 ELSE top END AS total_bytes, {CATEGORY} AS threat_category, pps AS raw_service
FROM risky""")
def prj14(spark, d):
    rows = highrisk.high_risk_rows(beacon_rows(spark, d))
    return rounded(rows, 6, "beacon_score").withColumn("raw_service", F.col("raw_row")["port_proto_service"]).drop(
        "reasons", "raw_row", "source_file")


@query("prj2_first_non_blank", f"""WITH {BEACON}
SELECT row_no, CASE WHEN dst <> '' THEN dst WHEN port <> '' THEN port ELSE pps END AS picked,
       CASE WHEN trim(severity) <> '' THEN severity ELSE source_ip END AS untrimmed FROM b""")
def prj2(spark, d):
    return beacon_rows(spark, d).select(
        "row_no", casts.first_non_blank("dst", "port", "port_proto_service").alias("picked"),
        casts.first_non_blank("severity", "source_ip").alias("untrimmed"))


@query("prj3_number_or_zero", f"""WITH {BEACON}
SELECT row_no, raw AS score, n AS connection_count, CASE WHEN c % 6 = 1 THEN 0 ELSE top END AS total_bytes FROM b""")
def prj3(spark, d):
    return beacon_rows(spark, d).select(
        "row_no", casts.number_or_zero("beacon_score").alias("score"),
        casts.integer_or_zero("connection_count").alias("connection_count"),
        casts.integer_or_zero("total_bytes").alias("total_bytes"))


@query("prj4_number_or_null", f"""WITH {BEACON}
SELECT row_no, CASE WHEN c % 9 <> 4 THEN raw END AS or_null, raw AS if_present,
       CASE WHEN c % 7 = 0 THEN sub END AS subdomains FROM b""")
def prj4(spark, d):
    return beacon_rows(spark, d).select(
        "row_no", casts.number_or_null("beacon_score").alias("or_null"),
        casts.number_if_present("beacon_score").alias("if_present"),
        casts.number_if_present("subdomains").alias("subdomains"))


@query("prj11_display_evidence", f"""WITH {EVIDENCE}
SELECT src, dst, port, protocol, raw AS beacon_score, n + 0.7::DOUBLE AS connection_count,
       CASE WHEN c % 6 = 1 THEN 0 ELSE top::DOUBLE END AS total_bytes, long_value AS total_duration,
       dns_score AS c2_over_dns, CASE WHEN c % 7 = 0 THEN sub END AS subdomain_count,
       CASE WHEN c % 4 = 0 THEN n || '.0;2.5' END AS ts_intervals, 'rita_view_csv' AS evidence_source FROM ev""")
def prj11(spark, d):
    e = highrisk.display_evidence(beacon_rows(spark, d))
    return e.select(
        "src", "dst", "port", "protocol", "beacon_score", "connection_count", "total_bytes", "total_duration",
        "c2_over_dns", "subdomain_count", F.array_join(F.col("ts_intervals").cast("array<string>"), ";")
        .alias("ts_intervals"), "evidence_source")


@query("set7_last_wins", f"WITH {EVIDENCE} SELECT src, dst, port, raw AS beacon_score FROM ev")
def set7(spark, d):
    return highrisk.display_evidence(beacon_rows(spark, d)).select("src", "dst", "port", "beacon_score")


@query("prj15_below_alert_rows", f"""WITH {EVIDENCE}
SELECT src AS src_ip, dst AS dst_ip, port AS dst_port, coalesce(protocol, '') AS protocol, raw AS beacon_score,
       'below_alert_threshold' AS display_state FROM ev""")
def prj15(spark, d):
    return highrisk.below_alert_rows(highrisk.display_evidence(beacon_rows(spark, d))).select(
        "src_ip", "dst_ip", "dst_port", "protocol", "beacon_score", "display_state")


@query("sc2_service_parts", f"""WITH {BEACON}
SELECT row_no, split_part(pps, ':', 1) AS port, split_part(pps, ':', 2) AS protocol FROM b""")
def sc2(spark, d):
    service = F.col("port_proto_service")
    return beacon_rows(spark, d).select(
        "row_no", endpoints.service_port(service).alias("port"), endpoints.service_protocol(service).alias("protocol"))


@query("sc9_report_label", f"""WITH {BEACON}
SELECT row_no, CASE sev WHEN 'high' THEN '高风险' WHEN 'medium' THEN '中风险' WHEN 'low' THEN '低风险' ELSE
  CASE WHEN c % 9 = 4 THEN '未形成可用风险判定' WHEN x >= 90 THEN '中风险' WHEN x >= 70 THEN '低风险'
       WHEN x >= 50 THEN '基础风险' ELSE '未达到 Beacon 风险告警阈值' END END AS label
FROM (SELECT *, CASE WHEN raw <= 1.5 THEN raw * 100 ELSE raw END AS x FROM s)""")
def sc9(spark, d):
    return beacon_rows(spark, d).select(
        "row_no", rules.report_risk_label(F.col("severity"), F.col("beacon_score")).alias("label"))


@query("sc22_json_numbers", f"""WITH {BEACON}
SELECT row_no, CASE WHEN c % 4 = 0 THEN n + 2.5::DOUBLE END AS total FROM b""")
def sc22(spark, d):
    values = casts.json_numbers("ts_intervals")
    return beacon_rows(spark, d).select(
        "row_no", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("sc1_column_names", "SELECT 'source_ip' AS source, count(*) AS n FROM customer GROUP BY ALL")
def sc1(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_name").alias("Source  IP"), F.col("c_custkey").alias("(id)"))
    renamed = endpoints.rename_columns(c)
    return renamed.agg(F.lit(renamed.columns[0]).alias("source"), F.count("source_ip").alias("n"))


@query("sc3_canonical_endpoint", """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN '2001:db8::' || (event_id % 7 + 1) WHEN 3 THEN 'not an address'
       ELSE '10.0.0.' || (user_id % 250) END AS endpoint FROM events""")
def sc3(spark, d):
    n = F.col("event_id")
    v4 = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))
    e = A.table(spark, d, "events").select("event_id", F.when(n % 4 == 0, F.concat(F.lit(" ::FFFF:"), v4))
        .when(n % 4 == 1, F.concat(v4, F.lit(" ")))
        .when(n % 4 == 2, F.concat(F.lit("2001:DB8:0:0:0:0:0:"), (n % 7 + 1).cast("string")))
        .otherwise(F.lit(" not an address")).alias("raw"))
    return e.select("event_id", endpoints.canonical("raw").alias("endpoint"))


@query("ud5_address_parser", """
SELECT CASE WHEN event_id % 2 = 0 THEN 'fe80::' || (user_id % 9 + 1) ELSE '192.0.2.' || (user_id % 9) END AS endpoint,
       count(*) AS n FROM events GROUP BY ALL""")
def ud5(spark, d):
    even, u = F.col("event_id") % 2 == 0, F.col("user_id") % 9
    e = A.table(spark, d, "events").select(F.when(even, F.concat(F.lit("FE80:0000::0"), (u + 1).cast("string")))
        .otherwise(F.concat(F.lit("::ffff:192.0.2."), u.cast("string"))).alias("raw"))
    return e.groupBy(endpoints.canonical_ipv6("raw").alias("endpoint")).agg(F.count(F.lit(1)).alias("n"))


@query("jn13_private_address", """
WITH a AS (SELECT event_id, (event_id * 7919) % 256 AS o1, (event_id * 104729) % 256 AS o2, user_id % 256 AS o3,
                  event_id % 256 AS o4 FROM events),
x AS (SELECT *, ((o1 * 256 + o2) * 256 + o3) * 256 + o4 AS v FROM a)
SELECT event_id, o1 || '.' || o2 || '.' || o3 || '.' || o4 AS address,
       (o1 IN (0, 10, 127) OR o1 >= 240 OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31)
        OR (o1 = 192 AND o2 = 168) OR (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 198 AND o2 IN (18, 19))
        OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113)
        OR (o1 = 192 AND o2 = 0 AND o3 = 0 AND o4 NOT IN (9, 10))) AS private
FROM x""")
def jn13(spark, d):
    n = F.col("event_id")
    parts = [(n * 7919) % 256, (n * 104729) % 256, F.col("user_id") % 256, n % 256]
    e = A.table(spark, d, "events").select("event_id", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("address"))
    return e.withColumn("private", endpoints.is_private("address"))


@query("jn13_network_lookup", """
WITH a AS (SELECT event_id, (event_id * 7919) % 256 AS o1, (event_id * 104729) % 256 AS o2, user_id % 256 AS o3,
                  event_id % 256 AS o4 FROM events),
x AS (SELECT event_id, o1 || '.' || o2 || '.' || o3 || '.' || o4 AS address, ((o1 * 256 + o2) * 256 + o3) * 256 + o4 AS v FROM a),
c AS (SELECT c_custkey, 8 + c_custkey % 17 AS bits, (c_custkey * 2654435761) % 4294967296 AS v FROM customer),
n AS (SELECT *, (v >> 24) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) || '/' || bits AS network,
             (v >> (32 - bits)) << (32 - bits) AS first, ((v >> (32 - bits)) + 1) << (32 - bits) AS past FROM c),
once AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY first, bits ORDER BY network, c_custkey) = 1),
held AS (SELECT event_id, max(bits) AS bits, arg_max(network, bits) AS network, arg_max(c_custkey, bits) AS owner
         FROM x JOIN once ON x.v >= first AND x.v < past GROUP BY event_id)
SELECT x.event_id, address, network, owner, (bits + 96)::INTEGER AS prefix_bits FROM x LEFT JOIN held USING (event_id)""")
def jn13_networks(spark, d):
    n, v = F.col("event_id"), (F.col("c_custkey") * 2654435761) % 4294967296
    parts = [(n * 7919) % 256, (n * 104729) % 256, F.col("user_id") % 256, n % 256]
    e = A.table(spark, d, "events").select("event_id", F.concat_ws(".", *[p.cast("string") for p in parts]).alias("address"))
    octets = F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    owned = A.table(spark, d, "customer").select(
        F.concat_ws("/", octets, (F.col("c_custkey") % 17 + 8).cast("string")).alias("network"), F.col("c_custkey").alias("owner"))
    return networks.with_network(e, "address", owned)


@query("agg9_histogram_statistics", f"""
WITH h AS (
  SELECT event_id, list_filter([{{'v': k * 1.0::DOUBLE, 'c': (event_id % 4)::DOUBLE}}, {{'v': k + 5.0::DOUBLE, 'c': 2.0::DOUBLE}},
         {{'v': (event_id % 9)::DOUBLE, 'c': (k % 3)::DOUBLE}}], lambda p: p.c > 0) AS p
  FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events) WHERE event_id % 6 <> 0),
t AS (SELECT event_id, p, list_sum(list_transform(p, lambda x: x.c)) AS n, list_sum(list_transform(p, lambda x: x.v * x.c)) AS w FROM h)
SELECT event_id, w AS iat_oresp_total, list_min(list_transform(p, lambda x: x.v)) AS iat_oresp_min,
       list_max(list_transform(p, lambda x: x.v)) AS iat_oresp_max, round(w / n, 6) AS iat_oresp_mean,
       round(sqrt(list_sum(list_transform(p, lambda x: (x.v - w / n) * (x.v - w / n) * x.c)) / n), 6) AS iat_oresp_stddev,
       round(list_reverse_sort(list_transform(p, lambda x: x.c / n))[1], 6) AS iat_oresp_nf_0,
       round(coalesce(list_reverse_sort(list_transform(p, lambda x: x.c / n))[2], 0), 6) AS iat_oresp_nf_1,
       round(coalesce(list_reverse_sort(list_transform(p, lambda x: x.c / n))[3], 0), 6) AS iat_oresp_nf_2,
       {", ".join(f"0.0::DOUBLE AS iat_oresp_nf_{i}" for i in range(3, 10))}
FROM t""")
def agg9(spark, d):
    m = A.mixtape_from_events(spark, d).where(F.size("ts_intervals") > 0)
    out = histogram.with_histogram_statistics(m, "ts_intervals", "ts_interval_counts").withColumnRenamed("row_no", "event_id")
    return rounded(out, 6, *OLD_FEATURES[3:]).select("event_id", *OLD_FEATURES)


@query("sc24_top_frequencies", """
WITH h AS (
  SELECT event_id, list_filter([(event_id % 4)::DOUBLE, 2.0::DOUBLE, (json_extract(props, '$.k')::BIGINT % 3)::DOUBLE],
         lambda c: c > 0) AS c FROM events WHERE event_id % 6 <> 0)
SELECT event_id, round(list_reverse_sort(c)[1] / list_sum(c), 6) AS first,
       round(coalesce(list_reverse_sort(c)[2] / list_sum(c), 0), 6) AS second FROM h""")
def sc24(spark, d):
    m = A.mixtape_from_events(spark, d).where(F.size("ts_intervals") > 0)
    return histogram.with_histogram_statistics(m, "ts_intervals", "ts_interval_counts").select(
        F.col("row_no").alias("event_id"), F.round("iat_oresp_nf_0", 6).alias("first"), F.round("iat_oresp_nf_1", 6).alias("second"))


@query("sc23_array_cast", """
SELECT event_id, user_id::DOUBLE + value AS total, 3 AS n FROM events""")
def sc23(spark, d):
    e = A.table(spark, d, "events")
    values = F.array(F.col("user_id").cast("string"), F.lit("x"), F.col("value").cast("string"))
    numbers = casts.numbers_or_zero(values)
    return e.select("event_id", F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"),
                    F.size(numbers).alias("n"))


@query("prj10_histogram_rows", f"""
WITH h AS (
  SELECT *, list_filter([{{'v': k * 1.0::DOUBLE, 'c': (event_id % 4)::DOUBLE}}, {{'v': k + 5.0::DOUBLE, 'c': 2.0::DOUBLE}},
         {{'v': (event_id % 9)::DOUBLE, 'c': (k % 3)::DOUBLE}}], lambda p: p.c > 0) AS p
  FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) WHERE event_id % 6 <> 0),
t AS (SELECT *, list_sum(list_transform(p, lambda x: x.c)) AS n, list_sum(list_transform(p, lambda x: x.v * x.c)) AS w FROM h),
f AS (
  SELECT *, w AS total, list_min(list_transform(p, lambda x: x.v)) AS lo, list_max(list_transform(p, lambda x: x.v)) AS hi, w / n AS mean,
         sqrt(list_sum(list_transform(p, lambda x: (x.v - w / n) * (x.v - w / n) * x.c)) / n) AS dev,
         list_reverse_sort(list_transform(p, lambda x: x.c / n)) AS nf FROM t)
SELECT CASE WHEN event_id % 2 = 0 THEN '::ffff:10.2.0.' ELSE ' 10.2.0.' END || (user_id % 250) AS src,
       CASE WHEN event_id % 4 >= 2 THEN (event_id % 3 + 80)::VARCHAR ELSE '' END AS port,
       CASE WHEN event_id % 4 >= 2 THEN 'tcp' ELSE '' END AS proto, k AS packet_nb, count(*) AS n,
       round(sum(total), 4) AS iat_oresp_total, round(sum(lo), 4) AS iat_oresp_min, round(sum(hi), 4) AS iat_oresp_max,
       round(sum(mean), 4) AS iat_oresp_mean, round(sum(dev), 4) AS iat_oresp_stddev,
       {", ".join(f"round(sum(coalesce(nf[{i + 1}], 0)), 4) AS iat_oresp_nf_{i}" for i in range(10))}
FROM f GROUP BY ALL""")
def prj10(spark, d):
    rows = histogram.histogram_features(A.mixtape_from_events(spark, d))
    return rows.groupBy("src", "port", "proto", "packet_nb").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in OLD_FEATURES])


MIX = """
mix AS (
  SELECT event_id, '10.2.0.' || (user_id % 250) AS src,
         CASE WHEN event_id % 5 = 0 THEN '::' ELSE '172.16.0.' || k END AS dst,
         CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '8080' ELSE (event_id % 3 + 80)::VARCHAR END AS port,
         CASE WHEN event_id % 4 >= 2 THEN 'tcp' END AS protocol, CASE WHEN event_id % 3 = 0 THEN 'host' || k END AS host,
         value, k, event_id % 7 <> 0 AS has_ts, event_id % 6 <> 0 AS has_intervals
  FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)
  QUALIFY row_number() OVER (PARTITION BY 2, 3, 4 ORDER BY event_id DESC) >= 1),
mixed AS (
  SELECT * FROM mix QUALIFY row_number() OVER (PARTITION BY src, dst, port ORDER BY event_id DESC) = 1)"""


@query("prj12_mixtape_evidence", f"""WITH {MIX}
SELECT src, dst, port, protocol, host AS destination_host, round(value / 100, 8) AS beacon_score,
       CASE WHEN has_ts THEN round(value / 200, 8) END AS timestamp_score, round(value / 500, 8) AS histogram_score,
       k::DOUBLE AS connection_count, value AS total_duration, (k * 10)::DOUBLE AS total_bytes,
       CASE WHEN has_intervals THEN 3 END AS n_intervals
FROM mixed""")
def prj12(spark, d):
    e = histogram.mixtape_evidence(A.mixtape_from_events(spark, d))
    return rounded(e, 8, "beacon_score", "timestamp_score", "histogram_score").select(
        "src", "dst", "port", "protocol", "destination_host", "beacon_score", "timestamp_score", "histogram_score",
        "connection_count", "total_duration", "total_bytes", F.size("ts_intervals").alias("n_intervals"))


@query("jn4_evidence_overlay", f"""WITH {MIX},
csv AS (
  SELECT '10.2.0.' || (o_custkey % 250) AS src, '172.16.0.' || (o_orderkey % 100) AS dst,
         (o_orderkey % 3 + 80)::VARCHAR AS port, max(o_orderkey) AS row_no
  FROM orders GROUP BY ALL)
SELECT coalesce(m.src, c.src) AS src, coalesce(m.dst, c.dst) AS dst, coalesce(m.port, c.port) AS port,
       round(coalesce(CASE WHEN m.has_ts THEN m.value / 200 END, c.row_no), 8) AS timestamp_score,
       coalesce(m.k::DOUBLE, c.row_no) AS connection_count,
       CASE WHEN m.src IS NOT NULL THEN 'rita_mixtape' ELSE 'rita_view_csv' END AS evidence_source
FROM mixed m FULL JOIN csv c ON m.src = c.src AND m.dst = c.dst AND m.port = c.port""")
def jn4(spark, d):
    mix = histogram.mixtape_evidence(A.mixtape_from_events(spark, d)).select(
        "src", "dst", "port", "timestamp_score", "connection_count")
    o = A.table(spark, d, "orders")
    csv = o.groupBy(
        F.concat(F.lit("10.2.0."), (F.col("o_custkey") % 250).cast("string")).alias("src"),
        F.concat(F.lit("172.16.0."), (F.col("o_orderkey") % 100).cast("string")).alias("dst"),
        (F.col("o_orderkey") % 3 + 80).cast("string").alias("port"),
    ).agg(F.max("o_orderkey").cast("double").alias("timestamp_score")).withColumns({
        "connection_count": F.col("timestamp_score"), "evidence_source": F.lit("rita_view_csv")})
    return rounded(merge.overlay_evidence(csv, mix), 8, "timestamp_score").select(
        "src", "dst", "port", "timestamp_score", "connection_count", "evidence_source")


TOLERANT = MIX + """,
csv AS (
  SELECT '10.2.0.' || (o_custkey % 250) AS src,
         CASE o_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '::' ELSE '172.16.0.' || (o_orderkey % 100) END AS dst,
         CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_orderkey % 3 + 80)::VARCHAR END AS port, min(o_orderkey) AS ord
  FROM orders GROUP BY ALL),
hit AS (
  SELECT m.src, m.dst, m.port, min(c.ord) AS csv_order
  FROM mixed m LEFT JOIN csv c ON c.src = m.src AND c.port IN ('', m.port)
       AND (c.dst = m.dst OR c.dst IN ('', '::') OR m.dst IN ('', '::'))
  GROUP BY ALL),
target AS (
  SELECT h.src, h.dst, h.port, h.csv_order, coalesce(c.dst, h.dst) AS target_dst, coalesce(nullif(c.port, ''), h.port) AS target_port
  FROM hit h LEFT JOIN csv c ON c.ord = h.csv_order)"""


def _tolerant_sides(spark, d):
    mix = histogram.mixtape_evidence(A.mixtape_from_events(spark, d)).select("src", "dst", "port", "connection_count")
    o = A.table(spark, d, "orders")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    csv = o.groupBy(
        F.concat(F.lit("10.2.0."), (c % 250).cast("string")).alias("src"),
        F.when(c % 6 == 0, "").when(c % 6 == 1, "::").otherwise(
            F.concat(F.lit("172.16.0."), (k % 100).cast("string"))).alias("dst"),
        F.when(k % 4 == 0, "").otherwise((k % 3 + 80).cast("string")).alias("port"),
    ).agg(F.min("o_orderkey").alias("ord"))
    return csv, mix


@query("jn5_tolerant_overlay", f"WITH {TOLERANT} SELECT * FROM target")
def jn5(spark, d):
    csv, mix = _tolerant_sides(spark, d)
    return merge.tolerant_matches(csv, mix).select("src", "dst", "port", "csv_order", "target_dst", "target_port")


@query("jn5_overlay", f"""WITH {TOLERANT},
moved AS (
  SELECT t.src, target_dst AS dst, target_port AS port, min(csv_order) AS csv_order,
         arg_max(k::DOUBLE, (t.src, t.dst, t.port)) AS stored
  FROM target t JOIN mixed m ON m.src = t.src AND m.dst = t.dst AND m.port = t.port GROUP BY ALL),
filled AS (
  SELECT c.src, c.dst, coalesce(nullif(c.port, ''), m.port, '') AS port, c.ord
  FROM csv c LEFT JOIN moved m ON m.csv_order = c.ord),
base AS (SELECT src, dst, port, max(ord) AS ord FROM filled GROUP BY ALL)
SELECT coalesce(m.src, b.src) AS src, coalesce(m.dst, b.dst) AS dst, coalesce(m.port, b.port) AS port,
       coalesce(m.stored, b.ord) AS connection_count, CASE WHEN m.src IS NOT NULL THEN 'rita_mixtape' ELSE 'rita_view_csv' END AS evidence_source
FROM moved m FULL JOIN base b ON m.src = b.src AND m.dst = b.dst AND m.port = b.port""")
def jn5_overlay(spark, d):
    csv, mix = _tolerant_sides(spark, d)
    csv = csv.withColumns({"connection_count": F.col("ord").cast("double"), "evidence_source": F.lit("rita_view_csv")})
    return merge.overlay_tolerant(csv, mix).select("src", "dst", "port", "connection_count", "evidence_source")


@query("prj8_web_flow_rows", f"""WITH {LOG}
SELECT 'log' AS source_file, orig_h AS src_ip, resp_h AS dst_ip, resp_p AS dst_port, round(ts, 6) AS start_time,
       orig_pkts + resp_pkts AS packet_nb, orig_pkts AS packet_nb_orig, resp_pkts AS packet_nb_resp
FROM lg WHERE proto = 'tcp' AND resp_p IN ('80', '443')""")
def prj8(spark, d):
    rows = rounded(logs.web_flow_rows(_conn_log(spark, d), "log"), 6, "start_time")
    return rows.select("source_file", "src_ip", "dst_ip", "dst_port", "start_time", "packet_nb", "packet_nb_orig",
                       "packet_nb_resp")


@query("prj9_even_packet_gaps", f"""WITH {LOG},
e AS (SELECT *, orig_pkts + resp_pkts AS n, duration > 0 AND orig_pkts + resp_pkts >= 2 AS known FROM lg
      WHERE proto = 'tcp' AND resp_p IN ('80', '443')),
g AS (SELECT *, CASE WHEN known THEN round((duration / (n - 1))::FLOAT::DOUBLE, 5) ELSE 0 END AS gap FROM e)
SELECT row_no, CASE WHEN known THEN duration ELSE 0 END AS iat_oresp_total, gap AS iat_oresp_mean,
       0.0::DOUBLE AS iat_oresp_stddev, gap AS iat_oresp_nf_0, CASE WHEN n - 1 > 9 THEN gap ELSE 0 END AS iat_oresp_nf_9
FROM g""")
def prj9(spark, d):
    conn = _conn_log(spark, d)
    rows = logs.web_flow_rows(conn, F.col("row_no").cast("string"))
    out = rounded(rows, 5, "iat_oresp_mean", "iat_oresp_nf_0", "iat_oresp_nf_9")
    return out.select(F.col("source_file").cast("long").alias("row_no"), "iat_oresp_total", "iat_oresp_mean",
                      "iat_oresp_stddev", "iat_oresp_nf_0", "iat_oresp_nf_9")


DETAILS = LOG + "," + WEB + """,
pairs AS (SELECT DISTINCT orig_h, resp_h FROM lg UNION SELECT DISTINCT orig_h, resp_h FROM web),
cs AS (
  SELECT orig_h, resp_h, count(*) AS conn_count, sum(duration) AS total_duration,
         sum(coalesce(orig_bytes, 0) + resp_bytes)::BIGINT AS total_bytes,
         CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) / (count(*) - 1) ELSE 0 END AS avg_interval
  FROM lg GROUP BY ALL),
ts AS (SELECT orig_h, resp_h, arg_min(ja3, n) AS tls_ja3, arg_min(cipher, n) AS tls_cipher FROM web GROUP BY ALL),
ds AS (SELECT orig_h, string_agg(query, ';' ORDER BY n) AS dns FROM (
         SELECT * FROM web QUALIFY row_number() OVER (PARTITION BY orig_h ORDER BY n) <= 10) GROUP BY ALL),
hs AS (SELECT orig_h, resp_h, array_to_string(list_sort(list_distinct(list(user_agent))), ';') AS agents,
              string_agg(uri, ';' ORDER BY n) AS uris FROM (
         SELECT * FROM web QUALIFY row_number() OVER (PARTITION BY orig_h, resp_h ORDER BY n) <= 10) GROUP BY ALL)"""


@query("agg5_log_summaries", f"""WITH {DETAILS}
SELECT orig_h, resp_h, conn_count, round(total_duration, 4) AS total_duration, total_bytes,
       round(avg_interval, 4) AS avg_interval FROM cs""")
def agg5(spark, d):
    return rounded(logs.connection_summary(_conn_log(spark, d)), 4, "total_duration", "avg_interval")


@query("jn7_connection_details", f"""WITH {DETAILS}
SELECT p.orig_h, p.resp_h, coalesce(conn_count, 0) AS conn_count, coalesce(total_bytes, 0) AS total_bytes,
       coalesce(tls_ja3, '') AS tls_ja3, coalesce(tls_cipher, '') AS tls_cipher, coalesce(dns, '') AS dns_queries,
       coalesce(agents, '') AS http_user_agents, coalesce(uris, '') AS http_uris
FROM pairs p LEFT JOIN cs USING (orig_h, resp_h) LEFT JOIN ts USING (orig_h, resp_h) LEFT JOIN ds USING (orig_h)
     LEFT JOIN hs USING (orig_h, resp_h)""")
def jn7(spark, d):
    conn, web = _conn_log(spark, d), A.web_logs_from_events(spark, d)
    pairs = conn.select(*logs.PAIR).union(web.select(*logs.PAIR)).distinct()
    out = logs.connection_details(pairs, conn, web, web, web)
    return out.select("orig_h", "resp_h", "conn_count", "total_bytes", "tls_ja3", "tls_cipher", *[
        F.array_join(c, ";").alias(c) for c in ("dns_queries", "http_user_agents", "http_uris")])


SERIES = LOG + """,
threats AS (SELECT DISTINCT orig_h AS s, CASE WHEN resp_p = '443' THEN '::' ELSE resp_h END AS t, resp_p AS p FROM lg),
matched AS (
  SELECT s || '|' || t || '|' || p AS threat_id, row_no, ts, orig_bytes + resp_bytes AS total_bytes
  FROM threats JOIN lg ON orig_h = s AND resp_p = p AND (t = '::' OR resp_h = t) WHERE orig_bytes IS NOT NULL),
series AS (
  SELECT *, row_number() OVER w AS index, greatest(0.0::DOUBLE, coalesce(ts - lag(ts) OVER w, 0.0::DOUBLE)) AS gap
  FROM matched WINDOW w AS (PARTITION BY threat_id ORDER BY ts, row_no))"""


def _series(spark, d):
    conn = _conn_log(spark, d)
    threats = conn.select(
        F.col("orig_h").alias("src_ip"), F.when(F.col("resp_p") == "443", "::").otherwise(F.col("resp_h")).alias("dst_ip"),
        F.col("resp_p").alias("dst_port")).distinct()
    threats = threats.withColumn("threat_id", F.concat_ws("|", "src_ip", "dst_ip", "dst_port"))
    return logs.series_rows(threats, conn, DEFAULT)


@query("win7_behaviour_series", f"""WITH {SERIES}
SELECT threat_id, index, round(gap, 6) AS interval_seconds,
       round(CASE WHEN gap > 0 THEN 60 / gap ELSE 0 END, 6) AS frequency_per_minute, total_bytes FROM series""")
def win7(spark, d):
    out = rounded(_series(spark, d), 6, "interval_seconds", "frequency_per_minute")
    return out.select("threat_id", "index", "interval_seconds", "frequency_per_minute", "total_bytes")


@query("jn6_threat_connections", f"""WITH {SERIES}
SELECT threat_id, count(*) AS connections, sum(total_bytes)::BIGINT AS total_bytes FROM series GROUP BY ALL""")
def jn6(spark, d):
    return _series(spark, d).groupBy("threat_id").agg(
        F.count(F.lit(1)).alias("connections"), F.sum("total_bytes").alias("total_bytes"))


@query("jn2_wildcard_alignment", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, total_bytes FROM al""")
def jn2(spark, d):
    rule, sequence = A.detections_from_orders(spark, d)
    return merge.align_wildcards(merge.rule_alerts(rule), merge.sequence_alerts(sequence)).select(
        *ALERT_KEYS, "total_bytes")


@query("jn1_detector_merge", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, sources AS detection_sources, round(beacon_score, 6) AS beacon_score,
       long_conn_value, c2_over_dns_value, threat_category, connection_count, total_bytes, lstm_confidence, lstm_risk
FROM merged""")
def jn1(spark, d):
    return rounded(_merged(spark, d), 6, "beacon_score").withColumn(
        "detection_sources", F.array_join("detection_sources", ";"))


@query("sc8_merged_category", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, threat_category, rank AS priority FROM merged JOIN prio ON name = threat_category""")
def sc8(spark, d):
    return _merged(spark, d).select(
        *ALERT_KEYS, "threat_category", rules.priority(F.col("threat_category")).alias("priority"))


@query("top2_threat_order", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, threat_category, lstm_confidence, round(beacon_score, 6) AS beacon_score
FROM merged JOIN prio ON name = threat_category
ORDER BY rank, lstm_confidence DESC, merged.beacon_score DESC, src_ip, dst_ip, dst_port, protocol""")
def top2(spark, d):
    return rounded(merge.threat_order(_merged(spark, d)), 6, "beacon_score").select(*ALERT_KEYS, "threat_category", "lstm_confidence", "beacon_score")


@query("top5_strongest_threats", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, round(beacon_score, 6) AS beacon_score FROM merged
ORDER BY merged.beacon_score DESC, src_ip, dst_ip, dst_port, protocol LIMIT 10""")
def top5(spark, d):
    return rounded(overview.top_threats(_merged(spark, d)), 6, "beacon_score").select(*ALERT_KEYS, "beacon_score")


@query("set2_connection_keys", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol FROM r UNION SELECT src_ip, dst_ip, dst_port, protocol FROM q""")
def set2(spark, d):
    rule, sequence = A.detections_from_orders(spark, d)
    return merge.connection_keys(merge.rule_alerts(rule), merge.sequence_alerts(sequence))


@query("jn3_evidence_lookup", f"""WITH {EVIDENCE},
keys AS (SELECT DISTINCT source_ip AS src_ip, prio2 AS dst_ip, {PORT} AS dst_port
         FROM (SELECT *, CASE WHEN row_no % 3 = 0 THEN 'elsewhere' ELSE dst END AS prio2 FROM b)),
wild AS (SELECT src, port, count(*) AS n, min(raw) AS raw FROM ev WHERE dst IN ('', '::', 'unknown', '-') GROUP BY ALL)
SELECT k.src_ip, k.dst_ip, k.dst_port, CASE WHEN e.src IS NOT NULL THEN e.raw WHEN w.n = 1 THEN w.raw END AS beacon_score
FROM keys k LEFT JOIN ev e ON e.src = k.src_ip AND e.dst = k.dst_ip AND e.port = k.dst_port
     LEFT JOIN wild w ON w.src = k.src_ip AND w.port = k.dst_port""")
def jn3(spark, d):
    rows = beacon_rows(spark, d)
    evidence = highrisk.display_evidence(rows)
    dst = F.when(F.col("row_no") % 3 == 0, "elsewhere").otherwise(F.col("dst"))
    keys = rows.select(F.col("source_ip").alias("src_ip"), dst.alias("dst_ip"),
                       highrisk.port_text(rows, "").alias("dst_port")).distinct()
    found = merge.attach_evidence(keys, evidence)
    return found.select("src_ip", "dst_ip", "dst_port", F.col("rita.beacon_score").alias("beacon_score"))


@query("agg22_detector_counts", f"WITH {DETECTIONS} SELECT sources AS detection_sources, count(*) AS threats FROM merged GROUP BY ALL")
def agg22(spark, d):
    return evaluation.source_counts(_merged(spark, d))


@query("agg17_key_numbers", f"""WITH {DETECTIONS}
SELECT count(*) AS threat_count, max(lstm_confidence) AS max_confidence, count(*) FILTER (has_r AND has_q) AS dual_engine_count,
       round(greatest(max(beacon_score) FILTER (has_r), (SELECT max(raw) FROM b WHERE dst <> '')), 6) AS max_beacon
FROM merged""")
def agg17(spark, d):
    below = highrisk.below_alert_rows(highrisk.display_evidence(beacon_rows(spark, d)))
    return rounded(overview.key_numbers(_merged(spark, d), below), 6, "max_beacon")


@query("sc32_key_notes", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol,
       CASE WHEN beacon_score >= 80 THEN '强周期特征' WHEN beacon_score >= 50 THEN '中等周期特征' ELSE '低周期特征' END AS beacon_note,
       CASE WHEN lstm_confidence >= 80 THEN '高置信异常' WHEN lstm_confidence >= 50 THEN '中等置信异常' ELSE '低置信异常' END AS sequence_note,
       CASE WHEN connection_count >= 70 THEN '较高归因可信度' WHEN connection_count >= 40 THEN '中等归因可信度' ELSE '低归因可信度' END AS attribution_note
FROM merged""")
def sc32(spark, d):
    notes = overview.key_notes(F.col("beacon_score"), F.col("lstm_confidence"), F.col("connection_count"))
    return _merged(spark, d).select(*ALERT_KEYS, *notes)


@query("agg18_topology_nodes", f"""WITH {DETECTIONS},
ends AS (
  SELECT src_ip AS node, 0 AS role, row_number() OVER (ORDER BY src_ip, dst_ip, dst_port, protocol) AS at1 FROM merged
  UNION ALL
  SELECT dst_ip, 1, row_number() OVER (ORDER BY src_ip, dst_ip, dst_port, protocol) FROM merged)
SELECT node, arg_max(role, at1 * 2 + role) AS role FROM ends GROUP BY ALL""")
def agg18(spark, d):
    return overview.topology_nodes(_merged(spark, d), ALERT_KEYS)


@query("agg18_topology_edges", f"""WITH {DETECTIONS}
SELECT src_ip AS source, dst_ip AS target, dst_port, protocol, threat_category FROM merged""")
def agg18_edges(spark, d):
    return overview.topology_edges(_merged(spark, d))


@query("snk4_export_rows", f"""WITH {DETECTIONS}
SELECT 'c' || (rank % 2) AS source_file, threat_category, sources AS detection_sources, count(*) AS n
FROM merged JOIN prio ON name = threat_category GROUP BY ALL""")
def snk4(spark, d):
    m = _merged(spark, d)
    m = m.withColumn("source_file", F.concat(F.lit("c"), (rules.priority(F.col("threat_category")) % 2).cast("string")))
    out = sinks.flat(sinks.export_rows(m))
    parsed = tables.parse_merged_threats(out)
    return parsed.groupBy("source_file", "threat_category", F.array_join("detection_sources", ";")
                          .alias("detection_sources")).agg(F.count("threat_index").alias("n"))


@query("src10_merged_threat_rows", f"""WITH {DETECTIONS}
SELECT src_ip, dst_ip, dst_port, protocol, round(beacon_score, 6) AS beacon_score, total_bytes, 'x.pcap' AS source_file,
       'mixed' AS dataset_label FROM merged""")
def src10(spark, d):
    m = _merged(spark, d).withColumn("source_file", F.lit("x.pcap"))
    rows = sinks.flat(sinks.export_rows(m)).withColumn("dataset_label", F.lit("mixed"))
    parsed = tables.parse_merged_threats(rows)
    return rounded(parsed, 6, "beacon_score").select(
        *ALERT_KEYS, "beacon_score", "total_bytes", "source_file", "dataset_label")


FACTS = WEB + """,
flag AS (SELECT *, host <> '' AND resp_h LIKE '192.168.%' AS mismatch FROM web),
f AS (
  SELECT source_file, count(*) AS http_requests, count(*) AS tls_sessions, count(*) FILTER (mismatch) AS mismatches,
         arg_min(orig_h, n) AS source, arg_min(resp_h, n) AS target, arg_min(resp_p, n) AS port,
         arg_min(host, n) AS h0, arg_min(host, n) FILTER (mismatch) AS mismatch_host,
         arg_min(resp_h, n) FILTER (mismatch) AS mismatch_target,
         array_to_string(list_sort(list_distinct(list(sni) FILTER (sni <> ''))), ', ') AS tls_sni,
         array_to_string(list_sort(list_distinct(list(resp_h))), ', ') AS tls_targets,
         array_to_string(list_sort(list_distinct(list(version) FILTER (version <> ''))), ', ') AS tls_versions
  FROM flag GROUP BY source_file)"""


@query("agg16_evidence_facts", f"""WITH {FACTS}
SELECT source_file, http_requests, tls_sessions, 'HTTP' AS protocol, source, target, port,
       CASE WHEN h0 = '' THEN '未记录' ELSE h0 END AS first_host, mismatches, mismatch_host, mismatch_target,
       tls_sni, tls_targets, tls_versions FROM f""")
def agg16(spark, d):
    web = A.web_logs_from_events(spark, d)
    return logs.http_tls_facts(web, web).drop("mismatch_port")


@query("sc28_behaviour_techniques", f"""WITH {FACTS}
SELECT source_file, 'T1071.001' || CASE WHEN mismatches > 0 THEN ';T1036' ELSE '' END AS techniques FROM f""")
def sc28(spark, d):
    from pulseloom.operators import facts

    web = A.web_logs_from_events(spark, d)
    f = logs.http_tls_facts(web, web)
    return f.select("source_file", F.array_join(
        facts.behaviour_techniques(F.col("http_requests"), F.col("mismatches")), ";").alias("techniques"))


@query("agg16_findings", f"""WITH {FACTS}
SELECT source_file, CASE WHEN mismatches > 0 THEN '服务身份与真实目标不一致 HTTP Host 为 `' || mismatch_host || '`，实际连接目标为 `' || mismatch_target || ':' ||
         (SELECT arg_min(resp_p, n) FROM flag WHERE mismatch AND flag.source_file = f.source_file) || '`。' ELSE '' END AS abnormal,
       CASE WHEN mismatches = 0 THEN 'HTTP 通信已被识别 共记录 ' || http_requests || ' 条 HTTP 请求，主要 Host 为 `' ||
            CASE WHEN h0 = '' THEN '未记录' ELSE h0 END || '`。|' ELSE '' END || 'TLS 服务信息可识别 SNI 为 `' || tls_sni || '`，目标地址为 `' ||
         tls_targets || '`，协议版本为 `' || tls_versions || '`。|时序检测未告警 ' AS benign FROM f""")
def agg16_findings(spark, d):
    from pulseloom.operators import facts

    web = A.web_logs_from_events(spark, d)
    f = logs.http_tls_facts(web, web).withColumn("sequence_state", F.lit("normal"))
    abnormal, benign = facts.findings()

    def text(values):
        return F.array_join(F.transform(values, lambda x: F.concat(x["finding"], F.lit(" "), x["evidence"])), "|")

    return f.select("source_file", text(abnormal).alias("abnormal"), text(benign).alias("benign"))


@query("sc26_overall_decision", f"""WITH {DETECTIONS},
t AS (SELECT src_ip, count(*) FILTER (threat_category = 'high') AS n FROM merged GROUP BY ALL)
SELECT src_ip, CASE WHEN n > 0 THEN 'malicious_c2' ELSE 'benign_or_low_risk' END AS classification,
       CASE WHEN n > 0 THEN '恶意 C2 通信' ELSE '未发现 C2 证据的低风险通信' END AS verdict,
       CASE WHEN n > 0 THEN '高危' ELSE '低危' END AS risk_level, '中' AS confidence FROM t""")
def sc26(spark, d):
    t = _merged(spark, d).groupBy("src_ip").agg(F.count_if(F.col("threat_category") == "high").alias("n"))
    return t.select("src_ip", rules.overall_decision(F.col("n")).alias("x")).select("src_ip", "x.*")


@query("sc27_sequence_state", """
WITH t AS (SELECT user_id, count(*) AS n, (['completed', 'insufficient_sequence', 'failed', 'unavailable', 'completed'])[user_id % 5 + 1] AS status,
                  count(*) FILTER (value > 100) AS hits FROM events GROUP BY ALL)
SELECT user_id, CASE WHEN status <> 'completed' THEN 'not_evaluated' WHEN hits > 0 THEN 'alert' ELSE 'normal' END AS state FROM t""")
def sc27(spark, d):
    e = A.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 100).alias("hits"))
    status = A._item(["completed", "insufficient_sequence", "failed", "unavailable", "completed"], F.col("user_id") % 5)
    return e.select("user_id", rules.sequence_state(status, F.col("hits")).alias("state"))


@query("sc30_run_conclusion", """
WITH t AS (SELECT o_orderkey, (['completed', 'processing', 'failed', 'cancelled', 'queued'])[o_orderkey % 5 + 1] AS status,
                  CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS n FROM orders)
SELECT o_orderkey, CASE WHEN status <> 'completed' THEN status WHEN n > 0 THEN 'suspicious' ELSE 'normal' END AS kind,
       CASE status WHEN 'completed' THEN CASE WHEN n > 0 THEN '发现可疑 C2 行为' ELSE '未发现可疑 C2 行为' END
            WHEN 'processing' THEN '分析中' WHEN 'failed' THEN '分析失败' WHEN 'cancelled' THEN '已取消' ELSE '未完成' END AS label
FROM t""")
def sc30(spark, d):
    o = A.table(spark, d, "orders")
    status = A._item(["completed", "processing", "failed", "cancelled", "queued"], F.col("o_orderkey") % 5)
    threats = F.when(F.col("o_orderstatus") == "F", 2).otherwise(F.lit(0))
    return o.select("o_orderkey", rules.run_conclusion(status, threats).alias("x")).select("o_orderkey", "x.*")


SIGNALS = DETECTIONS + """,
signals AS (
SELECT src_ip, dst_ip, dst_port, protocol, beacon_score,
  concat_ws(chr(10), '检测到疑似 C2 通信：', '源 IP: ' || src_ip || ' → 目标 IP: ' || dst_ip || ':' || dst_port,
    CASE WHEN lc > 0 OR bs > 0 OR ds > 0 THEN '威胁评分: ' || array_to_string(list_filter([
      CASE WHEN bs > 0 THEN 'Beacon 评分 ' || round_even(bs, 0)::BIGINT || '/100' END,
      CASE WHEN lc > 0 THEN '长连接时长 ' || round_even(lc, 0)::BIGINT || '秒' END,
      CASE WHEN ds > 0 THEN 'DNS 子域名数 ' || round_even(ds, 0)::BIGINT END], lambda x: x IS NOT NULL), ', ') END,
    CASE WHEN lc > 0 OR bs > 0 OR ds > 0 THEN '威胁级别: ' || upper(threat_category) END) AS text
FROM (SELECT *, beacon_score AS bs, long_conn_value AS lc, c2_over_dns_value AS ds FROM merged))"""


@query("sc13_signal_text", f"WITH {SIGNALS} SELECT src_ip, dst_ip, dst_port, protocol, text FROM signals")
def sc13(spark, d):
    m = _merged(spark, d)
    return m.select(*ALERT_KEYS, texts.signal_text(m).alias("text"))


@query("sc13_several_signals", f"""WITH {SIGNALS},
top AS (SELECT *, row_number() OVER (ORDER BY beacon_score DESC, src_ip, dst_ip, dst_port) AS i FROM signals)
SELECT '共检测到 ' || (SELECT count(*) FROM signals) || ' 个疑似威胁，以下为 Top ' || count(*) || ':' || chr(10) || chr(10) ||
       string_agg('--- 威胁 ' || i || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY i) AS text FROM top WHERE i <= 5""")
def sc13_several(spark, d):
    return texts.several_signals_text(_merged(spark, d))
