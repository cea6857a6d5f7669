"""Hourly aggregates, their scores, samples and retrieval texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.functions import texts
from pulseloom.operators import evaluation, hourly
from pulseloom.sources import lines

ROWS = """
e0 AS (
  SELECT event_id AS n, user_id AS u, event_type, value, epoch_us(ts) // 100 / 1e6 AS ts,
         json_extract(props, '$.k')::BIGINT AS k FROM events),
hr AS (
  SELECT n AS row_no, 'f' || (n % 3) AS source_file, ts, CASE WHEN n % 9 = 0 THEN 0 ELSE value END AS duration,
         'h' || (u % 10) AS src_ip, event_type AS dst_ip, (['443', '8443', '22', '', '53'])[u % 10 % 5 + 1] AS dst_port,
         CASE WHEN u % 10 = 7 THEN 'icmp' WHEN u % 10 = 3 THEN 'udp' ELSE 'tcp' END AS protocol,
         CASE WHEN u % 10 = 6 THEN 'dns' ELSE '' END AS service, (floor(ts / 3600) * 3600)::BIGINT AS window_start,
         CASE WHEN n % 4 = 0 OR (k = 0 AND n % 1500 = 0) THEN k + 60 ELSE k + n % 1500 END AS octets,
         n % 5 AS orig_pkts, 2 AS resp_pkts, (['SF', 'S0', '', 'REJ'])[k % 4 + 1] AS conn_state,
         (['ShAD', 'Dd', ''])[k % 3 + 1] AS history,
         (['none', 'none', 'Discovery', 'Command and Control'])[(k + u) % 4 + 1] AS label
  FROM e0)"""
_KEY = "src_ip, dst_ip, dst_port, protocol, service, window_start"


def _mode(column: str) -> str:
    return f"""(SELECT {_KEY}, v AS {column} FROM (
      SELECT {_KEY}, {column} AS v, count(*) AS c, min(row_no) AS f FROM hr WHERE {column} <> '' GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY c DESC, f) = 1)"""


AGG = ROWS + f""",
ag0 AS (
  SELECT {_KEY}, count(*) AS connection_count, sum(duration) AS total_duration, sum(octets)::BIGINT AS total_bytes,
         sum(orig_pkts)::BIGINT AS orig_pkts, sum(resp_pkts)::BIGINT AS resp_pkts, max(ts) - min(ts) AS active_window,
         string_agg(DISTINCT source_file, ';' ORDER BY source_file) AS source_files
  FROM hr GROUP BY ALL),
ag AS (
  SELECT ag0.* REPLACE (CASE WHEN dst_port = '' THEN 'unknown' ELSE dst_port END AS dst_port),
         CASE WHEN connection_count > 1 THEN active_window / (connection_count - 1) ELSE 0 END AS avg_interval,
         coalesce(conn_state, '') AS conn_state, coalesce(history, '') AS history, label
  FROM ag0 LEFT JOIN {_mode('conn_state')} USING ({_KEY}) LEFT JOIN {_mode('history')} USING ({_KEY})
       LEFT JOIN {_mode('label')} USING ({_KEY})),
sc0 AS (
  SELECT *, CASE WHEN service = 'dns' OR dst_port = '53' THEN 'excluded_dns_without_query_evidence'
                 WHEN protocol = 'icmp' THEN 'excluded_icmp_without_payload_evidence' END AS excluded,
         list_filter([
           CASE WHEN connection_count >= 1000 THEN {{'p': 30, 'r': 'very_high_repeat_count'}}
                WHEN connection_count >= 100 THEN {{'p': 24, 'r': 'high_repeat_count'}}
                WHEN connection_count >= 20 THEN {{'p': 16, 'r': 'moderate_repeat_count'}}
                WHEN connection_count >= 5 THEN {{'p': 8, 'r': 'repeated_connection'}} END,
           CASE WHEN active_window >= 1800 THEN {{'p': 10, 'r': 'sustained_activity_within_window'}} END,
           CASE WHEN avg_interval BETWEEN 5 AND 900 AND connection_count >= 10 THEN {{'p': 18, 'r': 'periodic_interval'}} END,
           CASE WHEN protocol = 'tcp' AND dst_port IN ('80', '443', '8080', '8443') THEN {{'p': 10, 'r': 'web_c2_capable_channel'}}
                WHEN protocol = 'tcp' AND dst_port NOT IN ('', 'unknown') THEN {{'p': 4, 'r': 'non_web_tcp_channel=' || dst_port}} END,
           CASE WHEN connection_count >= 20 AND total_bytes / connection_count <= 800
                THEN {{'p': 8, 'r': 'low_byte_repeated_traffic'}} END], lambda x: x IS NOT NULL) AS terms
  FROM ag),
sc AS (
  SELECT *, CASE WHEN excluded IS NOT NULL THEN 0 ELSE least(coalesce(list_sum(list_transform(terms, lambda x: x.p)), 0), 100)
            END::DOUBLE AS c2_score,
         CASE WHEN excluded IS NOT NULL THEN excluded ELSE array_to_string(list_transform(terms, lambda x: x.r), ';') END
            AS c2_reasons
  FROM sc0),
ft0 AS (
  SELECT *, CASE WHEN connection_count >= 1000 THEN 95.0 WHEN connection_count >= 100 THEN 85 WHEN connection_count >= 20 THEN 70
            WHEN connection_count >= 5 THEN 55 ELSE 0 END::DOUBLE AS base_score,
         CASE WHEN (service = 'dns' OR dst_port = '53') AND c2_score >= 50 THEN connection_count::DOUBLE ELSE 0.0::DOUBLE END AS c2_over_dns_value,
         greatest(total_duration, CASE WHEN connection_count >= 5 THEN active_window ELSE 0 END) AS long_conn_value
  FROM sc),
ft1 AS (
  SELECT *, CASE WHEN avg_interval BETWEEN 1 AND 3600 AND connection_count >= 10 THEN least(base_score + 10, 100) ELSE base_score END
            AS beacon_score FROM ft0),
ft AS (
  SELECT *, CASE WHEN beacon_score >= 90 OR c2_over_dns_value >= 800 OR long_conn_value >= 28800 THEN 'high'
                 WHEN beacon_score >= 70 OR c2_over_dns_value >= 500 THEN 'medium' ELSE 'low' END AS threat_category
  FROM ft1),
sm AS (
  SELECT *, sha256(concat_ws('|', '20260811', src_ip, dst_ip, dst_port, protocol, service, window_start)) AS sample_key
  FROM ft),
smp AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_key) AS sample_rank FROM sm
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY sample_key) <= 25)"""
KEYS = hourly.KEYS


def _clean(spark, d):
    return hourly.clean_rows(A.hourly_rows_from_events(spark, d))


def _features(spark, d):
    return hourly.with_beacon_features(hourly.with_c2_score(hourly.hourly_aggregates(_clean(spark, d))))


@query("agg6_hourly_aggregate", f"""WITH {AGG}
SELECT {_KEY}, connection_count, round(total_duration, 4) AS total_duration, total_bytes, orig_pkts, resp_pkts,
       round(active_window, 4) AS active_window, round(avg_interval, 5) AS avg_interval, source_files FROM ag""")
def agg6(spark, d):
    a = rounded(rounded(hourly.hourly_aggregates(_clean(spark, d)), 4, "total_duration", "active_window"), 5, "avg_interval")
    return a.select(*KEYS, "connection_count", "total_duration", "total_bytes", "orig_pkts", "resp_pkts",
                    "active_window", "avg_interval", F.array_join("source_files", ";").alias("source_files"))


@query("agg7_dominant_values", f"WITH {AGG} SELECT {_KEY}, conn_state, history, label FROM ag")
def agg7(spark, d):
    return hourly.hourly_aggregates(_clean(spark, d)).select(*KEYS, "conn_state", "history", "label")


@query("agg19_rows_by_label", f"WITH {ROWS} SELECT label, count(*) AS rows FROM hr GROUP BY ALL")
def agg19(spark, d):
    return hourly.rows_by(_clean(spark, d), "label")


@query("agg19_rows_by_file", f"WITH {ROWS} SELECT source_file, count(*) AS rows FROM hr GROUP BY ALL")
def agg19_file(spark, d):
    return hourly.rows_by(_clean(spark, d), "source_file")


@query("sc10_c2_likelihood", f"WITH {AGG} SELECT {_KEY}, c2_score, c2_reasons FROM sc")
def sc10(spark, d):
    s = hourly.with_c2_score(hourly.hourly_aggregates(_clean(spark, d)))
    return s.select(*KEYS, "c2_score", F.array_join("c2_reasons", ";").alias("c2_reasons"))


@query("sc11_beacon_features", f"""WITH {AGG}
SELECT {_KEY}, beacon_score, c2_over_dns_value, round(long_conn_value, 4) AS long_conn_value, threat_category FROM ft""")
def sc11(spark, d):
    return rounded(_features(spark, d), 4, "long_conn_value").select(
        *KEYS, "beacon_score", "c2_over_dns_value", "long_conn_value", "threat_category")


@query("sc12_retrieval_query", f"""WITH {AGG}
SELECT {_KEY}, '使用以下特征的 APT 组织: ' || concat_ws(', ',
  CASE WHEN beacon_score >= 70 THEN 'statistically detected periodic command and control beacon' END,
  CASE WHEN c2_score >= 50 THEN 'suspected command and control communication' END,
  CASE WHEN (service = 'dns' OR dst_port = '53') AND c2_over_dns_value >= 500 THEN 'DNS based command and control, dynamic DNS resolution or DNS calculation' END,
  upper(protocol) || ' protocol traffic',
  CASE WHEN connection_count >= 20 THEN 'repeated low volume network connections' END,
  CASE WHEN avg_interval BETWEEN 1 AND 3600 AND connection_count >= 10 THEN 'periodic beacon interval' END,
  CASE WHEN total_bytes > 0 AND total_bytes / connection_count <= 800 THEN 'small payload heartbeat traffic' END,
  CASE WHEN conn_state IN ('S0', 'REJ', 'RSTO', 'RSTR') THEN 'connection state ' || conn_state END,
  CASE WHEN beacon_score >= 70 THEN '周期性 Beacon 通信' END,
  CASE WHEN c2_over_dns_value >= 800 THEN 'DNS 隧道或 DGA 域名' END,
  CASE WHEN long_conn_value >= 28800 THEN '持久化长连接' END,
  CASE WHEN dst_port NOT IN ('', '80', '443', '53') THEN '非标准端口 ' || dst_port END,
  CASE WHEN dst_port = '80' THEN 'HTTP web protocols for command and control'
       WHEN dst_port = '443' THEN 'HTTPS encrypted web protocols for command and control' END) AS query
FROM ft""")
def sc12(spark, d):
    f = _features(spark, d)
    return f.select(*KEYS, texts.query_text(f).alias("query"))


@query("flt4_c2_gate", f"WITH {AGG} SELECT {_KEY}, c2_score FROM sc WHERE c2_score >= 40")
def flt4(spark, d):
    return hourly.c2_gate(hourly.with_c2_score(hourly.hourly_aggregates(_clean(spark, d)))).select(*KEYS, "c2_score")


@query("flt5_labelled_only", f"WITH {AGG} SELECT {_KEY}, label FROM ag WHERE lower(label) <> 'none'")
def flt5(spark, d):
    return hourly.labelled_only(hourly.hourly_aggregates(_clean(spark, d))).select(*KEYS, "label")


@query("win10_stratified_sample", f"WITH {AGG} SELECT label, sample_rank, sample_key, {_KEY} FROM smp")
def win10(spark, d):
    s = hourly.stratified_sample(hourly.hourly_aggregates(_clean(spark, d)))
    return s.select("label", "sample_rank", "sample_key", *KEYS)


@query("top6_sample_order", f"""WITH {AGG}
SELECT label, connection_count, {_KEY} FROM smp ORDER BY lower(label) = 'none', connection_count DESC, label, sample_key LIMIT 40""")
def top6(spark, d):
    s = hourly.stratified_sample(hourly.hourly_aggregates(_clean(spark, d)))
    return hourly.sample_order(s, 40).select("label", "connection_count", *KEYS)


@query("flt7_stride_sampling", """
SELECT source_file, row_no, event_id FROM (
  SELECT 'f' || (user_id % 4) AS source_file, event_id,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS row_no FROM events)
WHERE row_no % 3 = 0""")
def flt7(spark, d):
    e = A.table(spark, d, "events").select(
        F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string")).alias("source_file"), "event_id",
        F.struct(F.floor(F.col("event_id") / 1000).cast("long").alias("block"), F.col("event_id").alias("line")).alias("at"))
    return lines.stride_sample(e, ["source_file"], 3).select("source_file", "row_no", "event_id")


@query("ev6_sample_summary", f"""WITH {AGG}
SELECT label, count(*) AS sampled_count, count(*) FILTER (c2_score >= 40) AS c2_candidate_count,
       count(*) FILTER (c2_score < 40) AS c2_filtered_count, round(avg(c2_score), 6) AS mean_sample_c2_score
FROM smp GROUP BY label""")
def ev6_samples(spark, d):
    s = hourly.stratified_sample(hourly.with_c2_score(hourly.hourly_aggregates(_clean(spark, d))))
    return rounded(evaluation.sample_summary(s, 40.0), 6, "mean_sample_c2_score")
