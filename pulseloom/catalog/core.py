"""Packets, connections, gaps, sequences, scores and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.functions import rules
from pulseloom.operators import connections, evaluation, gaps, ranks, scoring, sequences, training
from pulseloom.plans import beacons
from pulseloom.plans.hotgroups import spread
from pulseloom.session import materialise
from pulseloom.sources.tables import with_aliases
from pulseloom.schemas import FEATURES, GROUP_KEYS

IAT_FEATURES = [f for f in FEATURES if f.startswith("packet_iat_")]

TIE = ["event_id"]
DAY = 86400.0

CONN = """
conn AS (
  SELECT 'events' AS source_file, epoch_us(ts) / 1e6 AS start_time, 'u' || user_id AS src_ip, event_type AS dst_ip,
         443 AS dst_port, 'tcp' AS ip_protocol, value AS duration, json_extract(props, '$.k')::BIGINT AS orig_bytes,
         event_id, user_id
  FROM events)"""
GAP = CONN + """,
gap AS (
  SELECT *, greatest(0.0::DOUBLE, coalesce(start_time - lag(start_time) OVER w, 0.0::DOUBLE)) AS flow_gap
  FROM conn WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, event_id))"""
ROLL = GAP + """,
roll0 AS (
  SELECT *, ln(1 + flow_gap) AS log_flow_gap, avg(flow_gap) OVER r AS gap_rolling_mean,
         stddev_pop(flow_gap) OVER r AS gap_rolling_std, quantile_cont(flow_gap, 0.5) OVER r AS gap_rolling_median,
         quantile_cont(flow_gap, 0.75) OVER r - quantile_cont(flow_gap, 0.25) OVER r AS gap_rolling_iqr
  FROM gap
  WINDOW r AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
roll AS (
  SELECT *, CASE WHEN gap_rolling_mean > 1e-9 THEN gap_rolling_std / gap_rolling_mean ELSE 0 END AS gap_rolling_cv
  FROM roll0)"""
WINDOWS = ROLL + """,
win0 AS (
  SELECT *, row_number() OVER g - 10 AS window_index, first_value(start_time) OVER f AS window_start_time,
         start_time AS window_end_time, first_value(flow_gap) OVER f AS first_flow_gap,
         first_value(gap_rolling_cv) OVER f AS first_gap_cv,
         1.0::DOUBLE / (1.0::DOUBLE + avg(gap_rolling_cv::FLOAT::DOUBLE) OVER f) AS probability,
         sum(flow_gap::FLOAT::DOUBLE + gap_rolling_cv::FLOAT::DOUBLE + duration::FLOAT::DOUBLE) OVER f AS content
  FROM roll
  WINDOW g AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, event_id),
         f AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
win AS (SELECT * FROM win0 WHERE window_index >= 0)"""
BEST = WINDOWS + """,
best AS (
  SELECT source_file, src_ip, dst_ip, dst_port, ip_protocol, probability, window_index, first_flow_gap, first_gap_cv,
         window_start_time,
         count(*) OVER (PARTITION BY src_ip, dst_ip) AS window_count
  FROM win
  QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY probability DESC, window_index) = 1)"""
ALERTS = BEST + """,
alerts AS (
  SELECT source_file, src_ip AS src, dst_ip AS dst, dst_port::VARCHAR AS port, ip_protocol AS proto,
         round(probability * 100, 1) AS confidence,
         CASE WHEN probability >= 0.9 THEN 'Critical' WHEN probability >= 0.75 THEN 'High'
              WHEN probability >= 0.6 THEN 'Medium' ELSE 'Low' END AS risk,
         10 AS event_count, round(first_flow_gap, 3) AS flow_gap, round(first_gap_cv, 3) AS gap_cv
  FROM best WHERE probability >= 0.5)"""
PACKETS = f"""
pk AS (
  SELECT event_id AS pkt_no, epoch_us(ts) / 1e6 AS ts, user_id, event_id % 2 = 0 AS fwd, event_type = 'signup' AS syn,
         event_type = 'error' AS ends, json_extract(props, '$.k')::BIGINT % 4 AS seq,
         json_extract(props, '$.k')::BIGINT + 40 AS length
  FROM events),
orient0 AS (
  SELECT *, first_value(fwd) OVER p AS first_fwd,
         coalesce(bool_or(syn AND fwd) OVER b, false) AS syn_fwd, coalesce(bool_or(syn AND NOT fwd) OVER b, false) AS syn_rev
  FROM pk WINDOW p AS (PARTITION BY user_id ORDER BY pkt_no),
                 b AS (PARTITION BY user_id ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
orient AS (
  SELECT *, CASE WHEN syn OR fwd = first_fwd OR (CASE WHEN fwd THEN syn_fwd ELSE syn_rev END) THEN fwd ELSE NOT fwd END
            AS key_forward
  FROM orient0),
idle AS (
  SELECT *, lag(ts) OVER k IS NULL AS first_row, coalesce(ts - lag(ts) OVER k > {DAY}, false) AS idle
  FROM orient WINDOW k AS (PARTITION BY user_id, key_forward ORDER BY pkt_no)),
runs AS (
  SELECT *, sum(idle::INT) OVER k AS n_idle, coalesce(sum(ends::INT) OVER b, 0) AS n_end FROM idle
  WINDOW k AS (PARTITION BY user_id, key_forward ORDER BY pkt_no),
         b AS (PARTITION BY user_id, key_forward ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prev AS (
  SELECT *, last_value(CASE WHEN syn THEN {{'i': n_idle, 'e': n_end, 's': seq}} END IGNORE NULLS) OVER b AS q FROM runs
  WINDOW b AS (PARTITION BY user_id, key_forward ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
split AS (
  SELECT *, max(CASE WHEN first_row OR idle OR (syn AND (q IS NULL OR n_idle > q.i OR n_end > q.e OR seq <> q.s))
                     THEN pkt_no END) OVER k AS conn_start,
         coalesce(bool_or(syn) OVER k, false) AS sure
  FROM prev WINDOW k AS (PARTITION BY user_id, key_forward ORDER BY pkt_no))"""
CONN_ROWS = PACKETS + """,
pgap AS (
  SELECT *, ts - lag(ts) OVER c AS pgap, row_number() OVER c - 1 AS nth FROM split
  WINDOW c AS (PARTITION BY user_id, key_forward, conn_start ORDER BY ts, pkt_no)),
crow AS (
  SELECT user_id, key_forward, conn_start, min(ts) AS start_time, max(ts) - min(ts) AS duration,
         count(*) FILTER (fwd = key_forward) AS orig_packets, count(*) FILTER (fwd <> key_forward) AS resp_packets,
         coalesce(sum(length) FILTER (fwd = key_forward), 0)::BIGINT AS orig_bytes,
         coalesce(sum(length) FILTER (fwd <> key_forward), 0)::BIGINT AS resp_bytes,
         coalesce(min(pgap), 0) AS g_min, coalesce(max(pgap), 0) AS g_max, coalesce(avg(pgap), 0) AS g_mean,
         coalesce(stddev_pop(pgap), 0) AS g_std, coalesce(max(pgap) FILTER (nth = 1), 0) AS g0,
         coalesce(max(pgap) FILTER (nth = 2), 0) AS g1, coalesce(max(pgap) FILTER (nth = 3), 0) AS g2,
         coalesce(max(pgap) FILTER (nth = 4), 0) AS g3, coalesce(max(pgap) FILTER (nth = 5), 0) AS g4,
         max(CASE WHEN pkt_no = conn_start AND sure THEN 1.0::DOUBLE ELSE 0 END) AS direction_confidence
  FROM pgap GROUP BY ALL)"""
FLOWS = """
flow AS (
  SELECT 'lineitem' AS source_file, epoch_us(l_shipdate) / 1e6 AS start_time, 's' || l_suppkey AS src_ip,
         l_returnflag AS dst_ip, 443 AS dst_port, 'tcp' AS ip_protocol, l_quantity AS quantity,
         l_extendedprice AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem),
flow_n AS (
  SELECT *, row_number() OVER g - 1 AS idx, count(*) OVER (PARTITION BY src_ip, dst_ip) - 9 AS windows
  FROM flow WINDOW g AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, l_orderkey, l_linenumber, l_partkey, quantity,
                         price)),
flow_w AS (
  SELECT *, idx - 9 AS window_index, first_value(start_time) OVER f AS window_start_time
  FROM flow_n WINDOW f AS (PARTITION BY src_ip, dst_ip ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
kept AS (
  SELECT * FROM flow_w WHERE window_index >= 0 AND (windows <= 200 OR window_index IN (
    SELECT (k * (windows - 1)) // 199 FROM range(200) t(k))))"""
FLOW_TIE = ["l_orderkey", "l_linenumber", "l_partkey", "quantity", "price"]


def conn(spark, d):
    return A.connections_from_events(spark, d)


def gap_rows(spark, d):
    return gaps.with_gap_features(conn(spark, d), TIE)


def windows(spark, d):
    return beacons.scored_windows(conn(spark, d), TIE)


def split_packets(spark, d):
    return connections.split_connections(A.packets_from_events(spark, d), idle_seconds=DAY)


def flows(spark, d):
    f = A.flows_from_lineitem(spark, d)
    return f.withColumns({"flow_gap": F.lit(0.0), "gap_rolling_cv": F.lit(0.0)})


@query("win1_orientation", f"WITH {PACKETS} SELECT pkt_no, key_forward FROM orient")
def win1(spark, d):
    return connections.orient(A.packets_from_events(spark, d)).select("pkt_no", "key_forward")


@query("win2_connection_split", f"WITH {PACKETS} SELECT pkt_no, key_forward, conn_start FROM split")
def win2(spark, d):
    return split_packets(spark, d).select("pkt_no", "key_forward", "conn_start")


@query("win3_direction_confidence", f"""WITH {CONN_ROWS}
SELECT 'u' || user_id AS user, key_forward, conn_start, direction_confidence FROM crow""")
def win3(spark, d):
    s = split_packets(spark, d)
    user = F.concat(F.lit("u"), F.substring("lo_ip", 8, 20)).alias("user")
    sure = F.when(F.min("key_syn_no") <= F.col("conn_start"), 1.0).otherwise(F.lit(0.0))
    return s.groupBy(user, "key_forward", "conn_start").agg(sure.alias("direction_confidence"))


@query("agg1_connection_rows", f"""WITH {CONN_ROWS}
SELECT CASE WHEN key_forward THEN '10.0.0.' || user_id ELSE '192.0.2.1' END AS src_ip,
       CASE WHEN key_forward THEN '192.0.2.1' ELSE '10.0.0.' || user_id END AS dst_ip,
       conn_start, round(start_time, 6) AS start_time, round(duration, 6) AS duration, orig_packets, resp_packets,
       orig_bytes, resp_bytes, round(orig_packets / (orig_packets + resp_packets), 6) AS packet_ratio,
       round(orig_bytes / (orig_bytes + resp_bytes), 6) AS byte_ratio, direction_confidence
FROM crow""")
def agg1(spark, d):
    rows = connections.connections_from_packets(A.packets_from_events(spark, d), DAY)
    out = rounded(rows, 6, "start_time", "duration", "packet_ratio", "byte_ratio")
    return out.select("src_ip", "dst_ip", "conn_start", "start_time", "duration", "orig_packets", "resp_packets",
                      "orig_bytes", "resp_bytes", "packet_ratio", "byte_ratio", "direction_confidence")


@query("agg2_packet_gaps", f"""WITH {CONN_ROWS}
SELECT user_id, key_forward, conn_start, round(g_min, 4) AS packet_iat_min, round(g_max, 4) AS packet_iat_max,
       round(g_mean, 4) AS packet_iat_mean, round(g_std, 4) AS packet_iat_stddev, round(g0, 4) AS packet_iat_0,
       round(g1, 4) AS packet_iat_1, round(g2, 4) AS packet_iat_2, round(g3, 4) AS packet_iat_3,
       round(g4, 4) AS packet_iat_4
FROM crow""")
def agg2(spark, d):
    rows = connections.connections_from_packets(A.packets_from_events(spark, d), DAY)
    forward = F.col("src_ip") != "192.0.2.1"
    user = F.substring(F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")), 8, 20).cast("long")
    return rounded(rows, 4, *IAT_FEATURES).select(
        user.alias("user_id"), forward.alias("key_forward"), "conn_start", *IAT_FEATURES)


@query("win4_connection_gap", f"WITH {GAP} SELECT event_id, round(flow_gap, 6) AS flow_gap FROM gap")
def win4(spark, d):
    return rounded(gap_rows(spark, d), 6, "flow_gap").select("event_id", "flow_gap")


@query("win5_rolling_gaps", f"""WITH {ROLL}
SELECT event_id, round(gap_rolling_mean, 4) AS gap_rolling_mean, round(gap_rolling_std, 4) AS gap_rolling_std,
       round(gap_rolling_cv, 6) AS gap_rolling_cv, round(gap_rolling_median, 4) AS gap_rolling_median,
       round(gap_rolling_iqr, 4) AS gap_rolling_iqr
FROM roll""")
def win5(spark, d):
    out = rounded(gap_rows(spark, d), 4, "gap_rolling_mean", "gap_rolling_std", "gap_rolling_median", "gap_rolling_iqr")
    return rounded(out, 6, "gap_rolling_cv").select(
        "event_id", "gap_rolling_mean", "gap_rolling_std", "gap_rolling_cv", "gap_rolling_median", "gap_rolling_iqr")


@query("sc25_log_and_ratio", f"""WITH {GAP}
SELECT event_id, round(ln(1 + flow_gap), 6) AS log_flow_gap,
       round((event_id % 13 + 1) / (event_id % 13 + 1 + event_id % 17), 6) AS packet_ratio,
       round(CASE WHEN orig_bytes + event_id % 3000 > 0 THEN orig_bytes / (orig_bytes + event_id % 3000) ELSE 0 END, 6)
         AS byte_ratio
FROM gap""")
def sc25(spark, d):
    f = gaps.with_gap_features(A.feature_rows_from_events(spark, d), TIE)
    return rounded(f, 6, "log_flow_gap", "packet_ratio", "byte_ratio").select(
        "event_id", "log_flow_gap", "packet_ratio", "byte_ratio")


@query("top1_feature_order", f"""WITH {CONN_ROWS}
SELECT CASE WHEN key_forward THEN '10.0.0.' || user_id ELSE '192.0.2.1' END AS src_ip, conn_start,
       round(start_time, 6) AS start_time
FROM crow ORDER BY 1, 3""")
def top1(spark, d):
    rows = connections.feature_order(connections.connections_from_packets(A.packets_from_events(spark, d), DAY))
    return rounded(rows, 6, "start_time").select("src_ip", "conn_start", "start_time")


@query("win6_sequence_windows", f"""WITH {WINDOWS}
SELECT src_ip, dst_ip, window_index, round(window_start_time, 6) AS window_start_time,
       round(window_end_time, 6) AS window_end_time, round(first_flow_gap, 4) AS first_flow_gap,
       round(first_gap_cv, 6) AS first_gap_cv, round(content, 2) AS content, 30 AS n_values
FROM win""")
def win6(spark, d):
    s = spread(conn(spark, d), GROUP_KEYS, "start_time", tie=TIE, rows_back=beacons.HISTORY)
    w = sequences.windows_on(gaps.gap_features_on(s, TIE), TIE, features=["flow_gap", "gap_rolling_cv", "duration"])
    total = F.aggregate(F.col("steps").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    w = w.withColumns({"content": F.round(total, 2), "n_values": F.size("steps")})
    w = rounded(w, 6, "window_start_time", "window_end_time")
    return rounded(rounded(w, 4, "first_flow_gap"), 6, "first_gap_cv").select(
        "src_ip", "dst_ip", "window_index", "window_start_time", "window_end_time", "first_flow_gap", "first_gap_cv",
        "content", "n_values")


@query("win6_unmixed_windows", f"""WITH {FLOWS},
lab AS (
  SELECT *, min(CASE WHEN start_time < 883612800 THEN 0 ELSE 1 END) OVER f AS lo,
         max(CASE WHEN start_time < 883612800 THEN 0 ELSE 1 END) OVER f AS hi
  FROM flow_w WINDOW f AS (PARTITION BY src_ip, dst_ip ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT src_ip, dst_ip, window_index, lo AS label FROM lab WHERE window_index >= 0 AND lo = hi""")
def win6_unmixed(spark, d):
    f = flows(spark, d).withColumn("label", F.when(F.col("start_time") < 883612800, 0).otherwise(F.lit(1)))
    return sequences.sequence_windows(f, FLOW_TIE, label="label").select("src_ip", "dst_ip", "window_index", "label")


@query("win8_even_sampling", f"""WITH {FLOWS}
SELECT src_ip, dst_ip, window_index, window_start_time FROM kept""")
def win8(spark, d):
    f = flows(spark, d)
    kept = sequences.sample_windows(sequences.sequence_windows(f, FLOW_TIE), f)
    return kept.select("src_ip", "dst_ip", "window_index", "window_start_time")


@query("agg12_sequence_coverage", f"""WITH {CONN}, sizes AS (SELECT source_file, count(*) AS n FROM conn GROUP BY source_file, src_ip, dst_ip)
SELECT source_file, sum(n)::BIGINT AS connection_rows, count(*) AS connection_groups,
       count(*) FILTER (n >= 10) AS groups_with_sequence
FROM sizes GROUP BY source_file""")
def agg12(spark, d):
    return sequences.sequence_coverage(conn(spark, d))


@query("agg13_window_statistics", f"""WITH {FLOWS},
lab AS (
  SELECT *, min(CASE WHEN start_time < 883612800 THEN 0 ELSE 1 END) OVER f
            <> max(CASE WHEN start_time < 883612800 THEN 0 ELSE 1 END) OVER f AS mixed
  FROM flow_w WINDOW f AS (PARTITION BY src_ip, dst_ip ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
sizes AS (SELECT src_ip, dst_ip, count(*) AS n FROM flow GROUP BY ALL)
SELECT (SELECT count(*) FROM sizes) AS groups, (SELECT count(*) FILTER (n < 10) FROM sizes) AS short_groups,
       (SELECT coalesce(sum(greatest(n - 209, 0)), 0)::BIGINT FROM sizes) AS capped_windows,
       (SELECT count(*) FROM lab WHERE mixed AND window_index >= 0 AND (windows <= 200 OR window_index IN (
          SELECT (k * (windows - 1)) // 199 FROM range(200) t(k)))) AS mixed_label_windows""")
def agg13(spark, d):
    f = flows(spark, d).withColumn("label", F.when(F.col("start_time") < 883612800, 0).otherwise(F.lit(1)))
    return sequences.window_statistics(f, FLOW_TIE, "label")


@query("agg14_short_groups", f"""WITH {CONN}, sizes AS (SELECT count(*) AS n FROM conn GROUP BY src_ip, dst_ip)
SELECT max(n) AS max_group_connections, 10 AS minimum_sequence_length,
       CASE WHEN max(n) < 10 THEN 'insufficient_sequence' ELSE 'ready' END AS status FROM sizes""")
def agg14(spark, d):
    return sequences.short_group_report(conn(spark, d))


@query("prj5_median_imputation", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS duration,
                  CASE WHEN event_id % 7 <> 3 THEN json_extract(props, '$.k')::DOUBLE END AS orig_bytes FROM events)
SELECT event_id, coalesce(duration, (SELECT median(duration) FROM t)) AS duration,
       coalesce(orig_bytes, (SELECT median(orig_bytes) FROM t)) AS orig_bytes, 0.0::DOUBLE AS resp_bytes
FROM t""")
def prj5(spark, d):
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    rows = e.select(
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("value").cast("string")).otherwise(F.lit("n/a")).alias("duration"),
        F.when(F.col("event_id") % 7 != 3, k).otherwise(F.lit("")).alias("orig_bytes"),
        F.lit("-").alias("resp_bytes"))
    return training.impute_medians(rows, ["duration", "orig_bytes", "resp_bytes"])


@query("prj6_feature_vector", """
SELECT event_id, array_to_string([coalesce(value::FLOAT, 0), 0::FLOAT,
       coalesce(json_extract(props, '$.k')::FLOAT, 0)]::DOUBLE[]::DECIMAL(18, 4)[], ';') AS vector
FROM events""")
def prj6(spark, d):
    e = A.table(spark, d, "events").select(
        "event_id", F.col("value").alias("a"), F.lit("-").alias("b"), F.get_json_object("props", "$.k").alias("c"))
    v = sequences.feature_vector(e, ["a", "b", "c"])
    text = F.array_join(F.transform(v, lambda x: x.cast("double").cast("decimal(18,4)").cast("string")), ";")
    return e.select("event_id", text.alias("vector"))


@query("prj7_window_scaler", f"""WITH {FLOWS},
cover AS (
  SELECT r.quantity::FLOAT::DOUBLE AS quantity, r.price::FLOAT::DOUBLE AS price
  FROM kept k JOIN flow_n r ON r.src_ip = k.src_ip AND r.dst_ip = k.dst_ip
       AND r.idx BETWEEN k.window_index AND k.window_index + 9)
SELECT round(avg(quantity), 5) AS mean_quantity, round(avg(price), 3) AS mean_price, 0.0::DOUBLE AS mean_flow_gap,
       round(stddev_pop(quantity), 5) AS std_quantity, round(stddev_pop(price), 3) AS std_price,
       1.0::DOUBLE AS std_flow_gap
FROM cover""")
def prj7(spark, d):
    weights = sequences.window_row_weights(flows(spark, d), FLOW_TIE)
    fitted = sequences.fit_scaler(weights, ["quantity", "price", "flow_gap"])
    return rounded(rounded(fitted, 5, "mean_quantity", "std_quantity"), 3, "mean_price", "std_price")


# every feature by a weight of its own, as scoring.weighted_features does; a window's last step weighs most
_WEIGHED = " + ".join(f"{k} * ({c}::FLOAT::DOUBLE / (1 + abs({c}::FLOAT::DOUBLE)))" for k, c in enumerate(FEATURES, 1))
WEIGHTED = ROLL + f""",
full_rows AS (
  SELECT *, event_id % 13 + 1 AS orig_packets, event_id % 17 AS resp_packets, event_id % 3000 AS resp_bytes,
         orig_packets / (orig_packets + resp_packets) AS packet_ratio,
         CASE WHEN orig_bytes + resp_bytes > 0 THEN orig_bytes / (orig_bytes + resp_bytes) ELSE 0 END AS byte_ratio,
         duration / 8 AS packet_iat_min, duration / 2 AS packet_iat_max, duration / 4 AS packet_iat_mean, duration / 16 AS packet_iat_stddev,
         {", ".join(f"duration / {i + 2} AS packet_iat_{i}" for i in range(5))}, event_id % 2 AS direction_confidence
  FROM roll),
step AS (SELECT *, {_WEIGHED} AS s FROM full_rows),
place AS (
  SELECT *, row_number() OVER w AS i, {" + ".join(f"{10 - k} * lag(s, {k}) OVER w" if k else "10 * s" for k in range(10))} AS total
  FROM step WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY start_time, event_id))"""


@query("ud1_scored_windows", f"""WITH {WEIGHTED}
SELECT src_ip, dst_ip, i - 10 AS window_index, round(total / {55 * sum(range(1, len(FEATURES) + 1))}, 5) AS probability
FROM place WHERE i >= 10""")
def ud1(spark, d):
    have = A.feature_rows_from_events(spark, d)
    scored = beacons.modelled_windows(have, TIE, scoring.weighted_features, features=FEATURES)
    return rounded(scored, 5, "probability").select("src_ip", "dst_ip", "window_index", "probability")


@query("agg3_best_window", f"""WITH {BEST}
SELECT src_ip, dst_ip, round(probability, 6) AS probability, window_index, window_count FROM best""")
def agg3(spark, d):
    best = scoring.best_windows(windows(spark, d))
    return rounded(best, 6, "probability").select("src_ip", "dst_ip", "probability", "window_index", "window_count")


@query("agg4_group_scores", f"""WITH {WINDOWS}
SELECT src_ip, dst_ip, max(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS label,
       round(max(probability), 6) AS probability FROM win GROUP BY ALL""")
def agg4(spark, d):
    user = F.substring("src_ip", 2, 20).cast("long")
    w = windows(spark, d).withColumn("label", F.when(user % 3 == 0, 1).otherwise(F.lit(0)))
    return rounded(evaluation.group_scores(w, ["src_ip", "dst_ip"]), 6, "probability")


@query("flt3_alert_threshold", f"WITH {ALERTS} SELECT src, dst, port, proto, event_count FROM alerts")
def flt3(spark, d):
    best = scoring.best_windows(windows(spark, d))
    return scoring.alerts(best, "0.5").select("src", "dst", "port", "proto", "event_count")


@query("sc7_risk_level", f"WITH {ALERTS} SELECT src, dst, risk FROM alerts")
def sc7(spark, d):
    best = scoring.best_windows(windows(spark, d))
    return best.where(F.col("probability") >= 0.5).select(
        F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"),
        scoring.risk_level(F.col("probability")).alias("risk"))


@query("top3_beacons_by_confidence", f"""WITH {ALERTS}
SELECT source_file, src, dst, port, proto, confidence, risk, event_count, flow_gap, gap_cv
FROM alerts ORDER BY confidence DESC, src, dst""")
def top3(spark, d):
    return beacons.beacon_alerts(conn(spark, d), TIE, 0.5)


@query("sc35_rounded_outputs", f"WITH {ALERTS} SELECT src, dst, confidence, flow_gap, gap_cv FROM alerts")
def sc35(spark, d):
    best = scoring.best_windows(windows(spark, d))
    return scoring.alerts(best, 0.5).select("src", "dst", "confidence", "flow_gap", "gap_cv")


@query("set6_strongest_alert", f"""WITH {ALERTS}
SELECT dst, port, proto, max(confidence) AS confidence FROM alerts GROUP BY ALL""")
def set6(spark, d):
    a = beacons.beacon_alerts(conn(spark, d), TIE, 0.5).withColumn("source_file", F.col("src")).withColumn(
        "src", F.lit("any"))
    return scoring.strongest_alerts(a).select("dst", "port", "proto", "confidence")


@query("d8_run_status", f"""WITH {ALERTS}
SELECT 'events' AS source_file, 'completed' AS status,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM conn GROUP BY src_ip, dst_ip)) AS max_group_connections,
       (SELECT count(*) FROM best) AS total_connections, (SELECT count(*) FROM win) AS total_windows,
       (SELECT count(*) FROM alerts) AS total_flagged""")
def d8(spark, d):
    c = conn(spark, d)
    best = scoring.best_windows(beacons.scored_windows(c, TIE))
    return scoring.run_status(c, best, scoring.alerts(best, 0.5))


@query("agg3_communications", f"""WITH {BEST}
SELECT src_ip, dst_ip, dst_port, window_count, round(probability, 6) AS max_probability, probability >= 0.5 AS flagged FROM best""")
def agg3_communications(spark, d):
    best = scoring.best_windows(windows(spark, d))
    return rounded(scoring.communications(best, 0.5), 6, "max_probability").drop("source_file", "ip_protocol")


@query("set1_union_of_files", f"""WITH {CONN}, {FLOWS.strip()}
SELECT source_file, src_ip, dst_ip, count(*) AS n, round(max(start_time), 6) AS last_start FROM (
  SELECT source_file, src_ip, dst_ip, start_time FROM conn UNION ALL
  SELECT source_file, src_ip, dst_ip, start_time FROM flow) GROUP BY ALL""")
def set1(spark, d):
    columns = ["source_file", "src_ip", "dst_ip", "start_time"]
    both = conn(spark, d).select(*columns).unionByName(A.flows_from_lineitem(spark, d).select(*columns))
    return both.groupBy("source_file", "src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("start_time"), 6).alias("last_start"))


@query("chk2_classes_per_split", """
SELECT (['train', 'val', 'test'])[user_id % 5 % 3 + 1] AS split,
       count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS classes
FROM events GROUP BY ALL""")
def chk2(spark, d):
    return A.labelled_connections(spark, d).groupBy("split").agg(F.countDistinct("label").alias("classes"))


@query("prj1_column_aliases", """
SELECT 'zeek' AS source_file, 'u' || user_id AS src_ip, event_type AS dst_ip, '443' AS dst_port, count(*) AS n
FROM events GROUP BY ALL""")
def prj1(spark, d):
    old = conn(spark, d).select(
        F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.lit("443").alias("port"),
        F.col("ip_protocol").alias("proto"), F.col("start_time").alias("ts"))
    return with_aliases(old).groupBy("source_file", "src_ip", "dst_ip", "dst_port").agg(F.count(F.lit(1)).alias("n"))


@query("ud2_window_classifier", """
WITH g AS (SELECT user_id, event_type, least(count(*) - 9, 200) AS w FROM events GROUP BY ALL HAVING count(*) >= 10),
l AS (SELECT CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label, sum(w)::BIGINT AS windows FROM g GROUP BY ALL)
SELECT label, windows, windows AS probabilities, round((SELECT sum(windows) FROM l) / (SELECT count(*) FROM l), 4) AS class_weight,
       true AS balanced FROM l""")
def ud2(spark, d):
    """Facts that hold for any right fit: all kept windows are scored, classes weigh the same, residuals cancel out."""
    rows = A.feature_rows_from_events(spark, d)
    user = F.substring("src_ip", 2, 20).cast("long")
    rows = rows.withColumn("label", F.when(user % 3 == 0, 1).otherwise(F.lit(0)))
    full = gaps.with_gap_features(rows, TIE)
    scaler = sequences.fit_scaler(sequences.window_row_weights(full, TIE))
    scaled = training.scale_rows(full, scaler)
    w = sequences.sequence_windows(scaled, TIE, features=[f"z_{c}" for c in FEATURES], label="label")
    w = materialise(sequences.sample_windows(w, full))
    scored = training.predict(training.fit_classifier(w, max_iter=60), w)
    weights = evaluation.class_weights(w, "label").select("label", "weight")
    weighed = scored.join(F.broadcast(weights), "label")  # one row per class
    residual = weighed.agg((F.abs(F.sum(F.col("weight") * (F.col("probability") - F.col("label")))) / F.sum("weight") < 0.01).alias("balanced"))
    return weighed.groupBy("label").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(F.col("probability").between(0, 1)).alias("probabilities"),
        F.round(F.sum("weight"), 4).alias("class_weight")).withColumn("balanced", residual.scalar())


@query("prj5_exact_medians", """
SELECT round(median(l_extendedprice), 4) AS price, median(l_quantity) AS quantity, median(l_discount) AS discount
FROM lineitem""")
def medians(spark, d):
    li = A.table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"))
    return rounded(ranks.exact_medians(li, ["price", "quantity", "discount"]), 4, "price")


@query("agg3_lineitem_groups", f"""WITH {FLOWS},
g AS (SELECT *, greatest(0.0::DOUBLE, coalesce(start_time - lag(start_time) OVER (
        PARTITION BY src_ip, dst_ip ORDER BY idx), 0.0::DOUBLE)) AS flow_gap FROM flow_n),
r AS (SELECT *, avg(flow_gap) OVER w AS m, stddev_pop(flow_gap) OVER w AS s FROM g
      WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN m > 1e-9 THEN s / m ELSE 0 END AS cv FROM r),
p AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + avg(cv::FLOAT::DOUBLE) OVER w) AS probability FROM c
      WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT src_ip, dst_ip, round(max(probability), 5) AS probability, count(*) AS window_count
FROM p WHERE idx >= 9 GROUP BY ALL""")
def agg3_lineitem(spark, d):
    best = scoring.best_windows(beacons.scored_windows(A.flows_from_lineitem(spark, d), FLOW_TIE))
    return rounded(best, 5, "probability").select("src_ip", "dst_ip", "probability", "window_count")


@query("sc33_outcome", f"""WITH {ALERTS}
SELECT src_ip, dst_ip, CASE WHEN label AND probability >= 0.5 THEN 'TP' WHEN NOT label AND probability < 0.5 THEN 'TN'
       WHEN NOT label THEN 'FP' ELSE 'FN' END AS outcome
FROM (SELECT *, substr(src_ip, 2)::BIGINT % 3 = 0 AS label FROM best)""")
def sc33(spark, d):
    best = scoring.best_windows(windows(spark, d))
    label = F.substring("src_ip", 2, 20).cast("long") % 3 == 0
    return best.select("src_ip", "dst_ip",
                       rules.confusion_outcome(label, F.col("probability") >= 0.5).alias("outcome"))
