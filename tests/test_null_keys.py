"""Rows with a null in a key stay: a null is a group of its own."""

from pyspark.sql import functions as F

from pulseloom.operators import connections, highrisk, logs, scoring, sequences
from pulseloom.schemas import GROUP_KEYS, PACKETS


def packets(spark):
    rows = [(None if i % 2 else "a", i, float(i), "10.0.0.1", 5, "10.0.0.2", 80, 0x10, 0, 10) for i in range(30)]
    return spark.createDataFrame(rows, PACKETS)


def test_packets_of_a_null_capture(spark):
    assert connections.orient(packets(spark)).count() == 30
    found = {r.source_file: r.orig_packets for r in connections.connections_from_packets(packets(spark)).collect()}
    assert found == {"a": 15, None: 15}


def feature_rows(spark):
    rows = [(None if k else "f", "s", "d", 443, "tcp", float(i), i * 1.0) for k in range(2) for i in range(20)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'dst_port' else 'string'}" for c in GROUP_KEYS) + ", start_time double, duration double")


def test_windows_of_a_null_group(spark):
    rows = feature_rows(spark).withColumns({"flow_gap": F.lit(1.0), "gap_rolling_cv": F.lit(0.0)})
    windows = sequences.sequence_windows(rows, ["duration"])
    assert windows.count() == 22
    assert sequences.sample_windows(windows, rows, cap=5).groupBy("source_file").count().collect()[0]["count"] == 5
    weights = sequences.window_row_weights(rows, ["duration"])
    assert weights.count() == 40 and weights.agg(F.sum("weight")).first()[0] == 220


def test_scores_of_a_null_capture(spark):
    df = spark.createDataFrame([(None, 1, "0.9"), ("a", 2, "0.4")], "source_file string, row_no int, beacon_score string")
    assert {(r.source_file, r.beacon_value) for r in highrisk.scored_rows(df).collect()} == {(None, 90.0), ("a", 40.0)}


def test_status_of_a_null_capture(spark):
    rows = feature_rows(spark).withColumns({"flow_gap": F.lit(1.0), "gap_rolling_cv": F.lit(0.0), "probability": F.lit(0.5)})
    windows = sequences.sequence_windows(rows, ["duration"], extra={"probability": scoring.regularity})
    best = scoring.best_windows(windows)
    status = scoring.run_status(rows, best, best.where("probability > 0.4"))
    assert {(r.source_file, r.status, r.total_flagged) for r in status.collect()} == {("f", "completed", 1), (None, "completed", 1)}


def test_facts_of_a_null_capture(spark):
    http = spark.createDataFrame([(None, 1, "10.0.0.1", "8.8.8.8", "80", "h")], "source_file string, row_no int, orig_h string, resp_h string, resp_p string, host string")
    ssl = spark.createDataFrame(
        [(None, 1, "10.0.0.1", "8.8.4.4", "443", "n", "v3"), ("a", 2, "10.0.0.1", "8.8.4.4", "443", "m", "v3")],
        "source_file string, row_no int, orig_h string, resp_h string, resp_p string, server_name string, version string")
    facts = {r.source_file: (r.http_requests, r.tls_sessions, r.tls_sni) for r in logs.http_tls_facts(http, ssl).collect()}
    assert facts == {None: (1, 1, "n"), "a": (0, 1, "m")}
