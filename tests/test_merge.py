"""Detector merge, wildcard alignment and evidence lookups."""

from pyspark.sql import functions as F

from pulseloom.operators import merge
from pulseloom.plans import detection

RULE = ("ord long, src_ip string, dst_ip string, dst_port string, protocol string, beacon_score double, "
        "long_conn_value double, c2_over_dns_value double, threat_category string, connection_count long, total_bytes long")
SEQUENCE = "ord long, src string, dst string, port string, proto string, confidence double, risk string"


def rule_rows(spark, *rows):
    data = [(i, s, d, p, proto, float(score), 0.0, 0.0, cat, 1, 10) for i, (s, d, p, proto, score, cat) in enumerate(rows)]
    return merge.rule_alerts(spark.createDataFrame(data, RULE))


def sequence_rows(spark, *rows):
    data = [(i, s, d, p, proto, float(c), r) for i, (s, d, p, proto, c, r) in enumerate(rows)]
    return merge.sequence_alerts(spark.createDataFrame(data, SEQUENCE))


def merged(spark, rule, sequence, evidence=None):
    return merge.threat_order(merge.merge_alerts(rule_rows(spark, *rule), sequence_rows(spark, *sequence), evidence)).collect()


def test_protocols_stay_apart(spark):
    out = merged(spark, [("a", "b", "53", "udp", 80, "medium")], [("a", "b", "53", "tcp", 95, "Critical")])
    assert {r.protocol for r in out} == {"tcp", "udp"} and len(out) == 2


def test_missing_protocol_is_aligned(spark):
    out = merged(spark, [("a", "b", "443", "", 80, "medium")], [("a", "b", "443", "tcp", 95, "Critical")])
    assert len(out) == 1 and out[0].detection_sources == ["RITA", "LSTM"] and out[0].protocol == "tcp"


def test_strong_sequence_promotes(spark):
    out = merged(spark, [("a", "b", "443", "tcp", 10, "low")], [("a", "b", "443", "tcp", 100, "Critical")])
    assert [r.threat_category for r in out] == ["high"]


def test_three_plus_four_rows(spark):
    rule = [("192.168.1.100", "x", "443", "tcp", 85, "medium"), ("192.168.1.101", "x", "80", "tcp", 92, "high"),
            ("192.168.1.102", "x", "22", "tcp", 71, "low")]
    sequence = [("192.168.1.100", "x", "443", "tcp", 95, "Critical"), ("192.168.1.101", "x", "80", "tcp", 88, "High"),
                ("192.168.1.200", "x", "443", "tcp", 89, "High"), ("192.168.1.201", "x", "443", "tcp", 70, "Medium")]
    out = merged(spark, rule, sequence)
    assert [r.src_ip[-4:] for r in out] == [".100", ".101", ".200", ".201", ".102"]
    assert [r.threat_category for r in out] == ["high", "high", "lstm_only", "lstm_only", "low"]
    sizes = [len(r.detection_sources) for r in out]
    assert sizes.count(2) == 2 and [r.lstm_risk for r in out][-1] == "Not Detected"


def test_wildcard_destination_keeps_evidence(spark):
    evidence = spark.createDataFrame([("a", "::", "80", 0.8)], "src string, dst string, port string, timestamp_score double")
    out = merged(spark, [("a", "::", "80", "", 90, "high")], [("a", "10.0.0.2", "80", "tcp", 91, "Critical")], evidence)
    assert len(out) == 1 and out[0].dst_ip == "10.0.0.2" and out[0].rita.timestamp_score == 0.8


def test_two_candidates_leave_the_row(spark):
    out = merged(spark, [("a", "::", "80", "", 90, "high")],
                 [("a", "x", "80", "tcp", 91, "Critical"), ("a", "y", "80", "tcp", 92, "Critical")])
    assert len(out) == 3 and {r.dst_ip for r in out} == {"::", "x", "y"}


def test_blank_candidate_protocol_counts(spark):
    out = merged(spark, [("a", "::", "80", "tcp", 90, "high")],
                 [("a", "x", "80", "", 91, "Critical"), ("a", "y", "80", "udp", 92, "Critical")])
    assert sorted((r.dst_ip, tuple(r.detection_sources)) for r in out) == [("x", ("RITA", "LSTM")), ("y", ("LSTM",))]


def test_last_duplicate_wins_and_moved_row_replaces(spark):
    rule = [("a", "x", "80", "tcp", 60, "low"), ("a", "x", "80", "tcp", 70, "medium"), ("a", "", "80", "tcp", 99, "high")]
    out = merged(spark, rule, [("a", "x", "80", "tcp", 50, "Low"), ("a", "x", "80", "TCP", 10, "Low")])
    assert [(r.beacon_score, r.lstm_confidence, r.threat_category) for r in out] == [(99.0, 10.0, "high")]


def test_evidence_needs_one_wildcard(spark):
    evidence = spark.createDataFrame(
        [("a", "::", "80", 1.0), ("a", "-", "80", 2.0), ("a", "x", "80", 3.0), ("b", "", "80", 4.0)],
        "src string, dst string, port string, v double")
    keys = spark.createDataFrame([("a", "y", "80"), ("a", "x", "80"), ("b", "y", "80")],
                                 "src_ip string, dst_ip string, dst_port string")
    out = {(r.src_ip, r.dst_ip): r.rita for r in merge.attach_evidence(keys, evidence).collect()}
    assert out[("a", "y")] is None and out[("a", "x")].v == 3.0 and out[("b", "y")].v == 4.0


def test_tolerant_overlay_fills_the_port(spark):
    csv = spark.createDataFrame([(1, "10.0.0.1", "::", "", 0.5, "rita_view_csv"), (2, "10.0.0.2", "z", "22", 0.7, "rita_view_csv")],
                                "ord long, src string, dst string, port string, beacon_score double, evidence_source string")
    mix = spark.createDataFrame([("::ffff:10.0.0.1", "9.9.9.9", "443", None, 7.0), ("10.0.0.3", "q", "1", 0.1, 1.0)],
                                "src string, dst string, port string, beacon_score double, connection_count double")
    out = {(r.src, r.dst, r.port): r for r in merge.overlay_tolerant(csv, mix).collect()}
    assert set(out) == {("10.0.0.1", "::", "443"), ("10.0.0.2", "z", "22"), ("10.0.0.3", "q", "1")}
    first = out[("10.0.0.1", "::", "443")]
    assert (first.beacon_score, first.connection_count, first.evidence_source) == (0.5, 7.0, "rita_mixtape")
    assert out[("10.0.0.2", "z", "22")].evidence_source == "rita_view_csv"


def test_merged_threats_plan(spark):
    beacon = spark.createDataFrame(
        [(1, "cap", "a", "b", "80:tcp:http", "0.95", "", "12"), (2, "cap", "c", "d", "53:udp:dns", "0.10", "High", "3")],
        "row_no long, source_file string, source_ip string, destination string, port_proto_service string, "
        "beacon_score string, severity string, connection_count string")
    alerts = spark.createDataFrame(
        [("f1", "a", "b", "80", "tcp", 91.0, "Critical", 10, 1.0, 0.1), ("f2", "a", "b", "80", "tcp", 80.0, "High", 10, 2.0, 0.2)],
        "source_file string, src string, dst string, port string, proto string, confidence double, risk string, "
        "event_count int, flow_gap double, gap_cv double")
    out = detection.merged_threats(beacon, alerts).collect()
    assert [(r.src_ip, r.detection_sources, r.lstm_confidence, r.threat_category) for r in out] == [
        ("a", ["RITA", "LSTM"], 91.0, "high"), ("c", ["RITA"], 0.0, "high")]
    assert out[0].rita.connection_count == 12.0
    alone = detection.merged_threats(None, alerts).collect()
    assert [(r.src_ip, r.detection_sources) for r in alone] == [("a", ["LSTM"])]


def test_keys_are_unique(spark):
    rule = [("s", d, "80", p, i, "low") for i, (d, p) in enumerate([("x", "tcp"), ("::", ""), ("", "tcp"), ("x", "")] * 3)]
    out = merge.merge_alerts(rule_rows(spark, *rule), sequence_rows(spark, ("s", "x", "80", "tcp", 50, "Low")))
    assert out.count() == out.select("src_ip", "dst_ip", "dst_port", F.lower("protocol")).distinct().count() == 1
