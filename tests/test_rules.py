"""Rule columns on stated and hand-derived cases."""

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import casts, rules, texts


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("subdomains, score, expected", [(600, 0.3, 600), (0, 0.6, 600), (0, 700, 700)])
def test_dns_value(spark, subdomains, score, expected):
    assert one(spark, v=rules.dns_value(lit(subdomains), lit(score))).v == expected


@pytest.mark.parametrize("current, confidence, expected", [
    ("low", 100, "high"), ("lstm_only", 80, "lstm_only"), ("lstm_only", 90, "high"), ("base", 10, "low"),
    ("high", 100, "high"), ("unknown", 76, "medium"), ("odd", 1, "low")])
def test_stronger_category(spark, current, confidence, expected):
    assert one(spark, v=rules.stronger_category(F.lit(current), lit(confidence))).v == expected


@pytest.mark.parametrize("top1, top2, confidence, decision", [
    (0.60, 0.50, 70, "accepted"), (0.90, 0.50, 100, "accepted"), (0.50, None, 50, "insufficient_top1_similarity"),
    (None, None, 0, "no_candidate"), (0.59, 0.1, None, "insufficient_top1_similarity"),
    (0.65, 0.63, None, "ambiguous_top1_top2_gap"), (0.65, 0.60, None, "accepted"), (0.61, None, None, "accepted")])
def test_attribution(spark, top1, top2, confidence, decision):
    row = one(spark, c=rules.attribution_confidence(lit(top1), lit(top2)), d=rules.attribution_gate(lit(top1), lit(top2)))
    assert row.d == decision
    if confidence is not None:
        assert row.c == pytest.approx(confidence)


@pytest.mark.parametrize("severity, score, expected", [
    ("", "0.400", rules.BELOW_LABEL), ("High", "0", "高风险"), ("", "0.95", "中风险"), ("", "72", "低风险"),
    ("critical", "0.5", "基础风险"), ("", "x", rules.NO_LABEL), ("-", "", rules.BELOW_LABEL)])
def test_report_label(spark, severity, score, expected):
    assert one(spark, v=rules.report_risk_label(F.lit(severity), F.lit(score))).v == expected


@pytest.mark.parametrize("status, flagged, state", [
    ("insufficient_sequence", 0, "not_evaluated"), (None, None, "not_evaluated"), ("completed", 2, "alert"),
    ("completed", 0, "normal"), ("failed", 3, "not_evaluated")])
def test_sequence_state(spark, status, flagged, state):
    assert one(spark, v=rules.sequence_state(lit(status, "string"), lit(flagged, "int"))).v == state


def likelihood(spark, n=120, window=1900, interval=16, octets=60000, port="443", protocol="tcp", service=""):
    score, reasons = rules.c2_likelihood(lit(n, "long"), lit(window), lit(interval), lit(octets, "long"), F.lit(port),
                                         F.lit(protocol), F.lit(service))
    row = one(spark, s=score, r=reasons)
    return row.s, row.r


def test_c2_likelihood(spark):
    assert likelihood(spark) == (70.0, [
        "high_repeat_count", "sustained_activity_within_window", "periodic_interval", "web_c2_capable_channel",
        "low_byte_repeated_traffic"])
    assert likelihood(spark, service="dns") == (0.0, ["excluded_dns_without_query_evidence"])
    assert likelihood(spark, protocol="icmp") == (0.0, ["excluded_icmp_without_payload_evidence"])
    assert likelihood(spark, port="445") == (0.0, ["excluded_infrastructure_port=445"])
    assert likelihood(spark, n=1, window=0, interval=0, port="22") == (4.0, ["non_web_tcp_channel=22"])


def test_category_and_decision(spark):
    row = one(
        spark,
        a=rules.threat_category(lit(95), lit(43200), lit(0), F.lit("")),
        b=rules.threat_category(lit(10), lit(43200), lit(0), F.lit("critical")),
        c=rules.threat_category(lit(100), lit(0), lit(0), F.lit("base")),
        d=rules.threat_category(lit(0), lit(0), lit(800), F.lit("")),
        e=rules.overall_decision(F.lit(1))["verdict"], f=rules.overall_decision(F.lit(0))["classification"],
        g=rules.run_conclusion(F.lit("cancelled"), F.lit(3))["label"])
    assert (row.a, row.b, row.c, row.d) == ("medium", "high", "base", "medium")
    assert (row.e, row.f, row.g) == ("恶意 C2 通信", "benign_or_low_risk", "已取消")


def test_casts(spark):
    row = one(
        spark, a=casts.integer_or_zero(F.lit("12.7")), b=casts.number_or_zero(F.lit("-")), c=casts.number_or_null(F.lit("-")),
        d=casts.number_if_present(F.lit(" ")), e=casts.number_if_present(F.lit("x")), f=casts.json_numbers(F.lit("[1, 2.5]")),
        g=casts.json_numbers(F.lit('[1, "x"]')), h=casts.json_numbers(F.lit("no")), i=casts.first_non_blank(F.lit("  "), F.lit(" a ")),
        j=casts.clean_value(F.lit("(empty)"), "?"), k=casts.number_or_null(F.lit("1d")), l=casts.number_or_zero(F.lit(" -2e3 ")))
    assert tuple(row) == (12, 0.0, None, None, 0.0, [1.0, 2.5], None, None, " a ", "?", None, -2000.0)


def test_query_text(spark):
    df = spark.createDataFrame(
        [(["RITA", "LSTM"], 95.0, 92.0, "443", "tcp", 150, 60.0, 30000, "771", "AES")],
        "detection_sources array<string>, lstm_confidence double, beacon_score double, dst_port string, protocol string, "
        "connection_count long, avg_interval double, total_bytes long, tls_ja3 string, tls_cipher string")
    assert df.select(texts.query_text(df).alias("t")).first().t == (
        "使用以下特征的 APT 组织: statistically detected periodic command and control beacon, "
        "high confidence machine learning detected C2 beacon, independent RITA and LSTM agreement on C2 behavior, "
        "TCP protocol traffic, repeated low volume network connections, periodic beacon interval, "
        "small payload heartbeat traffic, 周期性 Beacon 通信, TLS 加密通道, 使用 AES 加密套件, "
        "HTTPS encrypted web protocols for command and control")
    empty = spark.createDataFrame([("",)], "dst_port string")
    assert empty.select(texts.query_text(empty).alias("t")).first().t == "使用以下特征的 APT 组织: 可疑网络通信"


def test_signal_text(spark):
    df = spark.createDataFrame(
        [("a", "b", "8443", 92.5, 30000.0, 0.0, "medium", 147, 60.5, 1024000, "7" * 40, "C", "s.example",
          [f"q{i}" for i in range(7)], ["u1", "u2", "u3", "u4"], ["/x"])],
        "src_ip string, dst_ip string, dst_port string, beacon_score double, long_conn_value double, "
        "c2_over_dns_value double, threat_category string, conn_count long, avg_interval double, total_bytes long, "
        "tls_ja3 string, tls_cipher string, tls_server_name string, dns_queries array<string>, "
        "http_user_agents array<string>, http_uris array<string>")
    assert df.select(texts.signal_text(df).alias("t")).first().t.split("\n") == [
        "检测到疑似 C2 通信：", "源 IP: a → 目标 IP: b:8443", "威胁评分: Beacon 评分 92/100, 长连接时长 30000秒", "威胁级别: MEDIUM",
        "连接行为: 147 次连接, 平均间隔 60.5 秒, 总传输 1024000 字节", "TLS 指纹: JA3=" + "7" * 32 + "...", "加密套件: C",
        "服务器名称: s.example", "DNS 查询: q0, q1, q2, q3, q4", "User-Agent: u1, u2, u3", "HTTP URI: /x"]
    several = texts.several_signals_text(df, 5).first().text
    assert several.startswith("共检测到 1 个疑似威胁，以下为 Top 1:\n\n--- 威胁 1 ---\n检测到") and several.endswith("/x\n")


def test_citations_and_labels(spark):
    row = one(spark, a=texts.without_citations(F.lit("One  (Citation: A b)\n two (citation: c) .")),
              b=texts.labelled_value(F.lit("Group: x\nEvidence:  y z \nEvidence: q"), "Evidence"),
              c=texts.squeeze(F.lit(" a　 b\x1cc ")))
    assert tuple(row) == ("One two .", "y z", "a b c")
