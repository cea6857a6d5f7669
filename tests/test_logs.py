"""Series, summaries, histograms and facts."""

import math

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import histogram, logs
from pulseloom.plans.hotgroups import Limits
from pulseloom.schemas import MIXTAPE, OLD_FEATURES

CONN = "row_no long, ts string, orig_h string, resp_h string, resp_p string, orig_bytes string, resp_bytes string"
THREAT = "threat_id string, src_ip string, dst_ip string, dst_port string"


def series(spark, conn, threats, limits=Limits()):
    rows = logs.series_rows(spark.createDataFrame(threats, THREAT), conn, limits)
    return [(r["index"], r.interval_seconds, r.frequency_per_minute, r.total_bytes) for r in rows.orderBy("threat_id", "index").collect()]


@pytest.mark.parametrize("limits", [Limits(), Limits(min_rows=1, max_blocks=10)])
def test_series_without_byte_columns(spark, limits):
    conn = spark.createDataFrame([(3, "112", "a", "b", "80"), (1, "100", "a", "x", "80"), (2, "104", "a", "y", "80")],
                                 "row_no long, ts string, orig_h string, resp_h string, resp_p string")
    assert series(spark, conn, [("t", "a", "::", "80")], limits) == [(1, 0, 0, 0), (2, 4, 15, 0), (3, 8, 7.5, 0)]


def test_unparsable_bytes_drop_the_row(spark):
    conn = spark.createDataFrame([(1, "100", "a", "b", "80", "5", "5"), (2, "104", "a", "b", "80", "-", "1"),
                                  (3, "112", "a", "b", "80", "", "-3.5"), (4, "x", "a", "b", "80", "1", "1")], CONN)
    assert series(spark, conn, [("t", "a", "b", "80")]) == [(1, 0, 0, 10), (2, 12, 5, 0)]


def test_histogram_statistics(spark):
    df = spark.createDataFrame([([0.0, 1.0, 9.0, 4.0], [1.0, 2.0, 4.0, 0.0]), ([], [])], "v array<double>, c array<double>")
    row, empty = histogram.with_histogram_statistics(df, "v", "c").orderBy(F.desc(F.size("v"))).select(*OLD_FEATURES).collect()
    assert list(empty) == [0.0] * 15
    mean = 38 / 7
    std = math.sqrt((mean ** 2 + 2 * (1 - mean) ** 2 + 4 * (9 - mean) ** 2) / 7)
    assert list(row)[:8] == pytest.approx([38, 0, 9, mean, std, 4 / 7, 2 / 7, 1 / 7]) and list(row)[8:] == [0.0] * 7


def test_mixtape_evidence(spark):
    values = dict.fromkeys(MIXTAPE.names) | dict(
        src="::ffff:192.168.56.5", dst="::", port_proto_service=["80:tcp:http"], ts_score=0.91, ds_score=0.82, dur_score=0.73,
        hist_score=0.64, ds_sizes=[512.0, 1024.0], ds_size_counts=[9.0, 6.0], ts_intervals=[])
    df = spark.createDataFrame([tuple(values[n] for n in MIXTAPE.names) + (1,)], MIXTAPE.add("row_no", "long"))
    r = histogram.mixtape_evidence(df).first()
    assert (r.src, r.dst, r.port, r.protocol) == ("192.168.56.5", "::", "80", "tcp")
    assert (r.timestamp_score, r.datasize_score, r.duration_score, r.histogram_score) == (0.91, 0.82, 0.73, 0.64)
    assert r.ds_sizes == [512.0, 1024.0] and r.ts_intervals is None and r.beacon_score is None


def test_first_rows_and_details(spark):
    web = spark.createDataFrame([(i, "a", "b", f"ua{i % 3}", f"/{i}", f"q{i}", f"j{i}", "c", "s") for i in range(25, 0, -1)],
                                "row_no long, orig_h string, resp_h string, user_agent string, uri string, query string, "
                                "ja3 string, cipher string, server_name string")
    conn = spark.createDataFrame([(1, "10", "a", "b", "80", "5", "-"), (2, "40", "a", "b", "80", "x", "7")], CONN)
    conn = conn.selectExpr("*", "'1.5' as duration")
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "orig_h string, resp_h string")
    out = {r.resp_h: r for r in logs.connection_details(pairs, conn, web, web, web).collect()}
    b = out["b"]
    assert (b.conn_count, b.total_duration, b.total_bytes, b.avg_interval, b.tls_ja3) == (2, 3.0, 12, 30.0, "j1")
    assert b.http_uris == [f"/{i}" for i in range(1, 11)] and b.http_user_agents == ["ua0", "ua1", "ua2"]
    assert out["z"].conn_count == 0 and out["z"].dns_queries == [f"q{i}" for i in range(1, 11)] and out["z"].tls_ja3 == ""


def test_web_flow_rows(spark):
    conn = spark.createDataFrame(
        [("1", "a", "1", "b", "443", "tcp", "3", "2", "2"), ("1", "a", "1", "b", "443", "udp", "3", "2", "2"),
         ("1", "a", "1", "b", "8443", "tcp", "3", "2", "2"), ("1", "a", "1", "b", "80", "tcp", "-", "20", "2"),
         ("1", "", "1", "b", "80", "tcp", "3", "2", "2")],
        "ts string, orig_h string, orig_p string, resp_h string, resp_p string, proto string, duration string, "
        "orig_pkts string, resp_pkts string")
    rows = {r.dst_port: r for r in logs.web_flow_rows(conn, "x").collect()}
    assert set(rows) == {"443", "80"}
    assert (rows["443"].iat_oresp_total, rows["443"].iat_oresp_mean, rows["443"].iat_oresp_nf_2, rows["443"].iat_oresp_nf_3) == (3.0, 1.0, 1.0, 0.0)
    assert (rows["80"].packet_nb, rows["80"].iat_oresp_total, rows["80"].iat_oresp_nf_0) == (22, 0.0, 0.0)


def test_facts_of_a_mismatch(spark):
    http = spark.createDataFrame([(1, "c", "192.168.56.5", "192.168.56.4", "80", "www.amazon.com"),
                                  (2, "c", "192.168.56.5", "8.8.8.8", "80", "x")],
                                 "row_no long, source_file string, orig_h string, resp_h string, resp_p string, host string")
    ssl = spark.createDataFrame([(1, "c", "s", "t2", "443", "b.example", "TLSv12"), (2, "c", "s", "t1", "443", "(empty)", "TLSv12"),
                                 (1, "d", "s", "t1", "443", "a.example", "-")],
                                "row_no long, source_file string, orig_h string, resp_h string, resp_p string, server_name string, version string")
    out = {r.source_file: r for r in logs.http_tls_facts(http, ssl).collect()}
    c, d = out["c"], out["d"]
    assert (c.http_requests, c.mismatches, c.mismatch_host, c.mismatch_target, c.protocol) == (2, 1, "www.amazon.com", "192.168.56.4", "HTTP")
    assert (c.tls_sni, c.tls_targets, c.tls_versions) == ("b.example", "t1, t2", "TLSv12")
    assert (d.protocol, d.http_requests, d.tls_versions, d.target) == ("TLS/HTTPS", 0, "", "t1")
