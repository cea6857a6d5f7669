"""Readers and writers on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pulseloom.catalog import streams
from pulseloom import session
from pulseloom.operators.connections import connections_from_packets
from pulseloom.operators.highrisk import high_risk_rows
from pulseloom.schemas import FEATURES, GROUP_KEYS
from pulseloom.sources import captures, lines, sinks, tables


def test_csv_after_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Viewing database: x\n\nSeverity,Source IP,Beacon Score,Note\nHigh,10.0.0.1,0.9,"a, b"\n\nlow,10.0.0.2,0.1,\n')
    (tmp_path / "b.csv").write_text("src,dst,beacon-score\n1.1.1.1,2.2.2.2,0.5\nlonely\n")
    rows = lines.parse_csv_with_preamble(lines.read_lines(spark, str(tmp_path)))
    got = sorted((r.source_ip or "", r.src or "", r.beacon_score or "", r.note or "") for r in rows.collect())
    assert got == [("", "1.1.1.1", "0.5", ""), ("", "lonely", "", ""), ("10.0.0.1", "", "0.9", "a, b"), ("10.0.0.2", "", "0.1", "")]
    only = lines.parse_csv_with_preamble(lines.read_lines(spark, str(tmp_path)), header_prefix="Severity,")
    assert only.count() == 2
    one = rows.where(F.col("path").endswith("a.csv")).withColumn("source_file", F.lit("a"))
    risky = high_risk_rows(one, order="at").orderBy("src_ip").collect()
    assert [(r.src_ip, r.dst_ip, r.dst_port, r.threat_category, r.reasons) for r in risky] == [
        ("10.0.0.1", "unknown", "unknown", "high", ["severity=high", "beacon≥70", "beacon≥base(50)"])]


def test_old_feature_names(spark, tmp_path):
    (tmp_path / "f.csv").write_text("src,dst,port,proto,ts,flow_gap\na,b,443,tcp,1.5,2\n")
    r = tables.read_feature_csv(spark, str(tmp_path)).first()
    assert (r.src_ip, r.dst_ip, r.dst_port, r.ip_protocol, r.start_time, r.source_file) == ("a", "b", "443", "tcp", "1.5", "zeek")


def test_tsv_logs(spark, tmp_path):
    (tmp_path / "conn.log").write_bytes(
        b"#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\tid.resp_p\tproto\torig_bytes\n#types\ttime\n"
        b"1.0\ta\tb\t80\ttcp\t-\nbad\trow\n\n2.0\ta\xff\tb\t80\ttcp\t7\n")
    (tmp_path / "other.log").write_text("#fields\tid.orig_h\tts\nx\t9.0\n")
    rows = lines.parse_tsv_logs(lines.read_lines(spark, str(tmp_path)), lines.CONN_FIELDS)
    got = sorted((r.ts, r.orig_h, r.resp_p, r.orig_bytes) for r in rows.select("ts", "orig_h", "resp_p", "orig_bytes").collect() if True)
    assert got[0] == ("1.0", "a", "80", "-") and got[1][0] == "2.0" and got[2] == ("9.0", "x", None, None) and len(got) == 3


def test_row_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("src_ip,dst_ip,n\n" + "".join(f"a,b,{i}\n" for i in range(5000)))
    (tmp_path / "small.csv").write_text("src_ip,dst_ip,n\n" + "".join(f"a,b,{i}\n" for i in range(10)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = tables.read_connection_csvs(spark, str(tmp_path)).collect()
        assert len(rows) == 5010 and all(int(r.n) == r.row_no for r in rows)
        kept = tables.read_connection_csvs(spark, str(tmp_path), stride=7, max_rows=100, max_files=1).collect()
        assert sorted(int(r.n) for r in kept) == list(range(0, 100, 7))
        assert {r.source_file for r in kept} == {"big.csv"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_split_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_split(spark, str(tmp_path), "dev")
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.csv").write_text("flow_gap,label\n1,0\n")
    with pytest.raises(KeyError, match="duration"):
        tables.load_split(spark, str(tmp_path), "train")
    columns = [*GROUP_KEYS, "start_time", *FEATURES, "label"]
    (tmp_path / "val").mkdir()
    (tmp_path / "val" / "a.csv").write_text(",".join(columns) + "\n" + ",".join(["1"] * len(columns)) + "\n")
    (tmp_path / "val" / "empty.csv").write_text(",".join(columns) + "\n")
    assert tables.load_split(spark, str(tmp_path), "val").count() == 1


def test_mixtape_skips_bad_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"src":"a","dst":"b","count":3,"ts_intervals":[1,2]}\nnot json\n{"src":"c","dst":"d","extra":1}\n')
    rows = tables.read_mixtape(spark, str(tmp_path)).collect()
    assert sorted((r.src, r["count"], r.ts_intervals) for r in rows) == [("a", 3, [1.0, 2.0]), ("c", None, None)]


def test_bundles_keep_file_order(spark, tmp_path):
    for name, objects in (("b.json", ["x", "y"]), ("a.json", ["z"])):
        (tmp_path / name).write_text(json.dumps({"objects": [{"type": "tool", "id": o, "name": o, "n": {"q": 1}} for o in objects]}, indent=1))
    rows = tables.read_bundles(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")]).collect()
    assert sorted((r.file_ord, r.pos, r.id) for r in rows) == [(0, 0, "x"), (0, 1, "y"), (1, 0, "z")]


def test_manifest(spark, tmp_path):
    good = "file_name,label,split,source,scenario\na.pcap,malicious,train,s1,x\nb.pcap,benign,val,s2,y\n"
    (tmp_path / "m.csv").write_text(good)
    m = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    f = spark.createDataFrame([("a.pcap", "old")], "file_name string, source_file string")
    r = tables.label_features(f, m).first()
    assert (r.label, r.split, r.dataset, r.scenario, r.source_file) == (1, "train", "s1", "x", "s1__a.pcap")
    assert tables.read_manifest(spark, str(tmp_path / "m.csv"), ["b.pcap"]).count() == 1
    (tmp_path / "bad.csv").write_text(good + "c.pcap,odd,train,s,x\n")
    with pytest.raises(ValueError):
        tables.read_manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "short.csv").write_text("file_name,label\na,benign\n")
    with pytest.raises(KeyError):
        tables.read_manifest(spark, str(tmp_path / "short.csv"))


def test_run_reports(spark, tmp_path):
    metrics = dict(threshold=0.5, tn=1, fp=0, fn=0, tp=1, recall=1.0, fpr=0.0, precision=1.0, f1=1.0)
    for seed in (1, 2):
        (tmp_path / f"seed_{seed}.json").write_text(json.dumps({"seed": seed, "best_val_loss": 0.1, "validation_windows": metrics}, indent=2))
    (tmp_path / "other.json").write_text("{}")
    rows = tables.read_run_reports(spark, str(tmp_path))
    assert sorted((r.seed, r.validation_windows.recall) for r in rows.collect()) == [(1, 1.0), (2, 1.0)]
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        tables.read_run_reports(spark, str(tmp_path / "none")).collect()


def test_merged_threat_round_trip(spark, tmp_path):
    merged = spark.createDataFrame(
        [("f", "a", "b", "80", "tcp", ["RITA", "LSTM"], 90.5, 1.0, 2.0, "high", 3, 4, 95.0, "Critical"),
         ("f", "c", "d", "80", "tcp", ["LSTM"], 0.0, 0.0, 0.0, "low", 0, 0, 50.0, "Low")],
        "source_file string, src_ip string, dst_ip string, dst_port string, protocol string, detection_sources array<string>, "
        "beacon_score double, long_conn_value double, c2_over_dns_value double, threat_category string, connection_count long, "
        "total_bytes long, lstm_confidence double, lstm_risk string")
    sinks.write_merged_threats(merged, str(tmp_path / "out"))
    raw = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert {r.threat_index: r.detection_sources for r in raw.collect()} == {"1": "RITA;LSTM", "2": "LSTM"}
    back = tables.read_merged_threats(spark, str(tmp_path / "out")).orderBy("threat_index").collect()
    assert (back[0].src_ip, back[0].detection_sources, back[0].beacon_score, back[0].dataset_label) == ("a", ["RITA", "LSTM"], 90.5, "")


def test_empty_csv_keeps_header(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([], "a string, b int"), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["a", "b"]


def tcp_frame(src, dst, sport, dport, flags, seq, payload=b"", vlan=False):
    tcp = struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0) + payload
    if ":" in src:
        import ipaddress

        ip = struct.pack("!IHBB", 0x60000000, len(tcp), 6, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed
        kind = 0x86DD
    else:
        ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, *(bytes(map(int, a.split("."))) for a in (src, dst)))
        kind = 0x0800
    return b"\x00" * 12 + (b"\x81\x00\x00\x01" if vlan else b"") + struct.pack("!H", kind) + ip + tcp


def pcap(frames):
    out = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, f in frames:
        out += struct.pack("<IIII", int(ts), round((ts % 1) * 1e6), len(f), len(f)) + f
    return out


def pcapng(frames):
    def block(kind, body):
        body += b"\x00" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    for ts, f in frames:
        ns = round(ts * 1e9)
        out += block(6, struct.pack("<IIIII", 0, ns >> 32, ns & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_captures(spark, tmp_path):
    a = [(100.25, tcp_frame("10.0.0.1", "10.0.0.2", 1000, 80, 2, 7)), (100.5, b"\x00" * 60),
         (101.0, tcp_frame("10.0.0.2", "10.0.0.1", 80, 1000, 0x12, 9, b"xy", vlan=True)),
         (102.0, tcp_frame("10.0.0.1", "10.0.0.2", 1000, 80, 0x11, 8))]
    b = [(5.5, tcp_frame("2001:db8::1", "2001:db8::2", 5, 443, 2, 1))]
    for folder, name, data in (("cs", "a.pcap", pcap(a)), ("benign", "b.pcapng", pcapng(b)), ("benign", "note.txt", b"x")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(data)
    found = captures.discover_captures(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.label, r.expected_malicious) for r in found] == [("b.pcapng", "benign", False), ("a.pcap", "cs", True)]
    assert captures.discover_captures(spark, str(tmp_path), limit=1).count() == 1
    packets = captures.read_captures(spark, [str(tmp_path / "cs"), str(tmp_path / "benign")], "*.pcap*")
    rows = sorted(packets.collect())
    assert [(r.source_file, r.pkt_no, r.ts, r.src_ip, r.src_port, r.flags, r.seq, r.length) for r in rows] == [
        ("a.pcap", 0, 100.25, "10.0.0.1", 1000, 2, 7, 54), ("a.pcap", 2, 101.0, "10.0.0.2", 80, 0x12, 9, 60),
        ("a.pcap", 3, 102.0, "10.0.0.1", 1000, 0x11, 8, 54), ("b.pcapng", 0, 5.5, "2001:db8::1", 5, 2, 1, 74)]
    c = {r.source_file: r for r in connections_from_packets(packets).collect()}
    assert (c["a.pcap"].orig_packets, c["a.pcap"].resp_bytes, c["a.pcap"].duration, c["a.pcap"].direction_confidence) == (2, 60, 1.75, 1.0)


def test_run_artifacts_are_replaced_one_by_one(spark, tmp_path):
    for run, n in (("a", 3), ("b", 2), ("a", 1)):
        sinks.write_run(spark.range(n), str(tmp_path), "threats", run)
    rows = spark.read.parquet(str(tmp_path / "threats")).groupBy("analysis_id").count().collect()
    assert {r.analysis_id: r["count"] for r in rows} == {"a": 1, "b": 2}


def test_many_headers_and_wide_logs(spark, tmp_path):
    for k in range(230):
        (tmp_path / f"f{k}.csv").write_text(f"note\nsrc,extra{k},dst\ns{k},x{k},d{k}\n")
    rows = lines.parse_csv_with_preamble(lines.read_lines(spark, str(tmp_path / "*.csv")))
    assert len(rows.columns) == 2 + 232
    found = {(r["src"], r["dst"], r["extra7"]) for r in rows.select("src", "dst", "extra7").collect()}
    assert found == {(f"s{k}", f"d{k}", "x7" if k == 7 else None) for k in range(230)}
    wide = 10_050
    names = "\t".join(["#fields", "ts", *[f"c{i}" for i in range(wide)], "uid"])
    (tmp_path / "wide.log").write_text(names + "\n" + "\t".join(["1.5", *["-"] * wide, "u1"]) + "\n")
    logged = lines.parse_tsv_logs(lines.read_lines(spark, str(tmp_path / "wide.log")), {"ts": "ts", "uid": "uid"})
    assert [(r.ts, r.uid) for r in logged.collect()] == [("1.5", "u1")]


def test_capture_without_rows_leaves_a_header(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1.0)], "split string, source_file string, duration double")
    listed = spark.createDataFrame([("train", "a"), ("val", "b")], "split string, source_file string")
    sinks.write_features(rows, str(tmp_path / "out"), "csv", listed)
    (empty,) = (tmp_path / "out" / "split=val" / "source_file=b").glob("part-*")
    assert empty.read_text().strip() == "duration"
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("1.0", "train", "a")]


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        sparkContext = Elsewhere()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_bundles_are_files_of_one_folder(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(streams, "shared_folder", lambda spark: str(tmp_path / "bundles"))
    kinds = streams.src7(spark, "/root/testdata/sf0.001").collect()
    parts = [p for p in (tmp_path / "bundles").rglob("*.txt")]
    assert len(parts) > 2 and all(p.parent == tmp_path / "bundles" for p in parts)  # no folder of its own to be made and moved
    assert all(p.read_text().count("\n") == 1 for p in parts if p.stat().st_size)
    assert {r.type: r.objects for r in kinds}["relationship"] > 5000
