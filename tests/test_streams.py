"""Streams give the rows of the batch plan, however the input is cut into micro-batches."""

import random

import numpy as np
import pandas as pd
import pytest

from pulseloom.operators import scoring
from pulseloom.operators.connections import connections_from_packets
from pulseloom.operators.hourly import hourly_aggregates
from pulseloom.plans.beacons import beacon_alerts, scored_windows
from pulseloom.schemas import PACKETS
from pulseloom.session import shared_folder
from pulseloom.streaming import alerts, arrivals
from pulseloom.streaming import connections as stream_connections
from pulseloom.streaming.connections import connection_stream
from pulseloom.streaming.hourly import hourly_aggregate_stream

A, B = ("10.0.0.1", 5000), ("10.0.0.2", 443)


def packet(n, ts, source, target, flags=0x10, seq=0):
    return ("cap", n, 1e6 + ts, *source, *target, flags, seq, 60)


def files(spark, batches):
    folder = shared_folder(spark)
    for rows in batches:
        spark.createDataFrame(rows, PACKETS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return folder


def run_connections(spark, batches):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = files(spark, batches)
        stream = connection_stream(spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()
    finally:
        spark.conf.unset(name)


def test_traffic_that_returns_after_expiry(spark):
    other = ("10.0.0.9", 1)
    first = [packet(0, 0, A, B, flags=0x02, seq=7), packet(1, 1, B, A)]
    silence = [packet(2, 5_000, other, B)]
    late = [packet(3, 10_000, B, A)]  # the server speaks first after the state has expired
    end = [packet(4, 50_000, other, B)]
    batches = [first, silence, late, end]
    got = {(r.lo_ip, r.conn_start, r.key_forward, r.direction_confidence, r.orig_packets, r.resp_packets)
           for r in run_connections(spark, batches) if r.lo_ip == "10.0.0.1"}
    plan = connections_from_packets(spark.createDataFrame([p for b in batches for p in b], PACKETS))
    want = {("10.0.0.1", r.conn_start, r.src_ip == "10.0.0.1", r.direction_confidence, r.orig_packets, r.resp_packets)
            for r in plan.where("src_ip in ('10.0.0.1', '10.0.0.2') and dst_ip in ('10.0.0.1', '10.0.0.2')").collect()}
    assert got == want == {("10.0.0.1", 0, True, 1.0, 1, 1), ("10.0.0.1", 3, True, 1.0, 0, 1)}


@pytest.mark.parametrize("per_trigger", [1, 10])
def test_one_group_over_two_files(spark, per_trigger):
    rows = [packet(i, i * 1000.0, ("10.0.0.1", 4000 + i), B, flags=0x02, seq=i) for i in range(18)]
    folder = files(spark, [rows[:9], rows[9:]])
    arrivals.start_arrivals(spark, f"{folder}/in", f"{folder}/out", 0.5, checkpoint=f"{folder}/c", files_per_trigger=per_trigger,
                            available_now=True).awaitTermination()
    got = arrivals.current_alerts(spark, f"{folder}/out")
    want = beacon_alerts(connections_from_packets(spark.createDataFrame(rows, PACKETS)), ["conn_start"], 0.5)
    columns = ["src", "dst", "port", "confidence"]
    assert got.select(columns).collect() == want.select(columns).collect() and want.count() == 1


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def traffic():
    """Three groups on many ports with regular, erratic and equal gaps, and one late packet that ends the stream's waiting."""
    rnd, rows = random.Random(4), []
    for host, gap, spread in (("10.0.0.1", 900, 0), ("10.0.0.3", 700, 650), ("10.0.0.4", 1000, 100)):
        at = 0.0
        for i in range(26):
            at += gap + rnd.randint(0, spread)
            rows.append((at, (host, 4000 + i), B, 0x02, i))
            for k in range(rnd.randint(0, 3)):
                rows.append((at + 1 + k, B, (host, 4000 + i), 0x10, 0))
    rows.sort(key=lambda r: r[0])
    rows.append((500_000.0, ("10.0.0.9", 1), B, 0x10, 0))
    return [packet(n, ts, a, b, flags=flags, seq=seq) for n, (ts, a, b, flags, seq) in enumerate(rows)]


@pytest.mark.parametrize("cuts, swaps", [(1, 0), (3, 0), (5, 4)])
def test_alert_stream_equals_batch(spark, rocksdb, cuts, swaps):
    rows = traffic()
    size = -(-len(rows) // cuts)
    batches = [rows[i:i + size] for i in range(0, len(rows), size)]
    for a, b in list(zip(batches, batches[1:]))[:swaps]:  # neighbours across a cut arrive in the wrong order, within the lateness
        a[-1], b[0] = b[0], a[-1]
    folder = files(spark, batches)
    stream = alerts.best_window_stream(
        spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), lateness="2 hours")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    # a batch reads its own rows, whatever came before
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [len(b) for b in batches]
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    connections = connections_from_packets(spark.createDataFrame(rows, PACKETS))
    best = scoring.best_windows(scored_windows(connections, ["conn_start"]))

    def found(df):
        return {(r.src_ip, r.dst_ip, r.dst_port, r.window_index, r.window_count, r.window_start_time, r.window_end_time): (
            round(r.probability, 9), round(r.first_flow_gap, 6), round(r.first_gap_cv, 9)) for r in df.collect()}

    assert found(alerts.latest(out)) == found(best) and best.count() == 3
    want = scoring.by_confidence(scoring.alerts(best, 0.95))
    assert alerts.current_alerts(out, 0.95).collect() == want.collect() and 0 < want.count() < 3


def test_rolled_variation():
    rng = np.random.default_rng(2)
    gaps = np.concatenate([[0.0, 0.0, 0.0], rng.integers(0, 50, 40).astype(float)])
    want = []
    for i in range(len(gaps)):
        some = gaps[max(0, i - 4):i + 1]
        want.append(some.std() / some.mean() if some.mean() > 1e-9 else 0.0)
    for cut in range(1, len(gaps)):
        got = np.concatenate([alerts.rolled(np.empty(0), gaps[:cut]), alerts.rolled(gaps[max(0, cut - 4):cut], gaps[cut:])])
        assert got == pytest.approx(want)


@pytest.mark.parametrize("cuts", [1, 3, 5])
def test_hourly_stream_equals_batch(spark, cuts):
    rnd = random.Random(7)
    kind = ("row_no long, source_file string, src_ip string, dst_ip string, dst_port string, protocol string, service string, window_start long, "
            "ts double, duration double, octets long, orig_pkts long, resp_pkts long, conn_state string, history string, label string")
    rows = []
    for n in range(400):
        ts = 1e6 + n * 60 + rnd.randint(0, 400)
        rows.append((n, f"f{rnd.randint(0, 2)}", f"h{rnd.randint(0, 2)}", "d", rnd.choice(["", "443"]), "tcp", "", int(ts // 3600 * 3600), ts,
                     float(rnd.randint(0, 9)), rnd.randint(0, 99), 1, 2, rnd.choice(["", "SF", "S0"]), rnd.choice(["", "Dd", "ShAD"]),
                     rnd.choice(["none", "C2", "Discovery"])))
    rows.append((999, "f9", "end", "d", "1", "tcp", "", 0, 2e6, 0.0, 0, 0, 0, "", "", "none"))
    folder = shared_folder(spark)
    for i in range(cuts):
        part = rows[i * len(rows) // cuts:(i + 1) * len(rows) // cuts]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = hourly_aggregate_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), lateness="1 hour")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(
        availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    want = hourly_aggregates(spark.createDataFrame(rows, kind).where("src_ip != 'end'")).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 20


def test_packets_of_several_frames_come_in_order():
    frames = [pd.DataFrame({"ts": [3.0, 1.0], "pkt_no": [3, 1], "forward": [True, False], "syn": [False, True], "ends": [False, False],
                            "seq": [None, 5], "length": [10, 20], "other": ["a", "b"]}),
              pd.DataFrame({"ts": [1.0, 2.0], "pkt_no": [0, 2], "forward": [True, True], "syn": [False, False], "ends": [True, False],
                            "seq": [7, 8], "length": [None, 1], "other": ["a", "b"]})]
    assert [(t, n) for t, n, *_ in stream_connections._in_order(iter(frames))] == [(1.0, 0), (1.0, 1), (2.0, 2), (3.0, 3)]
