"""Packets to connections against a plain state machine, on hot and ordinary groups."""

import math
import random

import pytest

from pulseloom.operators.connections import connection_rows, split_connections
from pulseloom.plans.hotgroups import Limits
from pulseloom.schemas import PACKETS

CUT = Limits(min_rows=4, max_blocks=1000)


def pkt(no, ts, src, dst, flags=0x10, seq=0, length=100, cap="c"):
    return (cap, no, float(ts), src, 1000, dst, 80, flags, seq, length)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def starts_of(spark, rows, limits=Limits()):
    out = split_connections(frame(spark, rows), limits=limits).collect()
    return {
        (r.source_file, r.pkt_no): (r.conn_start, r.forward == r.key_forward,
                                    r.key_syn_no is not None and r.key_syn_no <= r.conn_start)
        for r in out
    }


def machine(rows):
    """Walk the packets of each capture in file order and keep one open connection per key."""
    open_by_key, result = {}, {}
    for cap, no, ts, src, sport, dst, dport, flags, seq, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        ahead, back = (cap, src, sport, dst, dport), (cap, dst, dport, src, sport)
        syn = bool(flags & 2) and not flags & 16
        if syn:
            key, sure = ahead, True
        elif ahead in open_by_key:
            key, sure = ahead, open_by_key[ahead]["sure"]
        elif back in open_by_key:
            key, sure = back, open_by_key[back]["sure"]
        else:
            key, sure = ahead, False
        state = open_by_key.get(key)
        fresh = state is None or ts - state["last"] > 300
        if not fresh and syn:
            fresh = state["ended"] or state["seq"] != seq
        if fresh:
            state = open_by_key[key] = {"start": no, "sure": sure, "seq": seq if syn else None, "ended": False}
        state["last"] = ts
        state["ended"] = state["ended"] or bool(flags & 5)
        result[(cap, no)] = (state["start"], key == ahead, state["sure"])
    return result


@pytest.mark.parametrize("limits", [Limits(), CUT])
def test_random_packets_match_state_machine(spark, limits):
    rng = random.Random(7)
    rows = []
    for case in range(300):
        ts = 0.0
        for no in range(rng.randint(1, 25)):
            ts += rng.choice([0, 1, 5, -3, 299, 300, 301])
            src, dst = ("a", "b") if rng.random() < 0.5 else ("b", "a")
            rows.append(pkt(no, ts, src, dst, rng.choice([0x02, 0x12, 0x10, 0x11, 0x04, 0x02]),
                            rng.choice([1, 2]), rng.randint(40, 90), f"c{case}"))
    assert starts_of(spark, rows, limits) == machine(rows)


def test_retransmitted_syn_and_new_syn(spark):
    assert {v[0] for v in starts_of(spark, [pkt(0, 10, "a", "b", 2, 100), pkt(1, 11, "a", "b", 2, 100)]).values()} == {0}
    assert {v[0] for v in starts_of(spark, [pkt(0, 10, "a", "b", 2, 100), pkt(1, 11, "a", "b", 2, 200)]).values()} == {0, 1}
    closed = [pkt(0, 10, "a", "b", 2, 100), pkt(1, 11, "a", "b", 0x11), pkt(2, 12, "a", "b", 2, 100)]
    assert {v[0] for v in starts_of(spark, closed).values()} == {0, 2}


def test_idle_limit_is_strict(spark):
    assert {v[0] for v in starts_of(spark, [pkt(0, 0, "a", "b"), pkt(1, 300, "a", "b")]).values()} == {0}
    assert {v[0] for v in starts_of(spark, [pkt(0, 0, "a", "b"), pkt(1, 301, "a", "b")]).values()} == {0, 1}


def test_orientation_and_confidence(spark):
    rows = [pkt(0, 0, "b", "a"), pkt(1, 1, "a", "b", 2, 5), pkt(2, 2, "b", "a")]
    got = starts_of(spark, rows)
    assert [got[("c", i)] for i in range(3)] == [(0, True, False), (1, True, True), (0, True, False)]


@pytest.mark.parametrize("limits", [Limits(), CUT])
def test_packet_gap_statistics(spark, limits):
    times = [10.0, 10.2, 11.0, 11.5]
    row = connection_rows(
        split_connections(frame(spark, [pkt(i, t, "a", "b", length=50) for i, t in enumerate(times)])),
        limits=Limits(min_rows=1, max_blocks=100) if limits is CUT else limits).first()
    assert row.packet_iat_min == pytest.approx(0.2)
    assert row.packet_iat_max == pytest.approx(0.8)
    assert row.packet_iat_mean == pytest.approx(0.5)
    assert row.packet_iat_stddev == pytest.approx(math.sqrt(0.06))
    assert [row[f"packet_iat_{i}"] for i in range(5)] == pytest.approx([0.2, 0.8, 0.5, 0.0, 0.0])
    assert (row.orig_packets, row.resp_packets, row.orig_bytes, row.packet_ratio) == (4, 0, 200, 1.0)


def test_hot_connections_equal_plain_plan(spark):
    rng = random.Random(3)
    rows = [pkt(i, i * 2.5 + rng.random(), *(("a", "b") if rng.random() < .6 else ("b", "a")),
                rng.choice([0x10, 0x10, 0x10, 0x02, 0x11]), rng.choice([1, 2])) for i in range(400)]
    plain = connection_rows(split_connections(frame(spark, rows)))
    cut = connection_rows(split_connections(frame(spark, rows), limits=CUT), limits=CUT)
    key = lambda r: (r.src_ip, r.conn_start)
    a, b = sorted(plain.collect(), key=key), sorted(cut.collect(), key=key)
    assert len(a) == len(b) > 5
    for x, y in zip(a, b):
        for name in x.asDict():
            assert x[name] == (pytest.approx(y[name]) if isinstance(x[name], float) else y[name]), name
