"""A processor of a stream takes the keys of a bucket in one call, with one read and one write of state for each key."""

import json
from types import SimpleNamespace

import pandas as pd

from pulseloom.operators.connections import PAIR
from pulseloom.schemas import GROUP_KEYS, PACKETS
from pulseloom.session import shared_folder
from pulseloom.streaming import arrivals
from pulseloom.streaming.alerts import GroupScores
from pulseloom.streaming.connections import ConnectionBuilder, bucketed, key_of


class Map(dict):
    reads = writes = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


def at(watermark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)


def expire(processor, handle, watermark):
    """The rows of all timers that a watermark has passed."""
    due, out = sorted(t for t in handle.timers if t <= watermark), []
    handle.timers = [t for t in handle.timers if t > watermark]
    for t in due:
        out += processor.handleExpiredTimer((0,), at(watermark), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
    return pd.concat(out) if out else pd.DataFrame()


def name(i):
    return json.dumps(dict(zip(PAIR, ("cap", "10.0.0.1", i, "10.0.0.2", 443))))


def packets(times):
    return pd.DataFrame({
        "name": [name(i) for i, _ in times], "ts": [t for _, t in times], "pkt_no": range(len(times)), "forward": True, "syn": False,
        "ends": False, "seq": 0, "length": 10})


def test_many_pairs_of_a_bucket():
    handle, builder = Handle(), ConnectionBuilder(100.0)
    builder.init(handle)
    times = [(i, 1000.0 + k + i / 1000) for i in range(300) for k in range(4)]
    assert not list(builder.handleInputRows((0,), iter([packets(times[:500]), packets(times[500:])]), at(0)))
    pairs = handle.maps["open"]
    assert len(pairs) == pairs.reads == pairs.writes == 300 and len(handle.timers) <= 2
    # every third pair goes on, so it isn't given out with the others
    list(builder.handleInputRows((0,), iter([packets([(i, 1050.0) for i in range(0, 300, 3)])]), at(0)))
    done = expire(builder, handle, 1103_200)
    assert sorted(done["lo_port"]) == [i for i in range(200) if i % 3] and set(done["orig_packets"]) == {4}
    done = expire(builder, handle, 1104_000)
    assert sorted(done["lo_port"]) == [i for i in range(200, 300) if i % 3]
    assert expire(builder, handle, 1150_000).empty
    done = expire(builder, handle, 1150_001)
    assert sorted(done["lo_port"]) == list(range(0, 300, 3)) and set(done["orig_packets"]) == {5} and set(done["duration"].round(1)) <= {49.7, 49.8, 49.9, 50.0}
    assert not handle.timers and not handle.maps["due"]


def test_an_earlier_end_than_the_list_of_a_pair():
    handle, builder = Handle(), ConnectionBuilder(100.0)
    builder.init(handle)
    list(builder.handleInputRows((0,), iter([packets([(1, 1100.0)])]), at(0)))
    late = packets([(1, 1000.0)]).assign(syn=True, seq=5)  # a new connection that a packet of the time before starts
    assert len(next(builder.handleInputRows((0,), iter([late]), at(0)))) == 1
    assert expire(builder, handle, 1100_001)["start_time"].tolist() == [1000.0]
    assert expire(builder, handle, 10_000_000).empty


def test_many_groups_of_a_bucket():
    handle, scores = Handle(), GroupScores()
    scores.init(handle)
    names = [json.dumps(dict(zip(GROUP_KEYS, ("cap", f"10.0.0.{i}", "10.0.0.2", 443, "tcp")))) for i in range(50)]

    def starts(first, last):
        rows = [(n, 60.0 * k, k) for n in names for k in range(first, last)]
        return iter([pd.DataFrame(rows, columns=["name", "start_time", "conn_start"])])

    assert not list(scores.handleInputRows((0,), starts(0, 6), at(0)))
    assert handle.maps["runs"].reads == 0 and len(handle.timers) == 1
    assert not list(scores.handleInputRows((0,), starts(6, 14), at(400_000)))  # seven rows have passed, so no window yet
    out = expire(scores, handle, 10_000_000)
    assert sorted(out["src_ip"]) == sorted(f"10.0.0.{i}" for i in range(50)) and set(out["window_count"]) == {5}
    assert handle.maps["runs"].reads == handle.maps["runs"].writes == 100


def test_names_of_keys_with_nulls(spark):
    rows = [("cap", None, 1, "a", 443), ("cap", "a", 1, None, 443), (None, "a", 1, "a", 443), ('"', "{}", None, "\\", 0)]
    kind = "source_file string, lo_ip string, lo_port int, hi_ip string, hi_port int"
    found = bucketed(spark.createDataFrame(rows, kind), PAIR).collect()
    assert [key_of(r["name"], PAIR) for r in found] == rows and len({r["name"] for r in found}) == 4
    assert all(0 <= r["bucket"] < 256 for r in found)


def test_connections_of_a_batch_are_built_once(spark, monkeypatch):
    read, alerts = [], arrivals.beacon_alerts
    monkeypatch.setattr(arrivals, "beacon_alerts", lambda rows, *rest: read.extend(rows.inputFiles()) or alerts(rows, *rest))
    folder = shared_folder(spark)
    rows = [("cap", i, 1e6 + i * 1000.0, "10.0.0.1", 4000 + i, "10.0.0.2", 443, 0x02, i, 60) for i in range(18)]
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(f"{folder}/in")
    arrivals.start_arrivals(spark, f"{folder}/in", f"{folder}/out", 0.5, checkpoint=f"{folder}/c", available_now=True).awaitTermination()
    assert read and all("/starts/batch_id=" in f for f in read) and arrivals.current_alerts(spark, f"{folder}/out").count() == 1
