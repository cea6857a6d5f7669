"""Connections on a stream of packets."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseloom.operators.connections import PAIR, with_pairs
from pulseloom.schemas import IDLE_SECONDS

_FIELDS = [
    "start_no", "start_time", "last_time", "seen_time", "has_syn", "seq", "confidence", "ended", "orig_packets", "resp_packets",
    "orig_bytes", "resp_bytes", "open"]
_SIDE = "<?qddd?qd?qqqq?"  # the direction and _FIELDS
_SLOT = "<q"
OUTPUT = (
    "source_file string, lo_ip string, lo_port int, hi_ip string, hi_port int, key_forward boolean, "
    "conn_start long, start_time double, duration double, orig_packets long, resp_packets long, orig_bytes long, "
    "resp_bytes long, direction_confidence double"
)
_COLUMNS = [f.split()[0] for f in OUTPUT.split(", ")]

#: A call of a processor, with its frames and state messages, costs milliseconds.  So it takes the keys of one of so many
#: buckets, and the state of each key lies by its name in a map.  The number is part of the state: a checkpoint keeps it.
BUCKETS = 256


def bucketed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Name the key of a row (``name``, also of nulls) and deal the keys to buckets."""
    named = rows.withColumn("name", F.to_json(F.struct(*keys)))
    return named.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int"))


def key_of(name: str, keys: list[str]) -> tuple:
    found = json.loads(name)  # a null is left out
    return tuple(found.get(k) for k in keys)


def sessions(packets: DataFrame, lateness: str = "10 minutes", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Connections by silence alone: a session window closes when more than the idle limit passes."""
    timed = with_pairs(packets).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark(
        "event_time", lateness)
    agg = timed.groupBy(*PAIR, F.session_window("event_time", f"{int(idle_seconds)} seconds")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("packets"),
        F.sum("length").alias("octets"))
    return agg.drop("session_window")


def _in_order(rows: Iterator[pd.DataFrame], place: Callable[[pd.DataFrame], list[int]] | None = None) -> Iterator[tuple]:
    """Packets in time order as ``ts, pkt_no, forward, syn, ends, seq, length, place``.

    Of each frame only these numbers are kept, so a batch of one bucket takes 56 bytes a packet until it is in order.
    """
    held = [
        np.rec.fromarrays([
            f["ts"].to_numpy(np.float64), f["pkt_no"].to_numpy(np.int64), f["forward"].to_numpy(bool), f["syn"].to_numpy(bool),
            f["ends"].to_numpy(bool), f["seq"].fillna(0).to_numpy(np.int64), f["length"].fillna(0).to_numpy(np.int64),
            np.array(place(f) if place else [0] * len(f), np.int64)])
        for f in rows]
    packets = np.concatenate(held)
    del held
    for at in np.array_split(np.lexsort((packets["f1"], packets["f0"])), len(packets) // 65536 + 1):
        yield from packets[at].tolist()


class ConnectionBuilder(StatefulProcessor):
    """Two open connections at most per endpoint pair, one per direction.

    Packets of a batch are taken in time order; a connection is given out when a newer one
    replaces it or when the watermark passes its idle limit.  What decides the direction and the
    confidence of later packets (who sent first, which side sent a SYN) stays in the state when the
    connection is gone, so a stream in any number of batches gives the rows of the batch plan.  The
    state holds two small records per endpoint pair of a capture, in one value.

    Pairs with an open connection are listed by the time when the first of their connections may end, a quarter of the idle limit
    together.  A pair stays in its list while its connections go on; it is looked at again when the list is due.
    """

    _lists = True

    def __init__(self, idle_seconds: float):
        self._idle = idle_seconds
        self._width = max(1, int(idle_seconds * 250))  # of a list, in ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "pair string", "sides binary")
        if self._lists:
            self._due = handle.getMapState("due", "slot long", "first long, pairs array<string>")

    def _load(self, pair: str) -> tuple[int, dict]:
        """The list that a pair is in (-1: none) and its connections by side."""
        found = self._open.getValue((pair,))
        if found is None:
            return -1, {}
        held = bytes(found[0])
        sides = {side: dict(zip(_FIELDS, c)) for side, *c in struct.iter_unpack(_SIDE, held[struct.calcsize(_SLOT):])}
        return struct.unpack_from(_SLOT, held)[0], sides

    def _store(self, pair: str, slot: int, sides: dict) -> None:
        held = [struct.pack(_SIDE, side, *(c[f] for f in _FIELDS)) for side, c in sides.items()]
        self._open.updateValue((pair,), (struct.pack(_SLOT, slot) + b"".join(held),))

    def _row(self, key, forward: bool, c: dict) -> tuple:
        return (*key, forward, c["start_no"], c["start_time"], c["last_time"] - c["start_time"], c["orig_packets"],
                c["resp_packets"], c["orig_bytes"], c["resp_bytes"], c["confidence"])

    def _advance(self, rows: Iterator[pd.DataFrame]) -> tuple[list[tuple], list[tuple]]:
        """Take the packets of a batch: connections that ended, and side, number and time of those that started, with their pair."""
        places: dict[str, int] = {}
        names, states, ended, started = [], [], [], []

        def place(frame: pd.DataFrame) -> list[int]:
            return [places.setdefault(x, len(places)) for x in frame["name"]]

        for ts, no, forward, syn, ends, seq, length, at in _in_order(rows, place):
            if not states:  # all packets are there now
                names = list(places)
                states = [None] * len(names)
            if states[at] is None:
                states[at] = self._load(names[at])
            state = states[at][1]
            side = forward if syn or forward in state or (not forward) not in state else not forward
            c = state.get(side)
            fresh = c is None or not c["open"] or ts - c["seen_time"] > self._idle or (
                syn and (c["ended"] or not c["has_syn"] or c["seq"] != seq))
            if fresh:
                if c is not None and c["open"]:
                    ended.append((names[at], side, c))
                c = state[side] = dict(
                    start_no=no, start_time=ts, last_time=ts, seen_time=ts, has_syn=syn,
                    seq=seq if syn else 0, confidence=1.0 if syn else (c["confidence"] if c else 0.0),
                    ended=False, orig_packets=0, resp_packets=0, orig_bytes=0, resp_bytes=0, open=True)
                started.append((names[at], side, no, ts))
            origin = "orig" if forward == side else "resp"
            c[f"{origin}_packets"] += 1
            c[f"{origin}_bytes"] += length
            c["start_time"], c["last_time"] = min(c["start_time"], ts), max(c["last_time"], ts)
            c["seen_time"] = ts
            c["ended"] = c["ended"] or ends
        self._keep(zip(names, states))
        return ended, started

    def _keep(self, pairs) -> None:
        """Store pairs, and list those with an open connection that are in no list or in one that is due too late."""
        lists: dict[int, list] = {}
        for name, (slot, sides) in pairs:
            due = min((self._ends(c) for c in sides.values() if c["open"]), default=None) if self._lists else None
            if due is not None and (slot < 0 or due // self._width < slot):
                slot = due // self._width
                lists.setdefault(slot, []).append((due, name))
            self._store(name, slot, sides)
        for slot, new in lists.items():
            first, held = self._due.getValue((slot,)) or (None, [])
            earliest = min(new)[0]
            if first is None or earliest < first:
                self._handle.registerTimer(earliest)
                first = earliest
            self._due.updateValue((slot,), (first, [*held, *(name for _, name in new)]))

    def _ends(self, c: dict) -> int:
        """The watermark that ends a connection, in ms."""
        return int((c["last_time"] + self._idle) * 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, _ = self._advance(rows)
        if ended:
            yield pd.DataFrame([self._row(key_of(name, PAIR), side, c) for name, side, c in ended], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, slot = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() // self._width
        found = self._due.getValue((slot,))
        if found is None or found[0] > watermark:
            return  # an earlier timer of the same list was there
        self._due.removeKey((slot,))
        done, seen = [], {}
        for name in dict.fromkeys(found[1]):
            listed, sides = self._load(name)
            if listed != slot:
                continue
            for side, c in sides.items():
                if c["open"] and self._ends(c) <= watermark:
                    done.append(self._row(key_of(name, PAIR), side, c))
                    sides[side] = c | {"open": False}
            seen[name] = (-1, sides)
        self._keep(seen.items())
        if done:
            yield pd.DataFrame(done, columns=_COLUMNS)

    def close(self) -> None:
        pass


def pair_packets(packets: DataFrame, lateness: str) -> DataFrame:
    """What a :class:`ConnectionBuilder` takes of packets."""
    timed = with_pairs(packets).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)
    return bucketed(timed, PAIR).select(
        "bucket", "name", "event_time", "ts", "pkt_no", "forward", "syn", "ends", "seq", "length")


def connection_stream(packets: DataFrame, lateness: str = "10 minutes", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Connections with the SYN, FIN and idle rules on event time.

    Needs the RocksDB state store provider.
    """
    return pair_packets(packets, lateness).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ConnectionBuilder(idle_seconds), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime")
