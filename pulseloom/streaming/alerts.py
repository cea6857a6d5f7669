"""Beacon alerts on a stream of packets, at a cost per batch that doesn't grow with what came before.

Two stateful steps follow each other.  The first keeps two small records per endpoint pair and gives out every connection when it
starts.  The second keeps, per communication group, the last gaps and rows that the next window needs, the best window so
far and a count; starts wait in its state until the watermark has passed their second, so they are taken in time order
however the input is cut into micro-batches.  A group's row is written again when new windows are complete;
:func:`latest` takes the one with the most windows.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseloom.operators import scoring
from pulseloom.operators.connections import PAIR
from pulseloom.schemas import GAP_HISTORY, GROUP_KEYS, IDLE_SECONDS, SEQUENCE_LENGTH
from pulseloom.streaming.connections import ConnectionBuilder, bucketed, key_of, pair_packets

_STARTS = (
    "source_file string, src_ip string, src_port int, dst_ip string, dst_port int, ip_protocol string, conn_start long, "
    "start_time double, event_time timestamp"
)
_BEST = (
    "probability double, window_count long, window_index long, first_flow_gap double, first_gap_cv double, "
    "window_start_time double, window_end_time double"
)
_BEST_NAMES = [f.split()[0] for f in _BEST.split(", ")]
_REST = [c for c in _BEST_NAMES if c not in ("window_count", "window_index")]
_RUN = f"<qqq{len(_REST)}d"  # number of rows, window_count, window_index, _REST; then the last rows
_KEY_TYPES = "source_file string, src_ip string, dst_ip string, dst_port int, ip_protocol string"


class ConnectionStarts(ConnectionBuilder):
    """Gives out a connection with its first packet, by the rules of :class:`ConnectionBuilder`."""

    _lists = False  # nothing is given out when a connection ends

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, started = self._advance(rows)
        if not started:
            return
        out = []
        for name, side, no, start in started:
            source, lo_ip, lo_port, hi_ip, hi_port = key_of(name, PAIR)
            out.append((source, *((lo_ip, lo_port, hi_ip, hi_port) if side else (hi_ip, hi_port, lo_ip, lo_port)), "tcp", no, start))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in _STARTS.split(", ")][:-1])
        # rows must not be older than the watermark; the start itself is a column of its own
        floor = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        micros = np.maximum(np.ceil(frame["start_time"].to_numpy(np.float64) * 1e6).astype(np.int64), floor)
        yield frame.assign(event_time=pd.to_datetime(micros, unit="us", utc=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from ()


def _passed(start: float) -> int:
    """The watermark that has passed the second of a start, in ms."""
    return (int(start // 1) + 1) * 1000


def rolled(before: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Variation of every new gap and the up to four before it; ``before`` holds the last gaps of the group."""
    every = np.concatenate([before, gaps])
    out = np.empty(len(gaps))
    wide = np.lib.stride_tricks.sliding_window_view(every, GAP_HISTORY) if len(every) >= GAP_HISTORY else np.empty((0, GAP_HISTORY))
    for i in range(min(len(gaps), max(0, GAP_HISTORY - 1 - len(before)))):  # the first rows of a group
        some = every[:len(before) + i + 1]
        out[i] = some.std() / some.mean() if some.mean() > 1e-9 else 0.0
    first = len(gaps) - min(len(gaps), len(wide))
    wide = wide[len(wide) - (len(gaps) - first):]
    mean, std = wide.mean(axis=1), wide.std(axis=1)
    out[first:] = np.where(mean > 1e-9, std / np.where(mean > 1e-9, mean, 1.0), 0.0)
    return out


class GroupScores(StatefulProcessor):
    """The best window of a group so far.

    State of a bucket: starts that the watermark hasn't passed, and the second of the timer that is set.  State of a group: the number
    of rows and the last nine of them (start, gap, variation), and the best window.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getValueState("waiting", "timer long, starts string")  # {group: [[start, connection]]}
        self._runs = handle.getMapState("runs", "group string", "run binary")

    def _load(self, group: str) -> dict:
        found = self._runs.getValue((group,))
        if found is None:
            return {"n": 0, "starts": [], "gaps": [], "variations": [], **dict.fromkeys(_BEST_NAMES, 0.0), "probability": -1.0,
                    "window_count": 0, "window_index": 0}
        held = bytes(found[0])
        n, count, index, *rest = struct.unpack_from(_RUN, held)
        starts, gaps, variations = np.frombuffer(held, np.float64, offset=struct.calcsize(_RUN)).reshape(3, -1)
        return {"n": n, "starts": starts, "gaps": gaps, "variations": variations, "window_count": count, "window_index": index,
                **dict(zip(_REST, rest))}

    def _store(self, group: str, run: dict) -> None:
        rows = np.concatenate([run["starts"], run["gaps"], run["variations"]], dtype=np.float64)
        held = struct.pack(_RUN, run["n"], run["window_count"], run["window_index"], *(run[c] for c in _REST)) + rows.tobytes()
        self._runs.updateValue((group,), (held,))

    def _advance(self, new: dict[str, list], watermark: int) -> Iterator[pd.DataFrame]:
        timer, text = self._waiting.get() if self._waiting.exists() else (-1, "{}")
        waiting = json.loads(text)
        for group, rows in new.items():
            waiting.setdefault(group, []).extend(rows)
        left, better = {}, []
        for group, rows in waiting.items():
            ready = sorted((s, c) for s, c in rows if _passed(s) <= watermark)
            if ready:
                run = self._load(group)
                if self._take(run, np.array([s for s, _ in ready])):
                    better.append((*key_of(group, GROUP_KEYS), *(run[c] for c in _BEST_NAMES)))
                self._store(group, run)
            if len(ready) < len(rows):
                left[group] = [x for x in rows if _passed(x[0]) > watermark]
        if left:
            due = _passed(min(x[0] for rows in left.values() for x in rows))
            if timer <= watermark or due < timer:
                self._handle.registerTimer(due)
                timer = due
            self._waiting.update((timer, json.dumps(left)))
        elif waiting:
            self._waiting.clear()
        if better:
            yield pd.DataFrame(better, columns=[*GROUP_KEYS, *_BEST_NAMES])

    def _take(self, run: dict, starts: np.ndarray) -> bool:
        """Add rows in time order; is a window complete?"""
        back, n = SEQUENCE_LENGTH - 1, int(run["n"])
        old_starts, old_gaps, old_variations = (np.array(run[c], dtype=np.float64) for c in ("starts", "gaps", "variations"))
        previous = np.concatenate([old_starts[-1:] if n else starts[:1], starts[:-1]])
        gaps = np.maximum(starts - previous, 0.0)
        variations = rolled(old_gaps[1 - GAP_HISTORY:] if n else old_gaps, gaps)
        every_start, every_gap = np.concatenate([old_starts, starts]), np.concatenate([old_gaps, gaps])
        every_variation = np.concatenate([old_variations, variations])
        complete = len(every_start) >= SEQUENCE_LENGTH
        if complete:
            means = np.lib.stride_tricks.sliding_window_view(every_variation.astype(np.float32).astype(np.float64), SEQUENCE_LENGTH).mean(axis=1)
            scores = 1.0 / (1.0 + means)
            at = int(scores.argmax())  # the earliest of equals
            run["window_count"] += len(scores)
            if scores[at] > run["probability"]:
                run.update(
                    probability=scores[at], window_index=n - len(old_starts) + at, first_flow_gap=every_gap[at],
                    first_gap_cv=every_variation[at], window_start_time=every_start[at], window_end_time=every_start[at + back])
        run.update(n=n + len(starts), starts=every_start[-back:], gaps=every_gap[-back:], variations=every_variation[-back:])
        return complete

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list] = {}
        for piece in rows:
            for name, start, no in zip(piece["name"], piece["start_time"].astype(float).tolist(), piece["conn_start"].astype(int).tolist()):
                new.setdefault(name, []).append((start, no))
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def best_window_stream(packets: DataFrame, lateness: str = "10 minutes", idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """The best window of every group, again whenever the group has new windows.

    Packets later than ``lateness`` are dropped.  Needs the RocksDB state store provider.
    """
    starts = pair_packets(packets, lateness).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=ConnectionStarts(idle_seconds), outputStructType=_STARTS, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time")
    named = bucketed(starts, GROUP_KEYS).select("bucket", "name", "event_time", "start_time", "conn_start")
    return named.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=GroupScores(), outputStructType=f"{_KEY_TYPES}, {_BEST}", outputMode="Append", timeMode="EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """Of every group the row with the most windows."""
    rest = [c for c in rows.columns if c not in GROUP_KEYS]
    return rows.groupBy(*GROUP_KEYS).agg(F.max_by(F.struct(*rest), "window_count").alias("_b")).select(*GROUP_KEYS, "_b.*")


def current_alerts(rows: DataFrame, threshold) -> DataFrame:
    """The alerts that hold now, from the rows that the stream has written."""
    return scoring.by_confidence(scoring.alerts(latest(rows), threshold))
