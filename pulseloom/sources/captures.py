"""Capture files to packet rows: one capture per task, many captures in parallel."""

from __future__ import annotations

import ipaddress
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.schemas import PACKETS

ROWS_PER_BATCH = 20_000

# Folder name of a labelled capture -> expected verdict; file suffixes.
EXPECTED = {"cs": True, "benign": False}
SUFFIXES = [".pcap", ".pcapng", ".cap"]

_PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6),
         b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}


def _frames(data: bytes):
    """(time, link type, wire length, bytes) of every record of a pcap or pcapng file."""
    if data[:4] in _PCAP:
        end, unit = _PCAP[data[:4]]
        link = struct.unpack_from(end + "I", data, 20)[0] & 0xFFFF
        at = 24
        while at + 16 <= len(data):
            seconds, part, kept, wire = struct.unpack_from(end + "IIII", data, at)
            yield seconds + part * unit, link, wire, data[at + 16:at + 16 + kept]
            at += 16 + kept
        return
    end, at, links = "<", 0, []
    while at + 12 <= len(data):
        kind = struct.unpack_from(end + "I", data, at)[0]
        if kind == 0x0A0D0D0A:
            end = "<" if data[at + 8:at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            links = []
        size = struct.unpack_from(end + "I", data, at + 4)[0]
        if size < 12:
            return
        if kind == 1:
            links.append((struct.unpack_from(end + "H", data, at + 8)[0], _resolution(data[at + 16:at + size - 4], end)))
        elif kind == 6 and links:
            interface, high, low, kept, wire = struct.unpack_from(end + "IIIII", data, at + 8)
            link, unit = links[interface]
            yield ((high << 32) | low) * unit, link, wire, data[at + 28:at + 28 + kept]
        at += size


def _resolution(options: bytes, end: str) -> float:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(end + "HH", options, at)
        if code == 9 and size:
            v = options[at + 4]
            return 2.0 ** -(v & 0x7F) if v & 0x80 else 10.0 ** -v
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1e-6


def _network(link: int, frame: bytes) -> bytes | None:
    """The IP packet inside a frame, or None."""
    if link in (12, 14, 101):
        return frame
    if link == 0:
        return frame[4:]
    if link == 113:
        return frame[16:]
    if link != 1 or len(frame) < 14:
        return None
    kind, at = struct.unpack_from("!H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        kind, at = struct.unpack_from("!H", frame, at + 2)[0], at + 4
    return frame[at:] if kind in (0x0800, 0x86DD) else None


def _tcp(packet: bytes):
    """(src, sport, dst, dport, flags, seq) of a TCP segment, or None."""
    if not packet:
        return None
    if packet[0] >> 4 == 4 and len(packet) >= 20:
        if packet[9] != 6 or struct.unpack_from("!H", packet, 6)[0] & 0x1FFF:
            return None
        src, dst, at = packet[12:16], packet[16:20], (packet[0] & 15) * 4
    elif packet[0] >> 4 == 6 and len(packet) >= 40:
        kind, src, dst, at = packet[6], packet[8:24], packet[24:40], 40
        while kind in (0, 43, 60) and len(packet) >= at + 8:
            kind, at = packet[at], at + (packet[at + 1] + 1) * 8
        if kind != 6:
            return None
    else:
        return None
    if len(packet) < at + 14:
        return None
    sport, dport, seq = struct.unpack_from("!HHI", packet, at)
    return str(ipaddress.ip_address(src)), sport, str(ipaddress.ip_address(dst)), dport, packet[at + 13], seq


def _decode(batches):
    rows = []
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            name = path.rsplit("/", 1)[-1]
            for no, (ts, link, wire, frame) in enumerate(_frames(data)):
                found = _tcp(_network(link, frame))
                if found is None:
                    continue
                src, sport, dst, dport, flags, seq = found
                rows.append((name, no, ts, src, sport, dst, dport, flags, seq, wire))
                if len(rows) >= ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=PACKETS.names)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=PACKETS.names)


def decode_captures(files: DataFrame) -> DataFrame:
    """TCP packets over IPv4 and IPv6 of ``path, content`` rows, in file order; ``length`` is the
    whole frame.  Records of a capture chain from front to back, so one capture is one task's work."""
    return files.select("path", "content").mapInPandas(_decode, PACKETS)


def read_captures(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    return decode_captures(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))


def labelled_captures(files: DataFrame, limit: int = 0) -> DataFrame:
    """Captures below ``cs`` and ``benign`` folders with their expected verdict, in report order."""
    parts = F.split("path", "/")
    name, label = F.element_at(parts, -1), F.element_at(parts, -2)
    known = files.select("path", name.alias("file_name"), label.alias("label")).where(F.col("label").isin(*EXPECTED))
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    ordered = known.where(suffix.isin(*SUFFIXES)).withColumn(
        "expected_malicious", F.col("label") == "cs").orderBy("label", "file_name", "path")
    return ordered.limit(limit) if limit > 0 else ordered


def discover_captures(spark: SparkSession, folder: str, pattern: str = "*", limit: int = 0) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(folder).select("path")
    return labelled_captures(files, limit)
