"""Addresses: the JVM forms against Python's address parser."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import endpoints


def texts():
    rng = random.Random(11)
    out = ["192.168.56.5", "::ffff:192.168.56.5", "::", "::1", "1::", "", "-", "unknown", ":::", "1:2", "::1::2",
           "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0:0:0:0:0:0:0:0",
           "::FFFF:C0A8:3805", "64:ff9b::1.2.3.4", "::ffff:999.1.1.1", "fe80::1%eth0", "12345::", "g::1", ":1:2:3:4:5:6:7:8",
           "1:2:3:4:5:6:7:", "2001:db8:0:0:1:0:0:1", "1:0:0:2:0:0:0:3", " 10.0.0.1 ", "10.0.0.256", "01.2.3.4", "::1.2.3.4",
           "1:0:2:3:4:5:6:7", "192.0.0.9", "192.0.0.8", "198.51.100.7", "203.0.113.9", "100.64.0.1", "8.8.8.8",
           "2001:1::1", "2001:1::3", "2001:4:112::1", "2001:20::1", "2001:30::1", "2001::1", 
           "100::1", "100:0:0:1::1", "64:ff9b:1::1", "fc00::1", "fe80::1", "2002::1", "2001:db8::1", "2606:4700::1111",
           "::ffff:10.0.0.1", "::ffff:8.8.8.8", "255.255.255.255", "0.0.0.0", "172.31.9.9", "172.32.0.1"]
    for _ in range(400):
        groups = [rng.choice(["0", "0", "0000", f"{rng.randrange(65536):x}", f"{rng.randrange(256):04X}"]) for _ in range(8)]
        text = ":".join(groups)
        if rng.random() < 0.6:
            i = rng.randrange(8)
            j = rng.randrange(i, 8)
            text = ":".join(groups[:i]) + "::" + ":".join(groups[j + 1:])
        out.append(text)
    return out


def python_canonical(text):
    raw = text.strip()
    try:
        address = ipaddress.ip_address(raw)
    except ValueError:
        return raw
    return str(getattr(address, "ipv4_mapped", None) or address)


def python_private(text):
    try:
        return ipaddress.ip_address(text).is_private
    except ValueError:
        return False


def test_canonical_and_private(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    rows = df.select("t", endpoints.canonical("t").alias("c"), endpoints.is_private("t").alias("p"),
                     endpoints.canonical_ipv6(F.trim("t")).alias("u")).collect()
    wrong = [(r.t, r.c, python_canonical(r.t)) for r in rows if r.c != python_canonical(r.t)]
    assert not wrong
    assert [r.u for r in rows] == [python_canonical(r.t) for r in rows]
    wrong = [(r.t, r.p) for r in rows if r.p != python_private(r.t)]
    assert not wrong


@pytest.mark.parametrize("name, collapsed, plain", [
    ("Beacon Score", "beacon_score", "beacon_score"), ("Source  IP", "source_ip", "source__ip"),
    ("C2 (over) DNS", "c2_over_dns", "c2__over__dns"), ("a.b/c:d-e", "a_b_c_d_e", "a_b_c_d_e")])
def test_column_names(name, collapsed, plain):
    assert endpoints.collapse_name(name) == collapsed
    assert endpoints.plain_name(name) == plain
