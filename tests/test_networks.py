"""The longest network of an address against Python's address parser."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from test_endpoints import texts

from pulseloom.functions import endpoints
from pulseloom.operators import networks


def parsed(text):
    try:
        found = ipaddress.ip_address(text)
    except ValueError:
        return None
    return int(found) + ((0xFFFF << 32) if found.version == 4 else 0)


def plain(table, address):
    """Longest network that holds the address, by its 128 bits."""
    value, best = parsed(address), None
    for name, owner in table:
        if name is None or value is None:
            continue
        host, _, size = name.strip().partition("/")
        at = parsed(host)
        if at is None or size and not size.isdigit():
            continue
        wide = 32 if ":" not in host else 128
        if "/" in name and not size:
            continue
        bits = int(size) + 128 - wide if size else 128
        if bits > 128:
            continue
        if at >> (128 - bits) == value >> (128 - bits):
            rank = (-bits, name, owner)
            best = min(best, rank) if best else rank
    return (best[1], best[2], -best[0]) if best else (None, None, None)


def test_address_keys(spark):
    given = [t for t in texts() if "%" not in t]
    rows = spark.createDataFrame([(t,) for t in given] + [(None,)], "a string").withColumn("k", endpoints.address_key("a")).collect()
    for r in rows:
        want = parsed(r.a)
        if want is None:
            assert r.k is None, r.a
        else:
            assert ((r.k.high % 2 ** 64) << 64) + r.k.low % 2 ** 64 == want, r.a


def test_random_nested_networks(spark):
    rnd = random.Random(3)
    table, asked = [("0.0.0.0/0", 1), ("::/0", 2), (None, 3), ("no net", 4), ("1.2.3.4/33", 5), ("1.2.3.4/", 6), ("1::/129", 7), ("9.9.9.9", 8)], []
    for k in range(150):
        if rnd.random() < 0.5:
            base = ipaddress.ip_address(rnd.choice([0x0A000000, 0xC0A80000, 0xFFFF0000]) + rnd.getrandbits(rnd.choice([4, 12, 20])) % 65536)
            bits = rnd.randint(0, 32)
        else:
            base = ipaddress.ip_address((rnd.choice([0x2001 << 112, 0xFE80 << 112, 0xFFFF << 112]) + rnd.getrandbits(rnd.choice([3, 64, 80]))))
            bits = rnd.randint(0, 128)
        table.append((f"{base}/{bits}", 100 + k % 90))
        for _ in range(3):
            asked.append(str(ipaddress.ip_address(int(base) ^ rnd.getrandbits(rnd.choice([1, 3, 9])))))
    asked += ["::ffff:10.0.0.7", "no address", "", None, "9.9.9.9", "255.255.255.255", "::", asked[0], asked[0]]
    net = spark.createDataFrame(table, "network string, owner int").repartition(3)
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id int, address string").repartition(3)
    got = {r.id: (r.network, r.owner, r.prefix_bits) for r in networks.with_network(df, "address", net).collect()}
    for i, a in enumerate(asked):
        name, owner, bits = plain(table, a)
        assert got[i][1:] == (owner, bits) and (got[i][0] == name), (a, got[i], name)


def test_private_blocks_equal_the_expressions(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "address string").withColumn("want", endpoints.is_private("address"))
    out = networks.with_network(df, "address", networks.private_networks(spark))
    assert out.where(F.coalesce("private", F.lit(False)) != F.col("want")).select("address").collect() == []


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([("1.2.3.4",)], "address string")
    none = spark.createDataFrame([], "network string, owner int")
    assert [tuple(r) for r in networks.with_network(df, "address", none).collect()] == [("1.2.3.4", None, None, None)]
    assert networks.with_network(df.limit(0), "address", none).count() == 0
    with pytest.raises(ValueError):
        networks.with_network(df.withColumn("Owner", F.lit(1)), "address", none)
