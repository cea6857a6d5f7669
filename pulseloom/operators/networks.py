"""The longest network of a table that holds an address, IPv4 and IPv6 alike.

An address is 128 bits in two longs; IPv4 stands in its mapped place.  A network of n bits holds an address if their first n bits
are equal, so a table of networks is looked up by one equality join: each distinct address asks once for every prefix length
that the table has (at most 129), and the longest answer counts.  Nothing is compared by range, and networks and addresses
are both shuffled by the key, so neither side has to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import endpoints
from pulseloom.session import materialise

# IPv6 blocks that are not globally reachable, and the reachable ones inside them.
PRIVATE_V6 = ["::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
REACHABLE_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def _mask(bits: Column) -> Column:
    """The highest ``bits`` of a long, for any number of bits."""
    return F.when(bits <= 0, F.lit(0)).when(bits >= 64, F.lit(-1)).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - F.greatest(bits, F.lit(1))).cast("int"))).cast("long")


def parse(networks: DataFrame, network: str = "network") -> DataFrame:
    """The rows with ``_bits``, ``_high`` and ``_low`` of the networks (``address/bits``, or one address); other bits are cleared.

    Rows whose text is no network (null too) go.
    """
    text = F.trim(F.col(network))
    length = F.regexp_extract(text, r"^[^/]+/([0-9]{1,3})$", 1)
    split = networks.withColumn("_text", F.substring_index(text, "/", 1)).withColumn("_key", endpoints.address_key("_text"))
    own = F.when(F.contains("_text", F.lit(":")), 0).otherwise(96)
    bits = F.when(~F.contains(text, F.lit("/")), 128).when(length != "", length.try_cast("int") + own)
    return (
        split.withColumn("_bits", bits).where(F.col("_key").isNotNull() & F.col("_bits").between(own, 128))
        .withColumn("_high", F.col("_key.high").bitwiseAND(_mask(F.col("_bits"))))
        .withColumn("_low", F.col("_key.low").bitwiseAND(_mask(F.col("_bits") - 64))).drop("_text", "_key"))


def with_network(df: DataFrame, column: str, networks: DataFrame, network: str = "network") -> DataFrame:
    """``df`` with all columns of ``networks`` and ``prefix_bits`` (of 128) for the longest network that holds the address ``column``.

    They are null where no network does, and for text that is no address.  A network that the table has several times counts once, with
    its least row.  Columns of both tables may not have the same name.
    """
    same = {c.lower() for c in df.columns} & {*(c.lower() for c in networks.columns), "prefix_bits"}
    if same:
        raise ValueError(f"both tables have {sorted(same)}")
    values = [network, *[c for c in networks.columns if c != network]]
    known = materialise(
        parse(networks, network).groupBy("_bits", "_high", "_low").agg(F.min(F.struct(*values)).alias("_row")))
    lengths = [r[0] for r in known.select("_bits").distinct().orderBy("_bits").collect()]  # at most 129
    asked = df.select(F.col(column).alias("_address")).distinct().withColumn("_key", endpoints.address_key("_address")).where(
        F.col("_key").isNotNull())
    probes = [F.struct(
        F.lit(n).alias("_bits"), F.col("_key.high").bitwiseAND(_mask(F.lit(n))).alias("_high"),
        F.col("_key.low").bitwiseAND(_mask(F.lit(n - 64))).alias("_low")) for n in lengths or [0]]
    found = asked.select("_address", F.inline(F.array(*probes))).join(known, ["_bits", "_high", "_low"]).groupBy("_address").agg(
        F.max_by("_row", "_bits").alias("_row"), F.max("_bits").alias("prefix_bits"))
    return df.join(found, F.col(column) == F.col("_address"), "left").select(
        *[df[c] for c in df.columns], *[F.col(f"_row.{v}").alias(v) for v in values], "prefix_bits")


def private_networks(spark: SparkSession) -> DataFrame:
    """``network`` and ``private``: the blocks that are not globally reachable, and the reachable ones inside them."""
    blocks = [(True, [*endpoints.PRIVATE_V4, *PRIVATE_V6]), (False, [*endpoints.REACHABLE_V4, *REACHABLE_V6])]
    return spark.createDataFrame([(n, private) for private, names in blocks for n in names], "network string, private boolean")
