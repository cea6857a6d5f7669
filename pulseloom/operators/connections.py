"""Packets to connections, without a row-by-row loop.

Orientation needs only three facts per endpoint pair (direction of the first packet, first SYN of
each direction), and the decision where a connection starts needs only running maxima.  Both work
on blocks, so one endpoint pair may hold any share of the packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.plans.hotgroups import DEFAULT, Limits, join_null_safe, spread
from pulseloom.schemas import IAT_PREFIX, IDLE_SECONDS
from pulseloom.session import materialise

PAIR = ["source_file", "lo_ip", "lo_port", "hi_ip", "hi_port"]
FLOW = [*PAIR, "key_forward"]
CONNECTION = [*FLOW, "conn_start"]

_SYN, _ACK, _FIN_OR_RST = 0x02, 0x10, 0x05


def with_pairs(packets: DataFrame) -> DataFrame:
    """Add the unordered endpoint pair, the direction within it and the flag columns."""
    a, b = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    forward = a <= b
    flags = F.col("flags")
    return packets.withColumns({
        "forward": forward,
        "lo_ip": F.when(forward, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "lo_port": F.when(forward, F.col("src_port")).otherwise(F.col("dst_port")),
        "hi_ip": F.when(forward, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "hi_port": F.when(forward, F.col("dst_port")).otherwise(F.col("src_port")),
        "syn": (flags.bitwiseAND(_SYN) != 0) & (flags.bitwiseAND(_ACK) == 0),
        "ends": flags.bitwiseAND(_FIN_OR_RST) != 0,
    })


def orient(packets: DataFrame) -> DataFrame:
    """Give every packet the direction of its connection key and the first SYN of that key.

    A packet keeps its own direction if it is a SYN, if the first packet of the pair had that
    direction, or if an earlier SYN had it; otherwise it belongs to the opposite key.
    """
    p = with_pairs(packets)
    facts = p.groupBy(*PAIR).agg(
        F.min_by("forward", "pkt_no").alias("_first_forward"),
        F.min(F.when(F.col("syn") & F.col("forward"), F.col("pkt_no"))).alias("_syn_forward"),
        F.min(F.when(F.col("syn") & ~F.col("forward"), F.col("pkt_no"))).alias("_syn_backward"),
    )
    # written first: a small table is then broadcast by its size, and a large one joins behind two shuffles, which Spark
    # splits where one pair holds many packets
    joined = join_null_safe(p, materialise(facts), PAIR, "inner")
    own_syn = F.when(F.col("forward"), F.col("_syn_forward")).otherwise(F.col("_syn_backward"))
    own = (
        F.col("syn") | (F.col("forward") == F.col("_first_forward"))
        | F.coalesce(F.col("pkt_no") > own_syn, F.lit(False))
    )
    key_forward = F.when(own, F.col("forward")).otherwise(~F.col("forward"))
    out = joined.withColumn("key_forward", key_forward)
    return out.withColumn(
        "key_syn_no", F.when(F.col("key_forward"), F.col("_syn_forward")).otherwise(F.col("_syn_backward"))
    ).drop("_first_forward", "_syn_forward", "_syn_backward")


def split_connections(
    packets: DataFrame, idle_seconds: float = IDLE_SECONDS, limits: Limits = DEFAULT
) -> DataFrame:
    """Add ``conn_start``: the packet number at which the packet's connection begins.

    With q the previous SYN of the key, a SYN starts a connection iff there is no q, an idle break
    lies in (q, p], a FIN or RST lies in [q, p), or the sequence numbers differ.  Any other packet
    starts one iff it is the first of its key or follows an idle break.
    """
    s = spread(orient(packets), FLOW, "pkt_no", tie=[], rows_back=1, limits=limits, probe=(with_pairs(packets), PAIR))
    w = s.window("pkt_no")
    gap = F.col("ts") - F.lag("ts").over(w)
    s = s.with_df(s.df.withColumns({
        "_first": F.lag("ts").over(w).isNull(),
        "_idle": F.coalesce(gap > F.lit(idle_seconds), F.lit(False)),
    })).without_halo()

    syn_at = F.when(F.col("syn"), F.struct("pkt_no", "seq"))
    idle_at = F.when(F.col("_idle"), F.col("pkt_no"))
    end_at = F.when(F.col("ends"), F.col("pkt_no"))
    s = s.with_carry({"_c_syn": syn_at, "_c_idle": idle_at, "_c_end": end_at})
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # later blocks hold larger packet numbers, so a value of the own block beats the carried one
    df = s.df.withColumns({
        "_syn": F.coalesce(F.max(syn_at).over(before), F.col("_c_syn")),
        "_idle_no": F.coalesce(F.max(idle_at).over(so_far), F.col("_c_idle")),
        "_end_no": F.coalesce(F.max(end_at).over(before), F.col("_c_end")),
    })
    q = F.col("_syn.pkt_no")
    new_syn = F.col("syn") & (
        q.isNull()
        | F.coalesce(F.col("_idle_no") > q, F.lit(False))
        | F.coalesce(F.col("_end_no") >= q, F.lit(False))
        | F.coalesce(F.col("_syn.seq") != F.col("seq"), F.lit(False))
    )
    df = df.withColumn("_starts", F.col("_first") | F.col("_idle") | new_syn)
    start_at = F.when(F.col("_starts"), F.col("pkt_no"))
    s = s.with_df(df).with_carry({"_c_start": start_at})
    df = s.df.withColumn("conn_start", F.coalesce(F.max(start_at).over(so_far), F.col("_c_start")))
    helpers = [c for c in df.columns if c in (
        "_first", "_idle", "_c_syn", "_c_idle", "_c_end", "_syn", "_idle_no", "_end_no", "_starts", "_c_start")]
    return s.with_df(df.drop(*helpers)).finish()


def connection_rows(split: DataFrame, limits: Limits = DEFAULT, packets: DataFrame | None = None) -> DataFrame:
    """One row per connection: counters, ratios and packet inter-arrival statistics.

    Gaps follow time order inside the connection while splitting followed file order.  ``packets``,
    the rows before splitting, make the check for hot connections cheap.
    """
    probe = (with_pairs(packets), PAIR) if packets is not None else None
    s = spread(split, CONNECTION, "ts", tie=["pkt_no"], rows_back=1, limits=limits, probe=probe)
    w = s.window("ts", "pkt_no")
    df = s.df.withColumns({"_gap": F.col("ts") - F.lag("ts").over(w), "_at": s.index(w)})
    originator = F.col("forward") == F.col("key_forward")
    gap = F.col("_gap")
    zero = F.lit(0.0)
    first, last = F.min("ts"), F.max("ts")

    def total(value, condition):
        return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")

    rows = s.with_df(df).finish().groupBy(*CONNECTION).agg(
        first.alias("start_time"),
        (last - first).alias("duration"),
        total(F.lit(1), originator).alias("orig_packets"),
        total(F.lit(1), ~originator).alias("resp_packets"),
        total(F.col("length"), originator).alias("orig_bytes"),
        total(F.col("length"), ~originator).alias("resp_bytes"),
        F.coalesce(F.min(gap), zero).alias("packet_iat_min"),
        F.coalesce(F.max(gap), zero).alias("packet_iat_max"),
        F.coalesce(F.avg(gap), zero).alias("packet_iat_mean"),
        F.coalesce(F.stddev_pop(gap), zero).alias("packet_iat_stddev"),
        *[
            F.coalesce(F.max(F.when(F.col("_at") == i + 1, gap)), zero).alias(f"packet_iat_{i}")
            for i in range(IAT_PREFIX)
        ],
        F.min("key_syn_no").alias("_key_syn_no"),
    )
    packets, octets = F.col("orig_packets") + F.col("resp_packets"), F.col("orig_bytes") + F.col("resp_bytes")
    forward = F.col("key_forward")
    return rows.select(
        "source_file",
        "start_time",
        F.when(forward, F.col("lo_ip")).otherwise(F.col("hi_ip")).alias("src_ip"),
        F.when(forward, F.col("lo_port")).otherwise(F.col("hi_port")).alias("src_port"),
        F.when(forward, F.col("hi_ip")).otherwise(F.col("lo_ip")).alias("dst_ip"),
        F.when(forward, F.col("hi_port")).otherwise(F.col("lo_port")).alias("dst_port"),
        F.lit("tcp").alias("ip_protocol"),
        "conn_start",
        "duration", "orig_packets", "resp_packets", "orig_bytes", "resp_bytes",
        F.when(packets > 0, F.col("orig_packets") / packets).otherwise(zero).alias("packet_ratio"),
        F.when(octets > 0, F.col("orig_bytes") / octets).otherwise(zero).alias("byte_ratio"),
        "packet_iat_min", "packet_iat_max", "packet_iat_mean", "packet_iat_stddev",
        *[f"packet_iat_{i}" for i in range(IAT_PREFIX)],
        F.when(F.col("_key_syn_no") <= F.col("conn_start"), 1.0).otherwise(F.lit(0.0)).alias("direction_confidence"),
    )


def connections_from_packets(
    packets: DataFrame, idle_seconds: float = IDLE_SECONDS, limits: Limits = DEFAULT
) -> DataFrame:
    return connection_rows(split_connections(packets, idle_seconds, limits), limits, packets)


def feature_order(rows: DataFrame) -> DataFrame:
    """The order in which feature rows are written."""
    return rows.orderBy("source_file", "src_ip", "dst_ip", "dst_port", "start_time", "src_port")
