"""Merging the alerts of two detectors on aligned connection keys.

Incomplete keys are matched through counts per lookup key instead of pairs, so a busy endpoint
never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import endpoints, rules
from pulseloom.operators.highrisk import EVIDENCE_KEYS, last_wins
from pulseloom.schemas import ALERT_KEYS

_RULE_VALUES = ["beacon_score", "long_conn_value", "c2_over_dns_value", "threat_category", "connection_count",
                "total_bytes"]


def rule_alerts(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rule detector rows, one per key: the last in input order; keys are text."""
    blank = F.lit("")
    keyed = rows.select(
        order,
        F.coalesce("src_ip", blank).alias("src_ip"),
        F.coalesce("dst_ip", blank).alias("dst_ip"),
        F.coalesce(F.col("dst_port").cast("string"), blank).alias("dst_port"),
        F.lower(F.coalesce("protocol", blank)).alias("protocol"),
        *_RULE_VALUES,
    )
    firsts = F.min(order).alias("first_ord")
    picked = keyed.groupBy(*ALERT_KEYS).agg(firsts, F.max_by(F.struct(*_RULE_VALUES), order).alias("_row"))
    return picked.select(*ALERT_KEYS, "first_ord", "_row.*")


def sequence_alerts(alerts: DataFrame, order: str = "ord") -> DataFrame:
    """Sequence detector alerts, one per key: the last in input order."""
    blank = F.lit("")
    keyed = alerts.select(
        order,
        F.coalesce("src", blank).alias("src_ip"),
        F.coalesce("dst", blank).alias("dst_ip"),
        F.coalesce(F.col("port").cast("string"), blank).alias("dst_port"),
        F.lower(F.coalesce("proto", blank)).alias("protocol"),
        F.struct(F.coalesce("proto", blank).alias("proto"), F.col("confidence").alias("lstm_confidence"),
                 F.col("risk").alias("lstm_risk")).alias("_value"),
    )
    picked = keyed.groupBy(*ALERT_KEYS).agg(F.max_by("_value", order).alias("_value"))
    return picked.select(*ALERT_KEYS, "_value.*")


def align_wildcards(rule: DataFrame, sequence: DataFrame) -> DataFrame:
    """Complete keys with a wildcard destination or no protocol from the single compatible alert.

    With zero or several compatible alerts the key stays as it is.  A completed row replaces a row
    that already has that key; of several completed rows the last in input order stays.
    """
    wild = endpoints.is_wildcard(F.col("dst_ip"))
    no_protocol = F.col("protocol") == ""
    target = F.struct("dst_ip", "protocol")
    n, any_one = F.count(F.lit(1)), F.min(target)
    by_port = sequence.groupBy("src_ip", "dst_port").agg(n.alias("_n1"), any_one.alias("_t1"))
    by_protocol = sequence.groupBy("src_ip", "dst_port", "protocol").agg(n.alias("_n2"), any_one.alias("_t2"))
    by_target = sequence.groupBy("src_ip", "dst_port", "dst_ip").agg(n.alias("_n3"), any_one.alias("_t3"))
    unnamed = by_protocol.where(no_protocol).select(
        "src_ip", "dst_port", F.col("_n2").alias("_n4"), F.col("_t2").alias("_t4"))

    complete = rule.where(~wild & ~no_protocol)
    partial = rule.where(wild | no_protocol)
    looked = (
        partial.join(by_port, ["src_ip", "dst_port"], "left")
        .join(by_protocol, ["src_ip", "dst_port", "protocol"], "left")
        .join(by_target, ["src_ip", "dst_port", "dst_ip"], "left")
        .join(unnamed, ["src_ip", "dst_port"], "left")
    )
    zero = F.lit(0).cast("long")
    count = (
        F.when(~wild, F.coalesce("_n3", zero))
        .when(no_protocol, F.coalesce("_n1", zero))
        .otherwise(F.coalesce("_n2", zero) + F.coalesce("_n4", zero))
    )
    found = F.when(~wild, F.col("_t3")).when(no_protocol, F.col("_t1")).otherwise(F.coalesce("_t2", "_t4"))
    moved = looked.withColumns({"_moved": count == 1, "_target": found})
    rest = [c for c in rule.columns if c not in ALERT_KEYS]
    moved = moved.select(
        "src_ip",
        F.when(F.col("_moved"), F.col("_target.dst_ip")).otherwise(F.col("dst_ip")).alias("dst_ip"),
        "dst_port",
        F.when(F.col("_moved"), F.col("_target.protocol")).otherwise(F.col("protocol")).alias("protocol"),
        *rest, "_moved",
    )
    everything = complete.withColumn("_moved", F.lit(False)).unionByName(moved)
    pick = F.max_by(F.struct(*rest), F.struct("_moved", "first_ord"))
    return everything.groupBy(*ALERT_KEYS).agg(pick.alias("_row")).select(*ALERT_KEYS, "_row.*")


def attach_evidence(alerts: DataFrame, evidence: DataFrame, name: str = "rita") -> DataFrame:
    """Evidence of the exact (src, dst, port), else the only wildcard evidence of (src, port)."""
    details = F.struct(*[c for c in evidence.columns if c not in EVIDENCE_KEYS])
    exact = evidence.select(
        F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("port").alias("dst_port"),
        details.alias("_exact"))
    loose = evidence.where(endpoints.is_wildcard(F.col("dst"))).groupBy(
        F.col("src").alias("src_ip"), F.col("port").alias("dst_port")
    ).agg(F.count(F.lit(1)).alias("_n"), F.max_by(details, "dst").alias("_loose"))
    joined = alerts.join(exact, ["src_ip", "dst_ip", "dst_port"], "left").join(
        loose, ["src_ip", "dst_port"], "left")
    found = F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_loose")))
    return joined.withColumn(name, found).drop("_exact", "_n", "_loose")


def merge_alerts(rule: DataFrame, sequence: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Full outer merge of both detectors' alerts on (src, dst, port, protocol).

    ``rule`` and ``sequence`` are the outputs of :func:`rule_alerts` and :func:`sequence_alerts`.
    """
    aligned = align_wildcards(rule, sequence).withColumn("_r", F.lit(True))
    other = sequence.withColumn("_s", F.lit(True))
    joined = aligned.join(other, ALERT_KEYS, "full_outer")
    has_rule, has_sequence = F.col("_r").isNotNull(), F.col("_s").isNotNull()
    base = F.when(has_rule, F.coalesce("threat_category", F.lit("unknown"))).otherwise(F.lit("lstm_only"))
    category = F.when(has_sequence, rules.stronger_category(base, F.coalesce("lstm_confidence", F.lit(0.0)))).otherwise(base)
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    merged = joined.select(
        "src_ip", "dst_ip", "dst_port",
        F.when(has_sequence, F.col("proto")).otherwise(F.col("protocol")).alias("protocol"),
        rules.chosen([(has_rule, rules.RULE_DETECTOR), (has_sequence, rules.SEQUENCE_DETECTOR)])
        .alias("detection_sources"),
        F.coalesce("beacon_score", zero).alias("beacon_score"),
        F.coalesce("long_conn_value", zero).alias("long_conn_value"),
        F.coalesce("c2_over_dns_value", zero).alias("c2_over_dns_value"),
        category.alias("threat_category"),
        F.coalesce("connection_count", none).alias("connection_count"),
        F.coalesce("total_bytes", none).alias("total_bytes"),
        F.coalesce("lstm_confidence", zero).alias("lstm_confidence"),
        F.when(has_sequence, F.coalesce("lstm_risk", F.lit("Unknown"))).otherwise(F.lit("Not Detected"))
        .alias("lstm_risk"),
    )
    if evidence is None:
        return merged
    with_rule = F.array_contains("detection_sources", rules.RULE_DETECTOR)
    found = attach_evidence(merged, evidence)
    return found.withColumn("rita", F.when(with_rule, F.col("rita")))


def threat_order(merged: DataFrame) -> DataFrame:
    """Strongest first; keys break ties."""
    return merged.orderBy(
        rules.priority(F.col("threat_category")), F.desc("lstm_confidence"), F.desc("beacon_score"), *ALERT_KEYS)


def connection_keys(rule: DataFrame, sequence: DataFrame) -> DataFrame:
    """Distinct keys of both detectors."""
    return rule.select(*ALERT_KEYS).unionByName(sequence.select(*ALERT_KEYS)).distinct()


def overlay_evidence(csv: DataFrame, mixtape: DataFrame) -> DataFrame:
    """Field by field: stored detector rows win over the export where they are not null."""
    values = [c for c in dict.fromkeys([*csv.columns, *mixtape.columns])
              if c not in (*EVIDENCE_KEYS, "evidence_source")]
    m = mixtape.withColumn("_m", F.lit(True)).alias("m")
    joined = m.join(csv.alias("c"), EVIDENCE_KEYS, "full_outer")

    def both(name):
        sides = [F.col(f"{a}.{name}") for a, df in (("m", mixtape), ("c", csv)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    source = F.when(F.col("m._m").isNotNull(), "rita_mixtape")
    if "evidence_source" in csv.columns:
        source = F.coalesce(source, F.col("c.evidence_source"))
    return joined.select(*EVIDENCE_KEYS, *[both(v) for v in values], source.alias("evidence_source"))


def tolerant_matches(csv: DataFrame, mixtape: DataFrame, order: str = "ord") -> DataFrame:
    """For every stored row the first export row with the same source, a compatible port and a
    compatible destination.

    A blank export port fits any port, ``''`` and ``::`` on either side fit any destination.  Each
    stored row probes at most six lookup keys that hold the first export row each, so nothing is
    paired up.
    """
    def canonical(df, prefix):
        dst = endpoints.canonical("dst")
        return df.withColumns({
            f"{prefix}src": endpoints.canonical("src"),
            f"{prefix}dst": F.when(dst.isin("", "::"), "*").otherwise(dst),
        })

    c = canonical(csv, "_c")
    first = F.min(F.struct(F.col(order), F.col("src"), F.col("dst"), F.col("port")))
    by_target = c.groupBy(F.col("_csrc").alias("_src"), F.col("port").alias("_port"), F.col("_cdst").alias("_dst")
                          ).agg(first.alias("_hit"))
    by_port = by_target.groupBy("_src", "_port").agg(F.min("_hit").alias("_hit")).withColumn("_dst", F.lit("any"))
    lookup = by_target.withColumn("_dst", F.concat(F.lit("="), "_dst")).unionByName(by_port)
    m = canonical(mixtape.select(*EVIDENCE_KEYS), "_m").select(
        *EVIDENCE_KEYS, F.col("_msrc").alias("_src"), F.col("_mdst").alias("_mdst"))
    targets = F.when(F.col("_mdst") == "*", F.array(F.lit("any"))).otherwise(
        F.array(F.concat(F.lit("="), F.col("_mdst")), F.lit("=*")))
    probes = m.select(*EVIDENCE_KEYS, "_src", F.explode(targets).alias("_dst"), F.col("port").alias("_p")).select(
        *EVIDENCE_KEYS, "_src", "_dst", F.explode(F.array_distinct(F.array(F.col("_p"), F.lit("")))).alias("_port"))
    hits = probes.join(lookup, ["_src", "_port", "_dst"], "left").groupBy(*EVIDENCE_KEYS).agg(
        F.min("_hit").alias("_hit"))
    return hits.select(
        *EVIDENCE_KEYS,
        F.col(f"_hit.{order}").alias("csv_order"),
        F.coalesce("_hit.src", "src").alias("target_src"),
        F.coalesce("_hit.dst", "dst").alias("target_dst"),
        F.coalesce(F.nullif(F.col("_hit.port"), F.lit("")), F.col("port")).alias("target_port"),
    )


def overlay_tolerant(csv: DataFrame, mixtape: DataFrame, order: str = "ord") -> DataFrame:
    """Overlay through :func:`tolerant_matches`; a matched blank port is filled in."""
    matches = tolerant_matches(csv, mixtape, order)
    values = [c for c in mixtape.columns if c not in EVIDENCE_KEYS]
    moved = mixtape.join(matches, EVIDENCE_KEYS)
    ranked = moved.groupBy("target_src", "target_dst", "target_port").agg(
        F.max_by(F.struct(*values), F.struct(*EVIDENCE_KEYS)).alias("_m"), F.min("csv_order").alias("_csv"))
    m = ranked.select(F.col("target_src").alias("src"), F.col("target_dst").alias("dst"),
                      F.col("target_port").alias("port"), "_csv", "_m.*")
    filled = csv.join(
        m.where(F.col("_csv").isNotNull()).select(F.col("_csv").alias(order), F.col("port").alias("_filled")),
        order, "left")
    base = filled.withColumn("port", F.coalesce(F.nullif(F.col("port"), F.lit("")), F.col("_filled"), F.lit("")))
    base = last_wins(base.drop("_filled"), EVIDENCE_KEYS, order)
    return overlay_evidence(base, m.drop("_csv"))
