"""Texts: retrieval queries, signal descriptions, evidence documents and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.rules import RULE_DETECTOR, SEQUENCE_DETECTOR, chosen

# Clauses of the retrieval query, in output order.
QUERY_PREFIX = "使用以下特征的 APT 组织: "
QUERY_FALLBACK = "可疑网络通信"
QUERY_CLAUSES = {
    "periodic": "statistically detected periodic command and control beacon",
    "learned": "high confidence machine learning detected C2 beacon",
    "agreement": "independent RITA and LSTM agreement on C2 behavior",
    "suspected": "suspected command and control communication",
    "dns": "DNS based command and control",
    "dns_resolution": "dynamic DNS resolution or DNS calculation",
    "protocol": " protocol traffic",
    "repeated": "repeated low volume network connections",
    "interval": "periodic beacon interval",
    "heartbeat": "small payload heartbeat traffic",
    "state": "connection state ",
    "beacon": "周期性 Beacon 通信",
    "dga": "DNS 隧道或 DGA 域名",
    "long": "持久化长连接",
    "tls": "TLS 加密通道",
    "cipher": ("使用 ", " 加密套件"),
    "port": "非标准端口 ",
    "dns_queries": "包含 DNS 查询行为",
    "http": "HTTP 协议通信",
    "port_80": "HTTP web protocols for command and control",
    "port_443": "HTTPS encrypted web protocols for command and control",
}

# Lines of the readable signal description, in output order.
SIGNAL_TEXT = {
    "head": "检测到疑似 C2 通信：",
    "endpoints": ("源 IP: ", " → 目标 IP: ", ":"),
    "beacon": ("Beacon 评分 ", "/100"),
    "long": ("长连接时长 ", "秒"),
    "dns": ("DNS 子域名数 ", ""),
    "scores": "威胁评分: ",
    "level": "威胁级别: ",
    "behaviour": ("连接行为: ", " 次连接, 平均间隔 ", " 秒, 总传输 ", " 字节"),
    "ja3": ("TLS 指纹: JA3=", "..."),
    "cipher": "加密套件: ",
    "server": "服务器名称: ",
    "queries": "DNS 查询: ",
    "agents": "User-Agent: ",
    "uris": "HTTP URI: ",
    "none": "未检测到高危威胁",
    "several": ("共检测到 ", " 个疑似威胁，以下为 Top ", ":\n"),
    "item": ("--- 威胁 ", " ---"),
}


# Line labels of an evidence document, in order, and its limits.
DOCUMENT_LINES = {
    "group": "Group: ", "aliases": "Aliases: ", "technique": "Technique: ", "tactic": "Tactic: Command and Control",
    "evidence": "Evidence: ", "background": "Group description: ", "software": "Associated software/tools: ",
}
NO_ITEMS = "(none)"
EVIDENCE_CHARS, BACKGROUND_CHARS = 900, 700


class _Fields:
    """Columns of a threat row; a missing column reads as null of the asked type."""

    def __init__(self, df: DataFrame):
        self._have = set(df.columns)

    def text(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in self._have else F.lit("")

    def number(self, *names: str) -> Column:
        have = [F.col(n).cast("double") for n in names if n in self._have]
        # the first value that is neither null nor zero, as in "a or b"
        return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in have], F.lit(0.0))

    def list(self, name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(F.col(name), empty) if name in self._have else empty


def query_text(df: DataFrame) -> Column:
    """Retrieval query of a threat: clauses in a fixed order, or the fallback clause."""
    f, q = _Fields(df), QUERY_CLAUSES
    sources = F.transform(f.list("detection_sources"), lambda s: F.upper(s))
    rules, learned = (F.array_contains(sources, s) for s in (RULE_DETECTOR, SEQUENCE_DETECTOR))
    beacon, confidence = f.number("beacon_score"), f.number("lstm_confidence")
    n, octets = f.number("connection_count", "conn_count"), f.number("total_bytes")
    interval, dns = f.number("avg_interval"), f.number("c2_over_dns_value")
    port, protocol, service = f.text("dst_port"), F.lower(f.text("protocol")), F.lower(f.text("service"))
    state, ja3, cipher = f.text("conn_state"), f.text("tls_ja3"), f.text("tls_cipher")
    over_dns = ((service == "dns") | (port == "53")) & ((dns >= 500) | rules)
    clauses = [
        (rules | (beacon >= 70), q["periodic"]),
        (learned & (confidence >= 90), q["learned"]),
        (rules & learned, q["agreement"]),
        (f.number("c2_score") >= 50, q["suspected"]),
        (over_dns, q["dns"]),
        (over_dns, q["dns_resolution"]),
        (protocol != "", F.concat(F.upper(protocol), F.lit(q["protocol"]))),
        (n >= 20, q["repeated"]),
        (interval.between(1, 3600) & (n >= 10), q["interval"]),
        ((n != 0) & (octets != 0) & (octets / F.greatest(n, F.lit(1.0)) <= 800), q["heartbeat"]),
        (state.isin("S0", "REJ", "RSTO", "RSTR"), F.concat(F.lit(q["state"]), state)),
        (beacon >= 70, q["beacon"]),
        (dns >= 800, q["dga"]),
        (f.number("long_conn_value") >= 28800, q["long"]),
        (ja3 != "", q["tls"]),
        ((ja3 != "") & (cipher != ""), F.concat(F.lit(q["cipher"][0]), cipher, F.lit(q["cipher"][1]))),
        ((port != "") & ~port.isin("80", "443", "53"), F.concat(F.lit(q["port"]), port)),
        (F.size(f.list("dns_queries")) > 0, q["dns_queries"]),
        (F.size(f.list("http_user_agents")) > 0, q["http"]),
        (port == "80", q["port_80"]),
        (port == "443", q["port_443"]),
    ]
    texts = chosen(clauses)
    body = F.when(F.size(texts) > 0, F.array_join(texts, ", ")).otherwise(F.lit(QUERY_FALLBACK))
    return F.concat(F.lit(QUERY_PREFIX), body)


def _whole(value: Column) -> Column:
    return F.format_string("%.0f", F.rint(value))


def _between(parts, *values: Column) -> Column:
    out = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        out += [value, F.lit(after)]
    return F.concat(*out)


def signal_text(df: DataFrame) -> Column:
    """Readable description of one threat, one line per trait that is present."""
    f, t = _Fields(df), SIGNAL_TEXT
    beacon, long_seconds, dns = f.number("beacon_score"), f.number("long_conn_value"), f.number("c2_over_dns_value")
    scores = chosen([
        (beacon > 0, _between(t["beacon"], _whole(beacon))),
        (long_seconds > 0, _between(t["long"], _whole(long_seconds))),
        (dns > 0, _between(t["dns"], _whole(dns))),
    ])
    scored = F.size(scores) > 0
    n, ja3 = f.number("conn_count"), f.text("tls_ja3")
    level = F.coalesce(F.nullif(f.text("threat_category"), F.lit("")), F.lit("unknown"))
    endpoints = F.concat(
        F.lit(t["endpoints"][0]), f.text("src_ip"), F.lit(t["endpoints"][1]), f.text("dst_ip"),
        F.lit(t["endpoints"][2]), f.text("dst_port"))

    def joined(label, name, limit):
        return F.concat(F.lit(label), F.array_join(F.slice(f.list(name), 1, limit), ", "))

    behaviour = F.concat(
        F.lit(t["behaviour"][0]), n.cast("long").cast("string"), F.lit(t["behaviour"][1]),
        F.format_string("%.1f", f.number("avg_interval")), F.lit(t["behaviour"][2]),
        f.number("total_bytes").cast("long").cast("string"), F.lit(t["behaviour"][3]))
    lines = chosen([
        (F.lit(True), t["head"]),
        (F.lit(True), endpoints),
        (scored, F.concat(F.lit(t["scores"]), F.array_join(scores, ", "))),
        (scored, F.concat(F.lit(t["level"]), F.upper(level))),
        (n > 0, behaviour),
        (ja3 != "", _between(t["ja3"], F.substring(ja3, 1, 32))),
        ((ja3 != "") & (f.text("tls_cipher") != ""), F.concat(F.lit(t["cipher"]), f.text("tls_cipher"))),
        ((ja3 != "") & (f.text("tls_server_name") != ""), F.concat(F.lit(t["server"]), f.text("tls_server_name"))),
        (F.size(f.list("dns_queries")) > 0, joined(t["queries"], "dns_queries", 5)),
        (F.size(f.list("http_user_agents")) > 0, joined(t["agents"], "http_user_agents", 3)),
        (F.size(f.list("http_uris")) > 0, joined(t["uris"], "http_uris", 3)),
    ])
    return F.array_join(lines, "\n")


def several_signals_text(df: DataFrame, top_n: int = 5) -> DataFrame:
    """One text for the strongest threats; the limit is the report's own."""
    t = SIGNAL_TEXT
    total = df.agg(F.count(F.lit(1)).alias("n"))
    top = df.withColumn("_text", signal_text(df)).orderBy(
        F.desc("beacon_score"), "src_ip", "dst_ip", "dst_port").limit(top_n)
    listed = top.agg(F.sort_array(F.collect_list(
        F.struct((-F.col("beacon_score")).alias("s"), "src_ip", "dst_ip", "dst_port", "_text"))).alias("items"))
    parts = F.transform("items", lambda x, i: F.concat(
        F.lit(t["item"][0]), (i + 1).cast("string"), F.lit(t["item"][1]), F.lit("\n"), x["_text"], F.lit("\n")))
    n = total.scalar()
    body = F.concat(
        F.lit(t["several"][0]), n.cast("string"), F.lit(t["several"][1]), F.size("items").cast("string"),
        F.lit(t["several"][2]), F.lit("\n"), F.array_join(parts, "\n"))
    return listed.select(F.when(F.size("items") > 0, body).otherwise(F.lit(t["none"])).alias("text"))


def evidence_text(name: Column, aliases: Column, technique_id: Column, technique_name: Column,
                  relation_text: Column, technique_text: Column, group_text: Column, software: Column) -> Column:
    """The labelled text of one (group, technique) evidence document."""
    evidence = F.coalesce(F.nullif(relation_text, F.lit("")), technique_text, F.lit(""))
    d = DOCUMENT_LINES

    def items(values):
        return F.array_join(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(NO_ITEMS))), ", ")

    return F.concat_ws(
        "\n",
        F.concat(F.lit(d["group"]), name),
        F.concat(F.lit(d["aliases"]), items(aliases)),
        F.concat(F.lit(d["technique"]), technique_id, F.lit(" "), technique_name),
        F.lit(d["tactic"]),
        F.concat(F.lit(d["evidence"]), F.substring(evidence, 1, EVIDENCE_CHARS)),
        F.concat(F.lit(d["background"]), F.substring(F.coalesce(group_text, F.lit("")), 1, BACKGROUND_CHARS)),
        F.concat(F.lit(d["software"]), items(software)),
    )


def labelled_value(text: Column, label: str) -> Column:
    """The rest of the first line that starts with ``label:``, trimmed; blank if there is none."""
    return F.trim(F.regexp_extract(text, rf"(?m)^{label}:(.*)$", 1))


# Fixed value: white space of any script, including the separators U+001C to U+001F.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def without_citations(text: Column) -> Column:
    """Squeeze white space and drop '(Citation: ...)' marks."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")
    cut = F.regexp_replace(flat, r"(?i) *\(Citation: *[^)]+\)", "")
    return F.trim(F.regexp_replace(cut, " {2,}", " "))

