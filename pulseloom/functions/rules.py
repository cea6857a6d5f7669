"""Rule columns: scores, categories, gates and conclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseloom.functions.casts import clean_value, number_or_null
from pulseloom.schemas import (
    BEACON_LEVELS, C2_TECHNIQUES, DNS_LEVELS, INFRASTRUCTURE_PORTS, LONG_LEVELS, MIN_GAP, MIN_TOP1, WEB_PORTS,
)

# Names of the two detectors in result rows.
RULE_DETECTOR = "RITA"
SEQUENCE_DETECTOR = "LSTM"

# Rank of a threat category, strongest first; anything else ranks 5.
PRIORITY = {"high": 0, "critical": 0, "medium": 1, "lstm_only": 1, "low": 2, "base": 3, "unknown": 4}

# Texts shown to readers.
SEVERITY_LABELS = {"high": "高风险", "medium": "中风险", "low": "低风险", "base": "基础风险"}
NO_LABEL = "未形成可用风险判定"
BELOW_LABEL = "未达到 Beacon 风险告警阈值"
MALICIOUS = {"classification": "malicious_c2", "verdict": "恶意 C2 通信", "risk_level": "高危", "confidence": "中"}
LOW_RISK = {
    "classification": "benign_or_low_risk", "verdict": "未发现 C2 证据的低风险通信", "risk_level": "低危",
    "confidence": "中",
}
CONCLUSIONS = {
    "processing": "分析中", "failed": "分析失败", "cancelled": "已取消", "other": "未完成",
    "suspicious": "发现可疑 C2 行为", "normal": "未发现可疑 C2 行为",
}


MISSING = "未记录"
UNKNOWN_PROTOCOL = "未识别应用层协议"
LIMITED_SIMILARITY = "当前网络证据与该组织画像存在有限通信行为相似性。"

# Points and reasons of the C2-likelihood score, and its exclusions.
C2_REPEATS = [(1000, 30.0, "very_high_repeat_count"), (100, 24.0, "high_repeat_count"),
              (20, 16.0, "moderate_repeat_count"), (5, 8.0, "repeated_connection")]
C2_TERMS = {
    "sustained": (10.0, "sustained_activity_within_window"),
    "periodic": (18.0, "periodic_interval"),
    "web": (10.0, "web_c2_capable_channel"),
    "other_tcp": (4.0, "non_web_tcp_channel="),
    "low_bytes": (8.0, "low_byte_repeated_traffic"),
}
C2_EXCLUSIONS = {
    "dns": "excluded_dns_without_query_evidence",
    "icmp": "excluded_icmp_without_payload_evidence",
    "port": "excluded_infrastructure_port=",
}

# Heuristic beacon score by number of connections, bonus for regular spacing.
BEACON_TIERS = [(1000, 95.0), (100, 85.0), (20, 70.0), (5, 55.0)]
REGULAR_BONUS = 10.0

# Decisions of the attribution gate.
GATE = {
    "none": "no_candidate", "weak": "insufficient_top1_similarity", "close": "ambiguous_top1_top2_gap",
    "yes": "accepted",
}


def tier(value: Column, levels: list[tuple], default) -> Column:
    """The result of the first level whose bound the value reaches."""
    out = None
    for bound, result in levels:
        out = F.when(value >= bound, F.lit(result)) if out is None else out.when(value >= bound, F.lit(result))
    return out.otherwise(F.lit(default))


def lookup(value: Column, table: dict, default) -> Column:
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def chosen(items: list[tuple[Column, Column | str]]) -> Column:
    """The texts whose condition holds, in order."""
    cases = [F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in items]
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


def dns_value(subdomains: Column, score: Column) -> Column:
    return F.when(subdomains > 0, subdomains).when(score <= 1.0, score * 1000.0).otherwise(score)


def threat_category(beacon: Column, long_seconds: Column, dns: Column, severity: Column) -> Column:
    """A usable severity wins; otherwise the first of beacon, duration and DNS that reaches a level."""
    by_rule = F.coalesce(*[
        tier(v, [(lv["high"], "high"), (lv["medium"], "medium")], None)
        for v, lv in ((beacon, BEACON_LEVELS), (long_seconds, LONG_LEVELS), (dns, DNS_LEVELS))
    ], F.lit("low"))
    return F.when(severity.isin("high", "medium", "low", "base"), severity).otherwise(by_rule)


def high_risk_triggers(beacon: Column, long_seconds: Column, dns: Column, dns_score: Column,
                       subdomains: Column, severity: Column) -> list[tuple[Column, Column | str]]:
    return [
        (severity.isin("high", "medium"), F.concat(F.lit("severity="), severity)),
        (beacon >= BEACON_LEVELS["low"], f"beacon≥{BEACON_LEVELS['low']}"),
        (long_seconds >= LONG_LEVELS["low"], f"long_conn≥{LONG_LEVELS['low']}"),
        (dns >= DNS_LEVELS["low"], f"c2_dns≥{DNS_LEVELS['low']}"),
        (beacon >= BEACON_LEVELS["base"], f"beacon≥base({BEACON_LEVELS['base']})"),
        (dns_score >= 0.5, "c2_dns_score≥0.5"),
        (subdomains >= DNS_LEVELS["base"], f"subdomain≥{DNS_LEVELS['base']}"),
    ]


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def priority(category: Column) -> Column:
    return lookup(F.lower(category), PRIORITY, 5)


def category_of_confidence(confidence: Column) -> Column:
    return tier(confidence, [(90, "high"), (75, "medium")], "low")


def stronger_category(current: Column, confidence: Column) -> Column:
    """Promote only if the category of the confidence is strictly stronger."""
    other = category_of_confidence(confidence)
    return F.when(priority(other) < priority(current), other).otherwise(current)


def report_risk_label(severity: Column, score_text: Column) -> Column:
    """Severity text first; a score up to 1.5 counts as a 0-1 score, row by row."""
    text = F.lower(clean_value(severity, ""))
    blank = F.trim(F.coalesce(score_text, F.lit(""))) == ""
    score = F.when(blank, F.lit(0.0)).otherwise(number_or_null(score_text))
    scaled = F.when(score <= 1.5, score * 100).otherwise(score)
    by_score = F.when(scaled.isNull(), F.lit(NO_LABEL)).otherwise(tier(scaled, [
        (90, SEVERITY_LABELS["medium"]), (70, SEVERITY_LABELS["low"]), (50, SEVERITY_LABELS["base"])], BELOW_LABEL))
    return lookup(text, SEVERITY_LABELS, by_score)


def c2_likelihood(n: Column, window: Column, interval: Column, octets: Column, port: Column,
                  protocol: Column, service: Column) -> tuple[Column, Column]:
    """(score, reasons) of an hourly aggregate; excluded traffic scores 0 with one reason."""
    web = (protocol == "tcp") & port.isin(*WEB_PORTS)
    other_tcp = (protocol == "tcp") & ~port.isin(*WEB_PORTS, "", "unknown")
    t, x = C2_TERMS, C2_EXCLUSIONS
    terms = [
        (tier(n, [(b, p) for b, p, _ in C2_REPEATS], 0.0), tier(n, [(b, r) for b, _, r in C2_REPEATS], None)),
        _term(window >= 1800, *t["sustained"]),
        _term(interval.between(5.0, 900.0) & (n >= 10), *t["periodic"]),
        _term(web, *t["web"]),
        _term(other_tcp, t["other_tcp"][0], F.concat(F.lit(t["other_tcp"][1]), port)),
        _term((n >= 20) & (octets / n <= 800), *t["low_bytes"]),
    ]
    total = sum((p for p, _ in terms[1:]), terms[0][0])
    reasons = F.filter(F.array(*[r for _, r in terms]), lambda r: r.isNotNull())
    excluded = F.coalesce(
        F.when((service == "dns") | (port == "53"), F.lit(x["dns"])),
        F.when(protocol == "icmp", F.lit(x["icmp"])),
        F.when(port.isin(*INFRASTRUCTURE_PORTS), F.concat(F.lit(x["port"]), port)),
    )
    score = F.when(excluded.isNotNull(), F.lit(0.0)).otherwise(F.least(total, F.lit(100.0)))
    return score, F.when(excluded.isNotNull(), F.array(excluded)).otherwise(reasons)


def _term(condition: Column, points: float, reason) -> tuple[Column, Column]:
    text = reason if isinstance(reason, Column) else F.lit(reason)
    return F.when(condition, F.lit(points)).otherwise(F.lit(0.0)), F.when(condition, text)


def heuristic_beacon_score(n: Column, interval: Column) -> Column:
    base = tier(n, BEACON_TIERS, 0.0)
    regular = interval.between(1.0, 3600.0) & (n >= 10)
    return F.when(regular, F.least(base + REGULAR_BONUS, F.lit(100.0))).otherwise(base)


def attribution_confidence(top1: Column, top2: Column) -> Column:
    """0-100 from the best score and its lead; null scores mean no such candidate."""
    bonus = F.when(top2.isNotNull(), F.least((top1 - top2) * 100, F.lit(20.0))).otherwise(F.lit(0.0))
    clamped = F.least(F.greatest(top1 * 100 + bonus, F.lit(0.0)), F.lit(100.0))
    return F.when(top1.isNotNull(), clamped).otherwise(F.lit(0.0))


def attribution_gate(top1: Column, top2: Column, min_top1: float = MIN_TOP1, min_gap: float = MIN_GAP) -> Column:
    return (
        F.when(top1.isNull(), GATE["none"])
        .when(top1 < min_top1, GATE["weak"])
        .when(top2.isNotNull() & (top1 - top2 < min_gap), GATE["close"])
        .otherwise(F.lit(GATE["yes"]))
    )


def c2_technique_hit(techniques: Column) -> Column:
    return F.exists(techniques, lambda t: t.rlike("^(" + "|".join(C2_TECHNIQUES) + ")"))


def matched_techniques(techniques: Column, beacon: Column, dns: Column, long_seconds: Column,
                       port: Column, ja3: Column) -> Column:
    """Techniques of the best candidate that the threat's own traits support, sorted; else its first five."""
    def pick(condition, pattern):
        return F.when(condition, F.filter(techniques, lambda t: t.rlike(pattern))).otherwise(
            F.array().cast("array<string>"))

    odd_port = (F.coalesce(port, F.lit("")) != "") & ~port.isin("80", "443", "53")
    found = F.array_sort(F.array_distinct(F.concat(
        pick(beacon >= 90, "^(T1071|T1573)"),
        pick(dns >= 800, r"^T1071\.004$"),
        pick(long_seconds >= 28800, "^T1571$"),
        pick(F.coalesce(odd_port, F.lit(False)), "^T1571$"),
        pick(F.coalesce(ja3, F.lit("")) != "", "^T1573"),
    )))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(techniques, 1, 5))


def confusion_outcome(expected: Column, predicted: Column) -> Column:
    return (
        F.when(expected & predicted, "TP").when(~expected & ~predicted, "TN")
        .when(~expected & predicted, "FP").otherwise(F.lit("FN"))
    )


def overall_decision(threats: Column) -> Column:
    """Struct of verdict texts from the number of threats."""
    return F.struct(*[
        F.when(threats > 0, MALICIOUS[k]).otherwise(F.lit(LOW_RISK[k])).alias(k) for k in MALICIOUS
    ])


def sequence_state(status: Column, flagged: Column) -> Column:
    """State of the sequence detector: no sequence is never 'normal'."""
    idle = status.isNull() | status.isin("insufficient_sequence", "unavailable", "failed")
    return F.when(idle, "not_evaluated").when(flagged > 0, "alert").otherwise(F.lit("normal"))


def run_conclusion(status: Column, threats: Column) -> Column:
    """Processing state and verdict kept apart: (kind, label)."""
    done = status == "completed"
    kind = F.when(~done, status).when(threats > 0, "suspicious").otherwise(F.lit("normal"))
    return F.struct(kind.alias("kind"), lookup(kind, CONCLUSIONS, CONCLUSIONS["other"]).alias("label"))
