"""Facts of one capture that a report may state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseloom.functions.rules import MISSING, chosen

# Techniques that the observed behaviour supports.
WEB_TECHNIQUE = "T1071.001"
MASQUERADE_TECHNIQUE = "T1036"


def behaviour_techniques(http_requests: Column, mismatches: Column) -> Column:
    """Web protocol use when there are HTTP requests; masquerading when a host name hides a private target."""
    return chosen([(http_requests > 0, F.lit(WEB_TECHNIQUE)), (mismatches > 0, F.lit(MASQUERADE_TECHNIQUE))])


# Findings and the parts of their evidence texts.
FINDINGS = {
    "mismatch": ("服务身份与真实目标不一致", ("HTTP Host 为 `", "`，实际连接目标为 `", ":", "`。")),
    "http": ("HTTP 通信已被识别", ("共记录 ", " 条 HTTP 请求，主要 Host 为 `", "`。")),
    "tls": ("TLS 服务信息可识别", ("SNI 为 `", "`，目标地址为 `", "`，协议版本为 `", "`。")),
    "sequence_alert": ("自动化时序通信特征", ()),
    "sequence_normal": ("时序检测未告警", ()),
}


def _finding(name: str, *values: Column) -> Column:
    title, parts = FINDINGS[name]
    text = [F.lit(parts[0])] if parts else []
    for value, after in zip(values, parts[1:]):
        text += [value, F.lit(after)]
    return F.struct(F.lit(title).alias("finding"), (F.concat(*text) if text else F.lit("")).alias("evidence"))


def findings() -> tuple[Column, Column]:
    """(abnormal, benign) findings of a capture from the columns of the HTTP and TLS facts and
    ``sequence_state``: a host name on a private target is abnormal, recognised HTTP without one
    and recognised TLS are benign."""
    def text(name):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(MISSING))

    mismatch = F.col("mismatches") > 0
    abnormal = chosen([
        (mismatch, _finding("mismatch", text("mismatch_host"), text("mismatch_target"), text("mismatch_port"))),
        (F.col("sequence_state") == "alert", _finding("sequence_alert")),
    ])
    benign = chosen([
        (~mismatch & (F.col("http_requests") > 0),
         _finding("http", F.col("http_requests").cast("string"), text("first_host"))),
        (F.col("tls_sessions") > 0, _finding("tls", text("tls_sni"), text("tls_targets"), text("tls_versions"))),
        (F.col("sequence_state") == "normal", _finding("sequence_normal")),
    ])
    return abnormal, benign
