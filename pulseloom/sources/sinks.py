"""Writers.  Every writer is a plain distributed write; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.schemas import ALERT_KEYS
from pulseloom.functions import rules


def flat(df: DataFrame, separator: str = ";") -> DataFrame:
    """CSV-ready columns: string arrays joined, other nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, separator)
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_features(rows: DataFrame, path: str, format: str = "parquet", captures: DataFrame | None = None) -> None:
    """Feature rows by split and capture, few files each: rows of a capture meet in one task, large ones in several.

    ``captures`` (``split``, ``source_file``) lists what must have a file: as CSV, a capture without rows gets one that holds
    the header alone.
    """
    writer = rows.hint("rebalance", "split", "source_file").write.mode("overwrite").partitionBy("split", "source_file")
    writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path)
    if captures is None or format != "csv":
        return
    have = rows.select("split", "source_file").distinct()
    columns = [c for c in rows.columns if c not in ("split", "source_file")]
    missing = captures.select("split", "source_file").distinct().join(have, ["split", "source_file"], "left_anti")
    header = missing.select("split", "source_file", F.lit(",".join(columns)).alias("value"))
    header.write.mode("append").partitionBy("split", "source_file").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header in every part file, also when there are no rows."""
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str, keys: list[str], metrics: list[str]) -> None:
    """One JSON object per evaluated part: its keys, and its counts and ratios under ``metrics``."""
    write_json(df.select(*keys, F.struct(*metrics).alias("metrics")), path)


def export_rows(merged: DataFrame, capture: str = "source_file") -> DataFrame:
    """Merged threats with a 1-based index per capture and the whole row as JSON."""
    columns = [c for c in merged.columns]
    order = Window.partitionBy(capture).orderBy(
        rules.priority(F.col("threat_category")), F.desc("lstm_confidence"), F.desc("beacon_score"), *ALERT_KEYS)
    return merged.withColumn("feature_json", F.to_json(F.struct(*columns))).withColumn(
        "threat_index", F.row_number().over(order))


def write_merged_threats(merged: DataFrame, path: str, capture: str = "source_file") -> None:
    write_csv(export_rows(merged, capture), path)


def write_knowledge_base(documents: DataFrame, path: str) -> None:
    """Full rebuild, never incremental."""
    documents.write.mode("overwrite").parquet(path)


def export_knowledge_base(documents: DataFrame, path: str) -> None:
    """Text and metadata without vectors, as JSON lines."""
    plain = documents.drop("embedding")
    metadata = [c for c in plain.columns if c not in ("id", "text")]
    write_json(plain.select("id", "text", F.struct(*metadata).alias("metadata")), path)


def write_run(df: DataFrame, root: str, artifact: str, analysis_id: str) -> None:
    """One artifact of one run; other runs' partitions stay."""
    df.withColumn("analysis_id", F.lit(analysis_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{root.rstrip('/')}/{artifact}")
