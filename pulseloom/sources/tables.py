"""Readers with fixed schemas: feature files, manifests, reports, detector exports, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.schemas import FEATURE_ALIASES, FEATURES, GROUP_KEYS, LABELS, MIXTAPE, SORT_COLUMN, SPLITS, STIX_OBJECT
from pulseloom.sources import lines


def missing_columns(columns: list[str], labelled: bool = False, features: list[str] = FEATURES) -> list[str]:
    required = {*features, *GROUP_KEYS, SORT_COLUMN} | ({"label"} if labelled else set())
    return sorted(required - set(columns))


def check_columns(columns: list[str], labelled: bool = False) -> None:
    missing = missing_columns(columns, labelled)
    if missing:
        raise KeyError(f"feature rows lack required columns: {missing}")


def with_aliases(rows: DataFrame, default_source: str = "zeek") -> DataFrame:
    """Accept older column names; an old name counts only where the new one is absent."""
    for old, new in FEATURE_ALIASES.items():
        if new not in rows.columns and old in rows.columns:
            rows = rows.withColumn(new, F.col(old))
    return rows if "source_file" in rows.columns else rows.withColumn("source_file", F.lit(default_source))


def read_feature_csv(spark: SparkSession, path) -> DataFrame:
    """Feature rows as text, with or without lines before the header."""
    parsed = lines.parse_csv_with_preamble(lines.read_lines(spark, path), rule=str.strip)
    return with_aliases(parsed)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "length", "modificationTime")


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All feature files of one split; unknown splits, no rows or missing columns are errors."""
    if split not in SPLITS:
        raise ValueError(f"{split!r} is not among the splits {', '.join(SPLITS)}")
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder.rstrip('/')}/{split}")
    if not rows.columns or rows.isEmpty():
        raise ValueError(f"no rows for split {split!r}")
    check_columns(rows.columns, labelled=True)
    return rows.withColumn("label", F.col("label").cast("int"))


def read_connection_csvs(spark: SparkSession, folder: str, *, max_files: int = 0, stride: int = 1,
                         max_rows: int = 0) -> DataFrame:
    """Labelled connection rows of a folder, all text, with ``source_file`` and ``row_no``."""
    path: object = folder
    if max_files > 0:
        chosen = list_files(spark, folder, "*.csv").orderBy("path").limit(max_files)
        path = [r["path"] for r in chosen.collect()]  # at most max_files paths
    rows = spark.read.option("header", True).csv(path)
    placed = rows.select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("at"))
    return lines.stride_sample(placed, ["source_file"], stride, max_rows).drop("at")


def read_mixtape(spark: SparkSession, path) -> DataFrame:
    """Stored detector rows from JSON lines; lines that are not JSON are skipped."""
    rows = spark.read.schema(MIXTAPE).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("row_no", F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")))


_BUNDLE = T.StructType([T.StructField("objects", T.ArrayType(STIX_OBJECT))])


def read_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects of several intelligence bundles with ``file_ord`` and ``pos``: 'first' means the
    first file in the given order."""
    parts = []
    for i, path in enumerate(paths):
        raw = spark.read.option("multiLine", True).schema(_BUNDLE).json(path)
        parts.append(raw.select(F.lit(i).alias("file_ord"), F.posexplode("objects").alias("pos", "o")).select(
            "file_ord", "pos", "o.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_bundle_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All bundles below a folder; 'first' means the first path in text order."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", "true").schema(_BUNDLE).json(folder)
    return raw.select(F.col("_metadata.file_path").alias("file_ord"), F.posexplode("objects").alias("pos", "o")).select(
        "file_ord", "pos", "o.*")


def read_manifest(spark: SparkSession, path: str, only_files: list[str] | None = None) -> DataFrame:
    """The split manifest; missing columns or invalid rows are errors."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"file_name", "label", "split", "source", "scenario"} - set(rows.columns)
    if missing:
        raise KeyError(f"manifest lacks columns: {sorted(missing)}")
    if only_files:
        rows = rows.where(F.col("file_name").isin(*only_files))
    bad = rows.where(~F.col("split").isin(*SPLITS) | ~F.col("label").isin(*LABELS)).limit(1).collect()
    if bad:
        raise ValueError(f"invalid manifest row: {bad[0].asDict()}")
    return rows


def label_features(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add label, split, dataset, scenario and the qualified source name by file name."""
    label = F.when(F.col("label") == "malicious", LABELS["malicious"]).otherwise(F.lit(LABELS["benign"]))
    info = manifest.select(
        "file_name", label.alias("label"), "split", F.col("source").alias("dataset"), "scenario",
        F.concat("source", F.lit("__"), "file_name").alias("_source_file"))
    return features.join(info, "file_name").withColumn("source_file", F.col("_source_file")).drop("_source_file")


_METRICS = "struct<threshold:double,tn:long,fp:long,fn:long,tp:long,recall:double,fpr:double,precision:double,f1:double>"
RUN_REPORT = (
    f"seed long, candidate_model string, best_val_loss double, epochs_completed long, validation_groups {_METRICS}, "
    f"test_groups {_METRICS}, validation_windows {_METRICS}, test_windows {_METRICS}"
)


def read_run_reports(spark: SparkSession, folder: str, pattern: str = "seed_*.json") -> DataFrame:
    """One row per training run; none found is an error."""
    rows = (
        spark.read.option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .schema(RUN_REPORT).json(folder)
    )
    if rows.isEmpty():
        raise FileNotFoundError(f"no run reports in {folder}")
    return rows


FEATURE_JSON = (
    "src_ip string, dst_ip string, dst_port string, protocol string, detection_sources array<string>, "
    "beacon_score double, long_conn_value double, c2_over_dns_value double, threat_category string, "
    "connection_count long, total_bytes long, lstm_confidence double, lstm_risk string, source_file string, "
    "dataset_label string"
)


def parse_merged_threats(rows: DataFrame) -> DataFrame:
    """Threats from exported rows: the embedded JSON wins, three CSV columns are the fallback."""
    names = [f.name for f in T._parse_datatype_string(FEATURE_JSON).fields]
    blank = F.lit("")
    json = rows.withColumn("_j", F.from_json("feature_json", FEATURE_JSON))
    fallback = {"protocol", "source_file", "dataset_label"}
    return json.select("threat_index", *[
        (F.coalesce(F.col(f"_j.{n}"), *([F.col(n)] if n in rows.columns else []), blank)
         if n in fallback else F.col(f"_j.{n}")).alias(n)
        for n in names])


def read_merged_threats(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return parse_merged_threats(rows)
