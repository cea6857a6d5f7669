"""Text files as rows that know their place in the file."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.endpoints import collapse_name
from pulseloom.plans.hotgroups import DEFAULT, Limits, spread
from pulseloom.session import materialise


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``path, file_name, at, value``: ``at`` orders the lines of one file, also across splits."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line")).alias("at"),
        "value",
    )


def with_row_numbers(rows: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Zero-based ``row_no`` per file: numbered inside each split, shifted by earlier splits."""
    df = rows.withColumn("_block", F.col(f"{at}.block"))
    sizes = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col(f"{at}.line"))
    numbered = df.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_block"]).withColumn(
        "row_no", (F.col("_offset") + F.col("_i")).cast("long")).drop("_block", "_i", "_offset")


def stride_sample(rows: DataFrame, keys: list[str], stride: int, max_rows: int = 0, at: str = "at") -> DataFrame:
    """Every ``stride``-th row of each file; ``max_rows`` counts rows before the stride."""
    numbered = with_row_numbers(rows, keys, at)
    if max_rows > 0:
        numbered = numbered.where(F.col("row_no") < max_rows)
    return numbered.where(F.pmod("row_no", F.lit(stride)) == 0) if stride > 1 else numbered


# A field of a line: quoted to its end (then anything up to the comma), or without a quote at its start.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+'
_FIELD = rf'(?:"{_QUOTED}|[^",][^,]*+|)'
_REST = rf"(?:,{_FIELD})*+$"


def quoted_records(lines: DataFrame, keys: list[str] = ("path",), limits: Limits = DEFAULT) -> DataFrame:
    """Lines of a file joined to records where a quoted field holds a line break; ``at`` is that of the first line.

    Each line is a function on two states, outside of quotes or inside, found for both starts.  A line that ends in one state
    whatever it starts in fixes the state; others keep or swap it.  So the state before a line follows from the last line
    that fixes it and the number of swaps since, both running values that blocks of a large file hand on.  Lines that are records by
    themselves are not moved.  A quote that is never closed takes the rest of its file, as it does for a sequential reader.
    """
    keys = list(keys)
    has = F.col("value").contains('"')
    out = F.when(has, ~F.col("value").rlike(f"^{_FIELD}{_REST}")).otherwise(F.lit(False)).cast("int")
    inside = F.when(has, ~F.col("value").rlike(f"^{_QUOTED}{_REST}")).otherwise(F.lit(True)).cast("int")
    if lines.where(out == 1).isEmpty():
        return lines
    rows = materialise(lines.withColumns({"_out": out, "_in": inside, "_split": F.col("at.block"), "_row": F.col("at.line")}))
    s = spread(rows, keys, "_split", tie=["_row"], rows_back=0, limits=limits)
    swap = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("long")
    s = s.with_carry({"_t": swap}, how="sum")
    so_far = s.window("_split", "_row").rowsBetween(Window.unboundedPreceding, 0)
    s = s.with_df(s.df.withColumn("_swaps", F.coalesce("_t", F.lit(0).cast("long")) + F.sum(swap).over(so_far)))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct("_split", "_row", F.col("_out").alias("state"), F.col("_swaps").alias("swaps")))
    s = s.with_carry({"_c": fixed})
    before = s.window("_split", "_row").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(fixed).over(before), F.col("_c"))
    since = F.col("_swaps") - swap - F.coalesce(last["swaps"], F.lit(0).cast("long"))
    state = (F.coalesce(last["state"], F.lit(0)) + since) % 2
    s = s.with_df(s.df.withColumn("_state", state))
    starts = (F.col("_state") == 0).cast("long")
    s = s.with_carry({"_r": starts}, how="sum")
    so_far = s.window("_split", "_row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = s.with_df(s.df.withColumn("_record", F.coalesce("_r", F.lit(0).cast("long")) + F.sum(starts).over(so_far))).finish()
    numbered = materialise(numbered.select(*lines.columns, "_state", "_out", "_record"))
    alone = (F.col("_state") == 0) & (F.col("_out") == 0)
    rest = [c for c in lines.columns if c not in (*keys, "at", "value")]
    joined = numbered.where(~alone).groupBy(*keys, "_record").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_lines"), *[F.min_by(c, "at").alias(c) for c in rest])
    whole = joined.withColumns({
        "at": F.get("_lines", F.lit(0))["at"], "value": F.array_join(F.transform("_lines", lambda x: F.coalesce(x["value"], F.lit(""))), "\n")})
    return numbered.where(alone).select(*lines.columns).unionByName(whole.select(*lines.columns))


def parse_csv_with_preamble(lines: DataFrame, rule=collapse_name, header_prefix: str | None = None,
                            keys: list[str] = ("path",)) -> DataFrame:
    """CSV rows after an arbitrary preamble, all text, columns renamed by ``rule``.

    The header of a file is its first non-blank line with a comma (or with ``header_prefix``).
    A quoted field may hold line breaks and doubled quotes.  Every record is parsed once, as wide as the widest header, and a column is taken from the place where its file's header has
    it (the last, if twice).  Only the distinct header lines reach the driver, since they decide the output columns.
    """
    keys = list(keys)
    text = F.trim("value")
    is_header = F.col("value").startswith(header_prefix) if header_prefix else F.col("value").contains(",")
    headers = lines.where((text != "") & is_header).groupBy(*keys).agg(
        F.min_by("value", "at").alias("_header"), F.min("at").alias("_header_at"))
    layouts = {r["_header"]: [rule(n) for n in next(csv.reader([r["_header"]]))] for r in headers.select("_header").distinct().collect()}
    names = list(dict.fromkeys(n for found in layouts.values() for n in found if n))
    if not names:
        return lines.join(headers, keys).select(*keys, "at").limit(0)
    wide = max(map(len, layouts.values()))
    places = [(h, [max((i for i, m in enumerate(found) if m == n), default=None) for n in names]) for h, found in layouts.items()]
    table = lines.sparkSession.createDataFrame(places, "_header string, _places array<int>")
    # one row per file, written first: broadcast by its size, or else a join in which Spark splits a large file
    placed = materialise(headers.join(table, "_header").drop("_header"))
    body = quoted_records(lines.join(placed, keys).where(F.col("at") > F.col("_header_at")), keys).where(text != "")
    row = F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(wide))), {"escape": '"', "mode": "PERMISSIVE"})
    parsed = body.withColumn("_r", row).withColumn("_r", F.array(*[F.col(f"_r.c{i}") for i in range(wide)]))
    return parsed.select(*keys, "at", *[
        F.get("_r", F.get("_places", F.lit(k))).alias(n) for k, n in enumerate(names)])


def parse_tsv_logs(lines: DataFrame, columns: dict[str, str], keys: list[str] = ("path",)) -> DataFrame:
    """Tab-separated log rows: ``columns`` maps log field names to output names, all text.

    The ``#fields`` line of a file names its columns.  Rows of another width are dropped, other
    ``#`` lines too; a field that the file does not have is null.
    """
    keys = list(keys)
    fields = F.expr(r"slice(split(value, '\t'), 2, size(split(value, '\t')))")
    headers = lines.where(F.col("value").startswith("#fields")).groupBy(*keys).agg(
        F.max_by(fields, "at").alias("_fields"))
    # positions are looked up once per file, not once per row
    headers = headers.select(
        *keys, F.size("_fields").alias("_width"),
        *[(F.array_position("_fields", F.lit(f)) - 1).cast("int").alias(f"_p_{n}") for f, n in columns.items()])
    values = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(
        *keys, "at", F.split("value", "\t").alias("_values"))
    joined = values.join(materialise(headers), keys).where(F.size("_values") == F.col("_width"))
    return joined.select(*keys, "at", *[
        F.when(F.col(f"_p_{n}") >= 0, F.get("_values", F.col(f"_p_{n}"))).alias(n) for n in columns.values()])


# Log field -> column.
CONN_FIELDS = {
    "ts": "ts", "id.orig_h": "orig_h", "id.orig_p": "orig_p", "id.resp_h": "resp_h", "id.resp_p": "resp_p",
    "proto": "proto", "duration": "duration", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes",
    "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts",
}
SSL_FIELDS = {
    "id.orig_h": "orig_h", "id.resp_h": "resp_h", "id.resp_p": "resp_p", "ja3": "ja3", "cipher": "cipher",
    "server_name": "server_name", "version": "version",
}
DNS_FIELDS = {"id.orig_h": "orig_h", "query": "query"}
HTTP_FIELDS = {
    "id.orig_h": "orig_h", "id.resp_h": "resp_h", "id.resp_p": "resp_p", "host": "host",
    "user_agent": "user_agent", "uri": "uri",
}
