"""URL filters: a sort-merge range join of hosts with nested rules, all in DataFrame operations.

A host's canonical key is its labels in reverse, each followed by a dot, so a domain and all its subdomains lie in
one interval of keys, ``[key, key with "/" for its last dot)`` ("/" is the character after "."; no host holds it).
Intervals of different domains are disjoint or nested.  Interval ends and distinct hosts are sorted into one
sequence.  Sweeping over it, a running sum of starts and ends is the depth of the stack, and the entry at a depth is
the last interval that started there.  The sequence is cut into ranges; what a range needs from those before it is one
depth and one entry per level, so no task sees more than its range.

Every url of a host then tests the rules on its host's stack by path.  The rule with the longest host wins, and among
rules of one host that with the longest path.  Hosts are made distinct before the sort, so a common host is one row
there, and the join back to the urls is one that Spark splits where a host is common.

A null url, or one without ``://``, has an empty host and path; no rule fits it, and it gets the default verdict.
Rules with a null or empty host fit nothing; a null path is an empty one; of equal rules that differ in their verdict,
``block`` wins.  Without rules every url gets the default.  Rules may be many: they are sorted, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END, _START, _HOST = 0, 1, 2  # the order at equal keys


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``fits``: the rules (host, path, verdict) whose host is this one or a domain above it.

    Hosts that no rule covers are left out.  ``hosts`` has distinct values of ``host``.
    """
    spark = hosts.sparkSession
    own = (
        rules.where((F.col("host") != "") & F.col("verdict").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
        .agg(F.max("verdict").alias("verdict"))
        .groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("entry"))
        .withColumn("key", host_key(F.col("host")))
    )
    entry = own.schema["entry"].dataType
    nothing = F.lit(None).cast(entry)
    starts = own.select("key", F.lit(_START).alias("kind"), F.lit(1).alias("step"), "entry", F.lit(None).cast("string").alias("host"))
    ends = own.select(F.expr("concat(substr(key, 1, length(key) - 1), '/')").alias("key"), F.lit(_END).alias("kind"),
                      F.lit(-1).alias("step"), nothing.alias("entry"), F.lit(None).cast("string").alias("host"))
    seen = hosts.select(host_key(F.col("host")).alias("key"), F.lit(_HOST).alias("kind"), F.lit(0).alias("step"), nothing.alias("entry"), "host")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = materialise(
        starts.unionByName(ends).unionByName(seen).repartitionByRange(ranges, "key", "kind").withColumn("range", F.spark_partition_id()))

    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = events.groupBy("range").agg(F.sum("step").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("depth_before"))
    swept = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    deep = materialise(
        events.join(F.broadcast(before), "range").withColumn("depth", F.col("depth_before") + F.sum("step").over(swept)))

    # entries that earlier ranges left at each level; depth is at most the number of labels in a host
    levels = deep.where(F.col("kind") == _START).agg(F.max("depth")).first()[0] or 0
    if not levels:
        return events.select("host", F.col("entry").alias("fits")).limit(0)
    starts_at = [F.when((F.col("kind") == _START) & (F.col("depth") == d), F.col("entry")) for d in range(1, levels + 1)]
    left = deep.groupBy("range").agg(*[
        F.max_by("entry", F.when((F.col("kind") == _START) & (F.col("depth") == d), F.struct("key", "kind"))).alias(f"left{d}")
        for d in range(1, levels + 1)])
    carried = left.select("range", *[F.last(f"left{d}", ignorenulls=True).over(earlier).alias(f"before{d}") for d in range(1, levels + 1)])
    stack = F.array(*[
        F.when(F.col("depth") >= d, F.coalesce(F.last(s, ignorenulls=True).over(swept), F.col(f"before{d}")))
        for d, s in enumerate(starts_at, 1)])
    return (
        deep.join(F.broadcast(carried), "range").withColumn("fits", F.flatten(F.array_compact(stack)))
        .where((F.col("kind") == _HOST) & (F.size("fits") > 0)).select("host", "fits")
    )


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null) and ``verdict`` of every row."""
    parts = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    covered = materialise(stacks(parts.select("host").distinct(), rules))
    fitting = F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fitting, lambda r: F.struct(
        F.length(r["host"]).alias("a"), F.length(r["path"]).alias("b"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
    return (
        parts.join(covered, "host", "left").withColumn("_best", longest)
        .select(F.col("_key").alias(key), "host", "path", F.concat(F.col("_best.host"), F.col("_best.path")).alias("rule"),
                F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
    )
