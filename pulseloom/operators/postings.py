"""Keyword search over an index: which rows hold which three characters.

A row that holds a keyword holds every three characters of it, so only rows that hold the keyword's rarest ones are read and
compared in full; that comparison is ``overview.keyword_filter`` (literal, without case).  Keywords of fewer than three characters,
and those whose rarest three characters are in too many rows, are compared with all rows.  The result is the same.

Postings are sorted by gram and key over all files, so a gram that most rows hold fills many files instead of one task, and
a search reads the row groups of its own grams only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.operators.overview import keyword_filter

SIZE = 3
GRAMS = 4  # rarest grams of a keyword that are looked up
SHARE = 0.2  # of the rows: a rarest gram that more of them hold saves nothing


def grams(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``_gram``, a row for each distinct hash of three characters of the text, which is taken in lower case."""
    letters = rows.withColumn("_letters", F.split(F.lower(column), "")).where(F.size("_letters") >= SIZE)
    starts = F.sequence(F.lit(1), F.size("_letters") - (SIZE - 1))
    cut = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("_letters", i, F.lit(SIZE)), "")))
    return letters.withColumn("_gram", F.explode(F.array_distinct(cut))).drop("_letters")


def write(rows: DataFrame, key: str, column: str, path: str) -> None:
    """Write the index of a text column to ``path``, replacing what is there: postings by gram, and how many keys each gram has.

    Rows may share a key.  Rows without a key are not indexed; a search compares all of them.
    """
    found = grams(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(column).alias("_text")), "_text")
    found.select("_gram", "_key").distinct().repartitionByRange("_gram", "_key").sortWithinPartitions("_gram", "_key").write.mode(
        "overwrite").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    counted = stored.groupBy("_gram").agg(F.count(F.lit(1)).alias("keys"))
    counted.repartitionByRange("_gram").sortWithinPartitions("_gram").write.mode("overwrite").parquet(f"{path}/counts")


def rarest(spark: SparkSession, path: str, keyword: str) -> list[tuple[int, int]] | None:
    """The rarest grams of a keyword and their counts, at most ``GRAMS``; empty if some gram has no key, null if it has no gram."""
    word = keyword.strip().lower()
    asked = [r[0] for r in grams(spark.createDataFrame([(word,)], "word string"), "word").select("_gram").collect()]
    if not asked:
        return None
    known = spark.read.parquet(f"{path}/counts").where(F.col("_gram").isin(asked)).collect()
    return sorted(((r["_gram"], r["keys"]) for r in known), key=lambda g: (g[1], g[0]))[:GRAMS] if len(known) == len(asked) else []


def search(rows: DataFrame, key: str, column: str, keyword: str, path: str) -> DataFrame:
    """The rows that ``keyword_filter`` keeps, found by the index at ``path`` that was written for these rows."""
    spark = rows.sparkSession
    few = rarest(spark, path, keyword)
    if few is None or few and few[0][1] > SHARE * rows.count():
        return keyword_filter(rows, column, keyword)
    loose = keyword_filter(rows.where(F.col(key).isNull()), column, keyword)
    if not few:
        return loose
    held = spark.read.parquet(f"{path}/postings").where(F.col("_gram").isin([g for g, _ in few]))
    keys = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(few)).select("_key")
    return keyword_filter(rows.join(keys, F.col(key) == F.col("_key"), "left_semi"), column, keyword).unionByName(loose)
