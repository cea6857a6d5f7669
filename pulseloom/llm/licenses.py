"""License scans by diagonal voting, all in DataFrame operations.

Every rolling k-gram of a text's words is hashed and joined to the positions of the same k-gram in the templates.  A
match votes for a diagonal: the text position minus the template position.  Matches of one passage lie on one
diagonal, or on neighbouring ones where words were added or left out, so neighbouring diagonals of a template are
merged.  A merged span is verified: its k-grams are compared word by word, it has to hold at least ``coverage`` of the
template's k-grams, and it may be at most ``stretch`` times as long as the template.  Of spans that overlap, the one that
holds the largest share of its template counts.

A phrase is a template that has to be there word for word: all its k-grams on a single diagonal.

Words are runs of letters, digits and characters above U+007F, A-Z lower-cased.  A null text is empty.  Every row gives
one row, also rows whose key is null or repeats; rows without a match have no places, empty labels and score 0.

Only template rows are broadcast, and only up to ``BROADCAST_GRAMS`` of them; more are joined by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.urls import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_GRAMS = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """Hashes of the rolling k-grams of an array of words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """One row per k-gram position of (text, label) phrases and templates."""
    rows = [(t, label, exact) for exact, given in ((True, phrases), (False, templates)) for t, label in given]
    for text, label, _ in rows:
        if len(re.findall(WORD, text.lower())) < k:
            raise ValueError(f"the text for {label} has less than {k} words")
    if not rows:
        rows = [("", "", False)]
    table = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(label).alias("label"), F.lit(exact).alias("exact"))
        for i, (t, label, exact) in enumerate(rows)])
    return (
        spark.range(1).select(F.inline(table)).withColumn("twords", words_of(F.col("text"))).withColumn("hashes", _grams(F.col("twords"), k))
        .select("template", "label", "exact", F.size("twords").alias("t_words"), F.size("hashes").alias("t_grams"), "twords",
                F.posexplode("hashes").alias("t_at", "hash"))
        .withColumn("gram", F.slice("twords", F.col("t_at") + 1, k)).drop("twords")
    )


def scan(
    df: DataFrame, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], *, key: str = "doc_id",
    text: str = "text", k: int = 3, merge: int = 2, coverage: float = 0.7, stretch: float = 1.5,
) -> DataFrame:
    """``key``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (their least and greatest
    start), ``base_labels``, ``labels`` (of phrases and of verified spans) and ``score`` (best coverage of a verified span or
    phrase) of every row of ``df``."""
    grams = template_grams(df.sparkSession, phrases, templates, k)
    if sum(len(t.split()) for t, _ in [*phrases, *templates]) <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    texts = (
        df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
        # the first entry stands for the row itself, so rows without any match stay
        .withColumn("hashes", F.concat(F.array(F.lit(None).cast("bigint")), _grams(F.col("words"), k)))
    )
    rolling = texts.select("row", "key", F.size("words").cast("long").alias("n_words"), "words", F.posexplode("hashes").alias("nth", "hash"))
    hits = (
        rolling.join(grams, "hash", "left").where((F.col("nth") == 0) | (F.slice("words", F.greatest("nth", F.lit(1)), k) == F.col("gram")))
        .select("row", "key", "n_words", "template", "label", "exact", "t_words", "t_grams", "t_at",
                (F.col("nth") - 1).cast("long").alias("at"), (F.col("nth") - 1 - F.col("t_at")).cast("long").alias("diagonal"))
        .repartition("row")
    )
    on_diagonal = Window.partitionBy("row", "template", "diagonal")
    along = Window.partitionBy("row", "template").orderBy("diagonal", "t_at")
    voted = (
        hits.withColumn("votes", F.count(F.lit(1)).over(on_diagonal))
        .withColumn("gap", F.col("diagonal") - F.lag("diagonal").over(along))
        .withColumn("span", F.sum(F.when(F.col("gap") > merge, 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.when(F.col("exact") & (F.col("votes") == F.col("t_grams")) & (F.col("t_at") == 0), F.col("diagonal")))
    )
    spans = (
        voted.groupBy("row", "key", "n_words", "template", "label", "exact", "t_words", "t_grams", "span")
        .agg(F.count_distinct("t_at").alias("held"), (F.max("at") + k - F.min("at")).alias("length"), F.min("at").alias("begin"), F.count("place").alias("places"),
             F.min("place").alias("first"), F.max("place").alias("last"))
        .withColumn("share", F.col("held") / F.col("t_grams"))
    )
    # of spans that overlap, the one that holds most of its template gives the label
    is_span = ~F.col("exact") & (F.col("share") >= coverage) & (F.col("length") <= F.ceil(F.col("t_words") * F.lit(stretch)))
    by_start = Window.partitionBy("row", "is_span").orderBy("begin", "template")
    met = (
        spans.withColumn("is_span", F.coalesce(is_span, F.lit(False)))
        .withColumn("apart", F.coalesce(F.col("begin") >= F.max(F.col("begin") + F.col("length")).over(
            by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        .withColumn("passage", F.sum(F.col("apart").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth_best", F.dense_rank().over(
            Window.partitionBy("row", "is_span", "passage").orderBy(F.desc("share"), F.desc("held"))))
    )
    is_base = F.col("exact") & (F.col("places") > 0)
    is_best = F.col("is_span") & (F.col("nth_best") == 1)
    return (
        met.groupBy("row", "key", "n_words")
        .agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"),
             F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
             F.array_join(F.sort_array(F.collect_set(F.when(is_base | is_best, F.col("label")))), ",").alias("labels"),
             F.coalesce(F.max(F.when(is_base, F.lit(1.0)).when(is_best, F.col("share"))), F.lit(0.0)).alias("score"))
        .select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
