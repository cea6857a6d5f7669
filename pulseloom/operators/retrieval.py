"""Exact nearest-document search and the roll-up of hits to group candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions import rules, texts
from pulseloom.operators.cells import REGION_BYTES, Index, Nearest, nearest_pruned, tiles
from pulseloom.schemas import TOP_K

BROADCAST_BYTES = 64 * 1024 * 1024


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vectors of one row."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def hit_count(k: int, documents: int, over_fetch: int = 8) -> int:
    return min(max(k * over_fetch, k), documents)


def _matrix(column) -> np.ndarray:
    """Vectors of equal length as rows; a null or a shorter one is an error, never a shifted row."""
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1 or None in lengths:
        raise ValueError(f"vectors of different lengths: {sorted(map(str, lengths))}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _top(queries: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int, step: int = 256):
    """Places of queries with ids and exact distances of their k nearest documents, for ``step`` queries at a time; ids break ties."""
    starts = range(0, len(queries), step)
    groups = [Nearest(queries[start:start + step], min(k, len(docs))) for start in starts]
    for tile in tiles(docs, ids):
        for near in groups:
            near.add(tile)
    for start, near in zip(starts, groups):
        query, doc, distance = near.hits()
        yield start + query, doc, distance


def nearest(queries: DataFrame, docs: DataFrame, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` nearest documents per query by squared L2 distance, exact.

    ``queries`` has ``query_id, vector`` and ``docs`` has ``doc_id, embedding``; ids are BIGINT.
    A document table whose vectors fit ``broadcast_bytes`` is shipped to every task once.  A larger
    one is searched behind Voronoi cells (``cells.nearest_pruned``), so that a query meets only documents that may be near.
    Only the nearest hits of a task ever leave it.  Null vectors are left out.
    """
    queries, docs = queries.where(F.col("vector").isNotNull()), docs.where(F.col("embedding").isNotNull())
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 0
    schema = T.StructType([
        T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()),
        T.StructField("distance", T.DoubleType()),
    ])
    if n == 0:
        return queries.sparkSession.createDataFrame([], schema)
    if n * dim * 8 <= broadcast_bytes:
        table = docs.select("doc_id", "embedding").toArrow()  # bounded by the check above
        ids = table.column("doc_id").combine_chunks().to_numpy(zero_copy_only=False)
        shipped = docs.sparkSession.sparkContext.broadcast((ids, _matrix(table.column("embedding").combine_chunks())))

        def run(batches):
            ids, vectors = shipped.value
            for batch in batches:
                names = batch.column("query_id").to_numpy(zero_copy_only=False)
                for own, found, distances in _top(_matrix(batch.column("vector")), vectors, ids, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[own]), pa.array(found), pa.array(distances)], names=["query_id", "doc_id", "distance"])

        # a distance block costs far more than its bytes suggest: use all cores
        cores = max(queries.sparkSession.sparkContext.defaultParallelism, 1)
        wide = queries.select("query_id", "vector").repartition(cores, "query_id")
        return wide.mapInArrow(run, schema)

    return nearest_pruned(queries, docs, k, region_bytes=max(1, min(REGION_BYTES, broadcast_bytes)))


def search(queries: DataFrame, docs: DataFrame, k: int = TOP_K, where: Column | None = None,
           by_group: bool = True, broadcast_bytes: int = BROADCAST_BYTES, index: Index | None = None) -> DataFrame:
    """Ranked hits with document columns: enough documents per query to roll up to ``k`` groups, or
    ``k`` documents without ``by_group``.

    Hits are exact.  With an ``index`` of ``docs`` they are those that the index finds; it can't be combined with ``where``.
    """
    if index is not None and where is not None:
        raise ValueError("an index holds all documents; search exactly to filter them")
    kept = docs.where(where) if where is not None else docs
    wanted = hit_count(k, kept.count()) if by_group else k
    if index is not None:
        hits = index.search(queries, wanted)
    else:
        hits = nearest(queries, kept, wanted, broadcast_bytes)
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(w))
    return ranked.join(kept.drop("embedding"), "doc_id").withColumn("score", similarity(F.col("distance")))


def group_candidates(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """Group candidates per query: best score plus a bonus for repeated evidence, ranked.

    A query has at most eight times ``k`` hits, so the lists stay small.
    """
    key = F.coalesce(F.nullif("group_id", F.lit("")), F.nullif("name", F.lit("")), F.col("doc_id").cast("string"))
    def have(name, default):
        return F.col(name) if name in hits.columns else default

    blank = F.lit("")
    known = have("c2_techniques", F.filter(F.array("technique_id"), lambda t: F.coalesce(t, blank) != ""))
    chunk = F.struct("rank", "doc_id", "score", "distance", "technique_id",
                     have("technique_name", blank).alias("technique_name"), have("text", blank).alias("text"),
                     known.alias("known"))
    profile = [c for c in ("aliases", "mitre_url", "technique_count", "c2_technique_count") if c in hits.columns]
    grouped = hits.withColumn("candidate", key).groupBy("query_id", "candidate").agg(
        F.min_by("name", "rank").alias("name"),
        *[F.min_by(c, "rank").alias(c) for c in profile],
        F.min("distance").alias("distance"),
        F.max("score").alias("top_score"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("rank").alias("first_rank"),
        F.array_sort(F.collect_list(chunk)).alias("_chunks"),
    )
    named = F.filter("_chunks", lambda c: F.coalesce(c["technique_id"], blank) != "")
    evidence = F.slice("_chunks", 1, 5)
    details = F.transform(
        F.filter(evidence, lambda c: F.coalesce(c["technique_id"], blank) != ""),
        lambda c: F.struct(c["technique_id"].alias("id"), c["technique_name"].alias("name"),
                           texts.labelled_value(c["text"], "Evidence").alias("evidence")))
    first_text = F.get(F.col("_chunks"), F.lit(0))["text"]
    df = grouped.select(
        "query_id", "candidate", "name", *profile, "distance",
        F.least(F.lit(1.0), F.col("top_score") + 0.03 * (F.least("chunk_count", F.lit(3)) - 1)).alias("score"),
        "chunk_count", "first_rank",
        evidence.alias("evidence_chunks"),
        F.slice(F.transform(named, lambda c: c["technique_id"]), 1, 5).alias("matched_techniques"),
        details.alias("matched_technique_details"),
        F.array_distinct(F.flatten(F.transform("_chunks", lambda c: c["known"]))).alias("c2_techniques"),
        texts.labelled_value(first_text, "Group description").alias("background"),
        texts.labelled_value(first_text, "Associated software/tools").alias("associated_software"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_rank")
    return df.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= k)


def best_two(candidates: DataFrame) -> DataFrame:
    """Per query: the best candidate, the two best scores and their difference."""
    r = F.col("candidate_rank")
    first = F.max(F.when(r == 1, F.struct("candidate", "name", "c2_techniques"))).alias("_best")
    agg = candidates.groupBy("query_id").agg(
        first, F.max(F.when(r == 1, F.col("score"))).alias("top1"),
        F.max(F.when(r == 2, F.col("score"))).alias("top2"))
    return agg.select(
        "query_id", F.col("_best.candidate").alias("candidate"), F.col("_best.name").alias("retrieved_top1"),
        F.col("_best.c2_techniques").alias("c2_techniques"), "top1", "top2",
        (F.coalesce("top1", F.lit(0.0)) - F.coalesce("top2", F.lit(0.0))).alias("score_gap"))


def attribution_details(threats: DataFrame, best: DataFrame, key: str = "query_id") -> DataFrame:
    """Detail row per threat; the primary candidate is blank unless the gate accepts it."""
    def have(name, default):
        return F.coalesce(F.col(name), default) if name in threats.columns else default

    zero, blank = F.lit(0.0), F.lit("")
    joined = threats.join(best, key, "left")
    decision = rules.attribution_gate(F.col("top1"), F.col("top2"))
    none = F.array().cast("array<string>")
    matched = F.when(F.col("top1").isNotNull(), rules.matched_techniques(
        F.col("c2_techniques"), have("beacon_score", zero), have("c2_over_dns_value", zero),
        have("long_conn_value", zero), have("dst_port", blank).cast("string"), have("tls_ja3", blank))).otherwise(none)
    out = joined.withColumns({"attribution_decision": decision, "matched_techniques": matched})
    accepted = F.col("attribution_decision") == "accepted"
    return out.withColumns({
        "attribution_accepted": accepted,
        "retrieved_top1": F.coalesce("retrieved_top1", blank),
        "primary_candidate": F.when(accepted, F.col("retrieved_top1")).otherwise(blank),
        "confidence": rules.attribution_confidence(F.col("top1"), F.col("top2")),
        "top1_score": F.coalesce("top1", zero),
        "top2_score": F.coalesce("top2", zero),
        "score_gap": F.coalesce("score_gap", zero),
        "c2_technique_hit": rules.c2_technique_hit(F.col("matched_techniques")),
    }).drop("top1", "top2", "candidate", "c2_techniques")


def association_rows(candidates: DataFrame, details: DataFrame, sample_techniques: Column, shown: int = 3) -> DataFrame:
    """The first candidates with the behaviours they share with the sample.

    ``details`` maps ``technique_id`` to a display name; the list of a candidate keeps evidence
    order and holds every name once.
    """
    top = candidates.where(F.col("candidate_rank") <= shown)
    shared = F.array_distinct(F.filter("matched_techniques", lambda t: F.array_contains(sample_techniques, t)))
    exploded = top.withColumn("_shared", shared).select(
        "query_id", "candidate_rank", F.posexplode("_shared").alias("k", "technique_id"))
    named = exploded.join(details, "technique_id", "left").groupBy("query_id", "candidate_rank").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(
            "k", F.coalesce("display_name", "technique_id").alias("name")))), lambda x: x["name"])).alias("_names"))
    joined = top.join(named, ["query_id", "candidate_rank"], "left")
    return joined.select(
        "query_id", "candidate_rank", "name",
        F.concat(F.format_string("%.1f", F.col("score") * 100), F.lit("%")).alias("association"),
        F.when(F.size("_names") > 0, F.array_join("_names", "、")).otherwise(F.lit(rules.LIMITED_SIMILARITY)).alias("matching_behaviors"),
    )
