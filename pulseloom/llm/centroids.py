"""Centroid clustering over dictionary-encoded blocks of dimensions.

Components become whole numbers, floor(scale * x), and a vector is cut into blocks of ``width`` dimensions.  Within a page
of vectors each block is encoded without loss: the distinct subvectors are a dictionary and every vector holds a code.  A
round computes the distance of each dictionary entry to each centroid's block once and adds up the distances of a vector
by its codes; sums of members are made from counts per code as well.  All of it is integer arithmetic, so assignments,
ties (the smaller number) and centroids are exact and don't depend on partitions.

Pages are written once and every round is one pass over them without a shuffle of vectors: a task returns counts and sums
per centroid, and the driver gets one number per centroid and dimension.  Pages stay uncompressed, so what a task reads
bounds what it holds in memory.

Vectors count if they have ``size`` components, none null or non-finite; all others, null vectors included, are left out
of the result.  Repeated rows, also of one id, are separate vectors with a row each.  With fewer vectors than ``clusters``
there are as many centroids as vectors, and an empty table gives an empty result.  A row without an id is clustered but is
taken as a start only after all others.  Scaled components beyond 2^26 in size are an error, as their squared distances
don't fit a long.  Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.session import scratch, shared_folder

PAGE = 8192  # vectors of a page
LARGEST = 1 << 26


def usable(vector: Column, size: int) -> Column:
    """Is the vector complete: ``size`` components, none null or non-finite?"""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(scale * vectors.astype(np.float64))
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise OverflowError(f"a component times {scale} is beyond {LARGEST}: squared distances don't fit a long")
    return scaled.astype(np.int64)


def encode(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a block, and per row the place of its own."""
    low = block.min(axis=0)
    spans = [int(x) + 1 for x in block.max(axis=0) - low]
    if np.prod([float(s) for s in spans]) < 2.0 ** 62:
        key = np.zeros(len(block), dtype=np.int64)
        for column, span in zip((block - low).T, spans):
            key = key * span + column
        _, first, codes = np.unique(key, return_index=True, return_inverse=True)
        return block[first], codes
    distinct, codes = np.unique(block, axis=0, return_inverse=True)
    return distinct, codes.reshape(-1)


def distances(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector of a page to every centroid, summed by code."""
    total, at = 0, 0
    for distinct, codes in blocks:
        own = centroids[:, at:at + distinct.shape[1]]
        at += distinct.shape[1]
        to_centroids = np.zeros((len(distinct), len(own)), dtype=np.int64)
        for d in range(own.shape[1]):
            off = distinct[:, d:d + 1] - own[:, d]
            to_centroids += off * off
        total = total + to_centroids[codes]
    return total


def _pages(df: DataFrame, size: int, scale: int, width: int) -> DataFrame:
    """The encoded pages of all usable vectors, written to the shared folder."""
    key = df.schema["_key"].dataType
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(key)), T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("dictionaries", T.ArrayType(T.BinaryType())), T.StructField("codes", T.ArrayType(T.BinaryType()))])
    arrow = to_arrow_schema(schema)

    def page(keys: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        words, dictionaries, codes = [], [], []
        for at in range(0, size, width):
            distinct, places = encode(vectors[:, at:at + width])
            words.append(distinct.shape[1])
            dictionaries.append(distinct.astype("<i4").tobytes())
            codes.append(places.astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys).cast(arrow.field(0).type),
            pa.array([words], arrow.field(1).type), pa.array([dictionaries], arrow.field(2).type), pa.array([codes], arrow.field(3).type),
        ], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("_vector").flatten().to_numpy(zero_copy_only=False)
            keys.append(batch.column("_key"))
            held.append(whole_numbers(flat.reshape(-1, size), scale))
            while sum(map(len, held)) >= PAGE:
                all_keys, vectors = pa.concat_arrays(keys), np.concatenate(held)
                yield page(all_keys[:PAGE], vectors[:PAGE])
                keys, held = [all_keys[PAGE:]], [vectors[PAGE:]]
        if sum(map(len, held)):
            yield page(pa.concat_arrays(keys), np.concatenate(held))

    path = f"{shared_folder(df.sparkSession)}/pages"
    # stored as they are, so that the bytes of a split are the bytes that a task holds
    df.where(usable(F.col("_vector"), size)).mapInArrow(run, schema).write.option("compression", "uncompressed").option(
        "parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _blocks(batch: pa.RecordBatch, row: int) -> list[tuple[np.ndarray, np.ndarray]]:
    words, entries, codes = (batch.column(n)[row].as_py() for n in ("words", "dictionaries", "codes"))
    return [
        (np.frombuffer(e, dtype="<i4").reshape(-1, w).astype(np.int64), np.frombuffer(c, dtype="<u2"))
        for w, e, c in zip(words, entries, codes)]


def _assign(blocks, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = distances(blocks, centroids)
    nearest = found.argmin(axis=1)  # the first of equals
    return nearest, found[np.arange(len(found)), nearest]


def _moved(pages: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their members' means; a centroid without members stays."""
    count = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sums = np.zeros(count, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                blocks = _blocks(batch, row)
                nearest, _ = _assign(blocks, centroids)
                members += np.bincount(nearest, minlength=count)
                at = 0
                for distinct, codes in blocks:
                    per_code = np.bincount(nearest * len(distinct) + codes, minlength=count * len(distinct)).reshape(count, -1)
                    sums[:, at:at + distinct.shape[1]] += per_code @ distinct
                    at += distinct.shape[1]
        full = np.flatnonzero(members)
        # dimension -1 holds the number of members
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(full, sums.shape[1] + 1)), pa.array(np.tile(np.arange(-1, sums.shape[1]), len(full))),
            pa.array(np.concatenate([members[full, None], sums[full]], axis=1).reshape(-1))], names=["cluster", "dimension", "total"])

    # one row per centroid and dimension comes back, whatever the number of vectors
    rows = pages.mapInArrow(run, "cluster long, dimension long, total long").groupBy("cluster", "dimension").agg(F.sum("total").alias("total")).collect()
    totals = {(r["cluster"], r["dimension"]): r["total"] for r in rows}
    return np.array([
        [totals[c, d] // totals[c, -1] for d in range(centroids.shape[1])] if (c, -1) in totals else list(old)
        for c, old in enumerate(centroids)], dtype=np.int64).reshape(centroids.shape)


def cluster(
    df: DataFrame, *, clusters: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, width: int = 2, salt: str = "2:",
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid`` (its components) of
    every usable vector after ``rounds`` rounds and a last assignment.

    The starts are the ``clusters`` vectors whose ids, after ``salt``, have the least SHA-256 digests; equal digests are
    ordered by the vector.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    digest = F.sha2(F.concat(F.lit(salt), F.col("_key").cast("string")), 256)
    starts = rows.where(usable(F.col("_vector"), size)).orderBy(digest.asc_nulls_last(), "_vector").limit(clusters).select("_vector").collect()
    centroids = whole_numbers(np.array([r["_vector"] for r in starts], dtype=np.float64).reshape(len(starts), size), scale)
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not starts:
        return spark.createDataFrame([], T.StructType([
            *schema, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
            T.StructField("centroid", T.ArrayType(T.LongType()))]))
    with scratch(spark) as keep:
        pages = _pages(rows, size, scale, width)
        for _ in range(rounds):
            centroids = _moved(pages, centroids)
        arrow = to_arrow_schema(schema)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    nearest, distance = _assign(_blocks(batch, row), centroids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("keys")[row].values.cast(arrow.field(0).type), pa.array(nearest, pa.int32()), pa.array(distance)], schema=arrow)

        assigned = keep(pages.mapInArrow(assign, schema))
    own = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    per_cluster = F.array(*[F.lit(own.get(c, 0)).cast("long") for c in range(len(centroids))])
    places = F.array(*[F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in centroids.tolist()])
    return assigned.select(
        key, "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("long").alias("inertia"), F.get(places, F.col("cluster")).alias("centroid"))

