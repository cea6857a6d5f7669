"""SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit set where more than half of the hashes of a text's word shingles have it.  Words are runs of
characters other than ASCII white space, with A-Z lower-cased; shingles are joined by one space and count as often as
they occur.  A text with fewer words than a shingle is one shingle, and one without words (null too) has fingerprint 0.

Two fingerprints within a radius are found by the pigeonring principle.  Cut into segments on a ring, some chain of
consecutive segments has cumulative differences that stay within proportional budgets: over its first l segments at most
``l * radius / segments``.  While that is below one the segments are equal, so they are the key of an index; the rest of the
chain is tested before the full Hamming distance.

Equal fingerprints are one entry.  Rows of a bucket are compared in pairs only up to ``BUCKET`` entries; the entries of
larger buckets are linked by shared neighbours instead: entries within two bits have a value within one bit of both, so
each is listed under itself and its 64 one-bit changes, and a value lists at most 65 entries.  That is exact and grows in
proportion to the entries.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm import shinglesets
from pulseloom.llm.components import connected
from pulseloom.llm.texts import keyed_texts, map_rows
from pulseloom.session import materialise, scratch

BITS = 64
BUCKET = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes | None, size: int) -> list[bytes]:
    words = text.translate(_LOWER).split() if text else []
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    stops, at = [], -1
    for w in words:
        at += len(w) + 1
        stops.append(at)
    starts = [0, *[s + 1 for s in stops[:-size]]]
    return [line[a:b] for a, b in zip(starts, stops[size - 1:])]


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits, lowest first, whether more than half of the hashes (uint64) have it."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(hashes[at:at + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return counts * 2 > len(hashes)


def fingerprint(text: bytes | None, size: int) -> int:
    """The 64-bit fingerprint as a signed number."""
    found = shingles(text, size)
    if not found:
        return 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), dtype=np.uint64, count=len(found))
    return int(np.packbits(majority(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (signed 64 bits) of every whole text."""
    def work(keys, texts):
        return keys, [fingerprint(t, size) for t in texts.to_pylist()]

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fp", T.LongType())])
    return map_rows(keyed_texts(df, key, text).withColumn("_text", F.col("_text").cast("binary")), work, schema)


def _masks(segments: int) -> list[int]:
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _bits(value: Column, mask: int) -> Column:
    return F.bit_count(value.bitwiseAND(F.lit(_signed(mask))))


def link(entries: DataFrame, radius: int = 2, segments: int = 7, bucket: int = BUCKET) -> DataFrame:
    """Edges (``a``, ``b``) that connect all fingerprints of ``entries`` (distinct ``fp``) within ``radius`` bits (0 to 2).

    Every edge lies within the radius, and entries within it are joined by edges, directly or by others within it.
    """
    if not 0 <= radius <= 2 or segments <= radius:
        raise ValueError("radius 0 to 2, and more segments than that")
    masks = _masks(segments)
    fixed = max(n for n in range(1, segments + 1) if n * radius < segments)  # so many segments of a chain are equal

    def chain(start: int, length: int) -> int:
        return sum(masks[(start + i) % segments] for i in range(length))

    keyed = entries.select("fp", F.inline(F.array(*[
        F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(chain(s, fixed)))).alias("part")) for s in range(segments)])))
    sizes = materialise(keyed.groupBy("start", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    shared = materialise(keyed.join(sizes, ["start", "part"]))

    x = F.col("fp").bitwiseXOR(F.col("other"))
    viable = F.lit(False)
    for s in range(segments):
        within = F.col("start") == s
        for length in range(fixed + 1, segments):
            within = within & (_bits(x, chain(s, length)) <= length * radius // segments)
        viable = viable | within
    small = shared.where(F.col("n") <= bucket).select("start", "part", "fp")
    pairs = (
        small.join(small.withColumnRenamed("fp", "other"), ["start", "part"])
        .where((F.col("fp") > F.col("other")) & viable & (F.bit_count(x) <= radius)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    crowded = shared.where(F.col("n") > bucket).select("fp").distinct()
    near = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS if radius else 0)]]
    listed = (
        crowded.select("fp", F.explode(F.array(*near)).alias("value")).groupBy("value").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where(F.col("a") != F.col("b"))
    )
    if radius < 2:
        listed = listed.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return pairs.unionByName(listed).distinct()


def groups(df: DataFrame, size: int, *, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component`` (least key that links reach, its own included) of every row.

    Rows may share a key; rows with a null key are linked, but give no least key.
    """
    rows = materialise(fingerprints(df, size, key=key, text=text))
    entries = materialise(rows.groupBy("fp").agg(F.min(key).alias("least")))
    roots = connected(link(entries.select("fp"), radius))
    placed = entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(placed.join(least, "root").select("fp", "component"))
    return rows.join(named, "fp").select(key, "fp", "component")


# Near copies: fingerprints can't hold a similarity exactly, so ``later_copies`` links by the sets of shingles.

def later_copies(df: DataFrame, size: int = 5, *, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text_id`` of the rows that are near copies of another row: all but the least of each group, by both.

    Rows are linked if the sets of their shingles have this Jaccard similarity or more; a group is what links reach.  The
    rows with a null key take no part; rows that repeat a key and a text are one.
    """
    rows = keyed_texts(df, key, text).where(F.col("_key").isNotNull()).withColumn("id", shinglesets.text_id(F.col("_text")))
    with scratch(df.sparkSession) as keep:
        texts = rows.where(F.col("id") != shinglesets.EMPTY).select("id", F.col("_text").alias("text"))
        roots = connected(shinglesets.link(texts, lambda t: shingles(t, size), similarity))
        entries = rows.groupBy("id").agg(F.min(F.struct("_key", "id")).alias("least"))
        placed = entries.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
        least = placed.groupBy("root").agg(F.min("least").alias("least"))
        named = materialise(placed.drop("least").join(least, "root").select("id", "least"))
        return keep(rows.join(named, "id").where(F.struct("_key", "id") != F.col("least")).select(
            F.col("_key").alias(key), F.col("id").alias("text_id")).distinct())
