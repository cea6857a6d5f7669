"""Embedding near-dedup by lattice hashing.

Each table projects the unit vectors onto random orthogonal directions, eight for each of two blocks, scales them, and
decodes each block to the nearest point of the lattice E8.  The two points are the vector's home cell.  It also probes the
cells in which one of the points is a lattice neighbour instead (one of the 240 shortest lattice vectors away), of those the
nearest to it.  Every pair that meets in a home cell of one of the two, in any table, is verified by the cosine in double
precision.  At the defaults a pair of 64 components meets with a probability of about 0.99 at cosine 0.95, and above that
at higher ones.

Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing; so do vectors of
different lengths.  Equal vectors are one entry that counts for all its rows.

A cell's members are cut into blocks of bounded size, and a task compares two blocks at a time as matrices, so a cell
that holds a large share of all rows is many small pieces of work, and no row is made for a pair.  A pair that meets
more than once counts where it meets first: in the first table, which both vectors tell by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.llm.components import connected
from pulseloom.session import materialise

BLOCK = 512  # vectors of a block, on average
_SMALL = 64  # up to so many vectors of a cell are compared as single pairs


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        v = np.array([-0.5 if signs >> i & 1 else 0.5 for i in range(8)])
        if bin(signs).count("1") % 2 == 0:
            out.append(v)
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates and an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    at = np.argmax(np.abs(off[odd]), axis=1)
    near[odd, at] += np.where(off[odd, at] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest lattice points: the nearer of the even points and of those shifted by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@dataclass(frozen=True)
class Lattice:
    """``tables`` cells for vectors with ``size`` components, each of two lattice points; ``probes`` neighbours of either
    point are probed, and ``scale`` is the length that a unit vector has in the lattice on average."""

    size: int
    tables: int = 6
    probes: int = 3
    scale: float = 1.5
    seed: int = 42

    @cached_property
    def projections(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        wide = max(self.size, 16)  # with fewer components the rest count as zero
        out = []
        for _ in range(self.tables):
            q, _ = np.linalg.qr(rng.standard_normal((wide, wide)))
            out.append(q[:self.size, :16] * np.sqrt(wide / 8) * self.scale)
        return np.stack(out)

    @cached_property
    def neighbours(self) -> np.ndarray:
        return short_vectors()

    def cells(self, units: np.ndarray, table: int) -> np.ndarray:
        """Codes of the home cell and of the probed cells: one row per vector, home first."""
        x = units @ self.projections[table]
        blocks = []
        for part in (x[:, :8], x[:, 8:]):
            home = decode(part)
            ahead = (part - home) @ self.neighbours.T
            nearest = np.argsort(-ahead, axis=1, kind="stable")[:, :self.probes]
            blocks.append(_codes(np.concatenate([home[:, None, :], home[:, None, :] + self.neighbours[nearest]], axis=1)))
        one, two = blocks
        return np.concatenate([_joined(one, two[:, :1]), _joined(one[:, :1], two[:, 1:])], axis=1)


def _codes(points: np.ndarray) -> np.ndarray:
    """Doubled coordinates in one number, eight bits each; cells that this mixes up only give more pairs to verify."""
    doubled = (2 * points).astype(np.int64) & 0xFF
    code = np.zeros(points.shape[:-1], dtype=np.uint64)
    for i in range(8):
        code = (code << np.uint64(8)) | doubled[..., i].astype(np.uint64)
    return code


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mixed = (one ^ (one >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) + two * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; first scaled by the largest component, so that squares stay finite."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, size)


def _cell_rows(entries: DataFrame, lattice: Lattice) -> DataFrame:
    """(table, cell, home, id) for the home cell and the probed cells of every entry."""
    schema = T.StructType([
        T.StructField("table", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType()),
        T.StructField("id", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            units = _units(_matrix(batch.column(1), lattice.size))
            for table in range(lattice.tables):
                codes = lattice.cells(units, table)
                home = np.zeros(codes.shape, dtype=bool)
                home[:, 0] = True
                n = codes.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, table, dtype=np.int32)), pa.array(codes.ravel()), pa.array(home.ravel()),
                     pa.array(np.repeat(ids, codes.shape[1]))], schema=arrow)

    return entries.select("id", "vector").mapInArrow(run, schema)


def _close_pairs(units: np.ndarray, run: np.ndarray, apart: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of rows of the same run with the cosine; where ``apart``, only of different sides."""
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(first, len(run)))
    out_i, out_j = [], []
    big = sizes > _SMALL
    for start, n in zip(first[big], sizes[big]):  # as matrices
        i, j = np.nonzero(np.triu(units[start:start + n] @ units[start:start + n].T >= cosine - 1e-9, 1))
        out_i.append(i + start)
        out_j.append(j + start)
    small = np.repeat(~big, sizes)
    for ahead in range(1, int(sizes[~big].max(initial=1))):
        i = np.flatnonzero(small[:-ahead] & (run[:-ahead] == run[ahead:]))
        out_i.append(i)
        out_j.append(i + ahead)
    i, j = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_i, out_j))
    keep = ~apart[i] | (side[i] != side[j])
    i, j = i[keep], j[keep]
    close = np.concatenate([
        np.einsum("ij,ij->i", units[i[at:at + 65536]], units[j[at:at + 65536]]) >= cosine for at in range(0, max(len(i), 1), 65536)])
    return i[close], j[close]


def _counts_here(cells: np.ndarray, table: np.ndarray, home: np.ndarray, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs count where they are: no earlier table has them, and of two cells in this one the smaller id's home."""
    def meets(a, b):
        return (b == a[:, :1]).any(axis=1)

    first = home[i] | home[j]
    for t in range(len(cells)):
        earlier = t < table[i]
        first &= ~(earlier & (meets(cells[t][i], cells[t][j]) | meets(cells[t][j], cells[t][i])))
    a, b = cells[table[i], i], cells[table[i], j]
    same = a[:, 0] == b[:, 0]
    twice = ~same & meets(a, b) & meets(b, a)
    smaller_home = np.where(ids[i] < ids[j], home[i], home[j])
    return first & (~same | home[i] & home[j]) & (~twice | smaller_home)


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the least row that the pairs lead to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if np.array_equal(before, least):
            return least


def _work(pieces: DataFrame, lattice: Lattice, cosine: float) -> DataFrame:
    """Runs over pieces (table, cell, one, two): per entry how many rows it links with, and edges that connect entries."""
    schema = T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def judged(rows: list[np.ndarray]) -> pa.RecordBatch:
        table, cell, one, two, side, home, ids, sizes, vectors = rows
        new = np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in (table, cell, one, two)])))
        units = _units(vectors)
        i, j = _close_pairs(units, np.cumsum(new), one != two, side, cosine)
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, j = back[:len(i)], back[len(i):]
        ids, sizes, home, table = ids[used], sizes[used], home[used], table[used]
        if len(used):
            cells = np.stack([lattice.cells(units[used], t) for t in range(lattice.tables)])
            here = _counts_here(cells, table, home, ids, i, j)
            i, j = i[here], j[here]
        links = np.bincount(i, weights=sizes[j], minlength=len(ids)) + np.bincount(j, weights=sizes[i], minlength=len(ids))
        linked = np.flatnonzero(links)
        least = _least_reachable(len(ids), i, j)
        hung = np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([ids[linked], ids[hung]]), pa.int64()),
            pa.array(np.concatenate([ids[linked], ids[least[hung]]]), pa.int64(), mask=np.arange(len(linked) + len(hung)) < len(linked)),
            pa.array(np.concatenate([links[linked].astype(np.int64), np.zeros(len(hung), dtype=np.int64)]), pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)] + [_matrix(batch.column(8), lattice.size)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            # the last piece may go on in the next batch; a piece is two blocks at most
            cut = int(np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in rows[:4]]))))[-1])
            kept = [x[cut:] for x in rows]
            if cut:
                yield judged([x[:cut] for x in rows])
        if kept is not None:
            yield judged(kept)

    order = ["table", "cell", "one", "two"]
    return pieces.repartition(*order).sortWithinPartitions(*order).select(*order, "side", "home", "id", "size", "vector").mapInArrow(run, schema)


def _floating(df: DataFrame, vector: str) -> bool:
    """Are the components float or double?  Those are kept as they are."""
    return isinstance(df.schema[vector].dataType.elementType, (T.FloatType, T.DoubleType))


def near_links(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, lattice: dict | None = None, block: int = BLOCK,
) -> DataFrame:
    """``key``, ``n_links`` (other rows linked directly), ``component`` (least key that links reach) for every row of ``df``.

    Every link has the cosine or more; ``lattice`` sets fields of ``Lattice``.  A key may be null or repeat: each row counts.
    """
    v = F.col(vector)
    if not _floating(df, vector):
        v = v.cast("array<double>")
    good = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0),
        F.lit(False))
    given = df.select(F.col(key).alias("key"), F.when(good, v).alias("vector"))
    entries = materialise(
        given.where(F.col("vector").isNotNull()).groupBy("vector").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("least"))
        .withColumn("id", F.monotonically_increasing_id()))
    lengths = [r[0] for r in entries.select(F.size("vector")).distinct().collect()]
    found = None
    for size in sorted(lengths):
        more = _linked(entries.where(F.size("vector") == size).select("id", "vector", "size"), Lattice(size, **(lattice or {})), cosine, block)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return given.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    found = materialise(found)
    counts = found.where(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    roots = connected(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "id")
    placed = entries.join(counts, "id", "left").join(roots, "id", "left").select(
        "vector", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(placed.join(least, "root").select("vector", "n_links", "component"))
    return given.join(named, "vector", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component")).alias("component"))


def _linked(entries: DataFrame, lattice: Lattice, cosine: float, block: int) -> DataFrame:
    rows = materialise(_cell_rows(entries, lattice))
    sizes = rows.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("any_home")).where(
        (F.col("members") > 1) & F.col("any_home")).withColumn("blocks", F.ceil(F.col("members") / F.lit(block)).cast("int"))
    shared = rows.join(materialise(sizes.drop("any_home")), ["table", "cell"])
    # a member of block m works in the pairs (m, m), (m, later) and (earlier, m); side 1 is the later block of a pair
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(F.col("mine"), k).alias("one"), F.greatest(F.col("mine"), k).alias("two"), F.when(F.col("mine") > k, 1).otherwise(0).alias("side")))
    pieces = (
        shared.withColumn("mine", mine).select("table", "cell", "home", "id", F.inline(pairs))
        .join(entries, "id").select("table", "cell", "one", "two", "side", "home", "id", "size", "vector")
    )
    return _work(pieces, lattice, cosine)
