"""Removal of repeated passages by prefix-free parsing.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else in the corpus goes.

Parsing.  The hash of a few bytes rolls over the text.  Of each run of ``WINDOWS`` hash positions the least (the rightmost of
equal ones) is a trigger.  A start of a string of ``length`` bytes belongs to the trigger of the run that begins there, and
starts with one trigger are a phrase.  All this depends only on bytes inside the string, so equal strings have the same
trigger at the same place, wherever they are.

Classes.  The text from a phrase's first start to the end of its last string is the phrase's class.  Phrases of a class that
occurs twice are repeated as a whole.  Phrases whose context right of the trigger is unique can't hold a repeated string
and are left out before anything else is compared.

Corpus order.  For the rest one phrase of each class is compared.  The bytes left of the trigger are the dictionary; its
suffixes are ranked from the trigger outward, a suffix by its first byte and the rank of what follows.  The bytes right of
the trigger are the parse; its suffixes are sorted, with the lengths that neighbours share.  Together the two ranks give the
order of all strings in the corpus, and a string is repeated if it shares ``length`` bytes with a neighbour that has the same
dictionary suffix.  Contexts are dealt over tasks by hash and each task orders a bounded number at a time.  A context
that very many classes share isn't ordered in one task: its strings are named by a 128-bit hash and counted.

Null texts are empty.  Texts shorter than ``length`` lose nothing.  Rows that repeat a key or a text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.session import materialise

CHUNK = 1 << 20  # bytes that are parsed at a time
CROWD = 2000  # classes of one context that one task orders
ORDERED = 16_000  # classes that a task orders at a time, besides those of the last context
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(32)


class Shape:
    """Sizes that follow from the length of the strings."""

    def __init__(self, length: int):
        if length < 4:
            raise ValueError("strings of four bytes at least")
        self.length = length
        self.gram = min(16, max(1, length // 4))
        self.windows = 1 << ((length - self.gram) * 4 // 5).bit_length() - 1
        self.right = length - self.windows + 1  # so many bytes from the trigger on lie in each of its strings


def triggers(data: bytes, shape: Shape) -> np.ndarray:
    """For each start of ``data`` that has a whole string, the place of its trigger."""
    n = len(data) - shape.length + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    m = n + shape.windows - 1
    padded = data + bytes(16)
    g = min(8, shape.gram)
    mask = np.uint64((1 << 8 * g) - 1)
    first = np.ndarray((m,), dtype="<u8", buffer=padded, strides=(1,)) & mask
    last = np.ndarray((m,), dtype="<u8", buffer=padded, offset=shape.gram - g, strides=(1,)) & mask
    h = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (last + (first >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    low = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))  # equal hashes: the rightmost is the least
    reach = 1
    while reach < shape.windows:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return (_LOW - (low & _LOW)).astype(np.int64)


def phrases(data: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of each phrase; long texts are parsed piece by piece."""
    out = []
    for at in range(0, max(len(data) - shape.length + 1, 0), CHUNK):
        t = triggers(data[at:at + CHUNK + shape.length - 1], shape)
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        out.append((first + at, np.append(first[1:], len(t)) - 1 + at, t[first] + at))
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _signed(values) -> np.ndarray:
    return np.fromiter(values, dtype=np.uint64).view(np.int64)


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _groups_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes]]]:
    """(row, text) of a batch, in lists of about ``CHUNK`` bytes."""
    group, held = [], 0
    for row, text in enumerate(batch.column(1).to_pylist()):
        group.append((row, text))
        held += len(text)
        if held >= CHUNK:
            yield group
            group, held = [], 0
    if group:
        yield group


def _parse(df: DataFrame, shape: Shape, only_contexts: bool) -> DataFrame:
    """One row per phrase: the hash of its context and, unless only that is wanted, of its class, and where it is."""
    fields = [T.StructField("context", T.LongType())]
    if not only_contexts:
        fields += [T.StructField("class", T.LongType()), T.StructField("key", df.schema["key"].dataType), T.StructField("text_hash", T.LongType()),
                   T.StructField("start", T.LongType()), T.StructField("left", T.IntegerType()), T.StructField("more", T.IntegerType())]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    length, right = shape.length, shape.right
    hashed, named = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups_of(batch):
                # texts follow each other in one buffer; starts whose string would cross into the next one are left out
                data = b"".join([t for _, t in group])
                if len(group) == 1:
                    s, e, t = phrases(data, shape)
                    doc = np.zeros(len(s), dtype=np.int64)
                else:
                    sizes = np.array([len(x) for _, x in group], dtype=np.int64)
                    ends = np.cumsum(sizes)
                    at = triggers(data, shape)
                    of = np.repeat(np.arange(len(group)), sizes)[:len(at)]
                    here = np.flatnonzero(np.arange(len(at)) + length <= ends[of])
                    if not len(here):
                        continue
                    at, of = at[here], of[here]
                    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
                    s, e, t, doc = here[first], here[np.append(first[1:], len(here)) - 1], at[first], of[first]
                if not len(s):
                    continue
                places = list(zip(s.tolist(), e.tolist(), t.tolist()))
                columns = [pa.array(_signed(hashed(data[c:c + right]) for _, _, c in places))]
                if not only_contexts:
                    rows = np.array([r for r, _ in group])
                    begins = np.concatenate(([0], np.cumsum([len(x) for _, x in group])))[:-1]
                    texts = _signed(hashed(x) for _, x in group)
                    columns += [
                        pa.array(_signed(named(data[a:b + length], (c - a) << 20 | (b - a)) for a, b, c in places)),
                        batch.column(0).take(pa.array(rows[doc])), pa.array(texts[doc]), pa.array(s - begins[doc]),
                        pa.array((t - s).astype(np.int32)), pa.array((e - s).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def order_strings(rows: list[tuple[bytes, int, int]], shape: Shape) -> list[np.ndarray]:
    """For each row (text from first start to the end of the last string, bytes left of the trigger, starts after the
    first) a flag per start: is its string found in another row, or again in this one?"""
    n, length = len(rows), shape.length
    # parse: the texts from the trigger on, sorted, and what neighbours share
    rights = [text[left:] for text, left, _ in rows]
    order = sorted(range(n), key=rights.__getitem__)
    sizes = np.array([len(rights[i]) for i in order], dtype=np.int64)
    wide = int(sizes.max(initial=1))
    matrix = np.zeros((n, wide), dtype=np.uint8)
    for row, i in enumerate(order):
        matrix[row, :len(rights[i])] = np.frombuffer(rights[i], dtype=np.uint8)
    differ = np.ones((max(n - 1, 0), wide + 1), dtype=bool)
    differ[:, :wide] = matrix[1:] != matrix[:-1]
    shared = [np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))]
    while 2 << len(shared) - 1 < n:  # least value over runs of 1, 2, 4, ... neighbours
        step = 1 << len(shared) - 1
        shared.append(np.minimum(shared[-1][:-step], shared[-1][step:]))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts at ranks a < b share."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(shared[k][a[m]], shared[k][b[m] - (1 << int(k))])
        return out

    lefts = np.array([rows[i][1] for i in order], dtype=np.int64)
    mores = np.array([rows[i][2] for i in order], dtype=np.int64)
    farthest = int(lefts.max(initial=0))
    letters = np.zeros((n, farthest + 1), dtype=np.int64)  # letters[:, d]: the byte d places left of the trigger
    for row, i in enumerate(order):
        text, left, _ = rows[i]
        letters[row, 1:left + 1] = np.frombuffer(text[:left], dtype=np.uint8)[::-1]
    flags = np.zeros((n, farthest + 1), dtype=bool)
    rank = np.zeros(n, dtype=np.int64)  # dictionary: of the suffix that begins d places left of the trigger
    alive = np.arange(n)
    for d in range(farthest + 1):
        alive = alive[lefts[alive] >= d]
        if d:
            rank[alive] = np.unique(letters[alive, d] * (n + 1) + rank[alive], return_inverse=True)[1]
        here = alive[lefts[alive] - d <= mores[alive]]  # rows that have a start d places left of the trigger
        if len(here) < 2:
            continue
        here = here[np.argsort(rank[here], kind="stable")]  # equal suffixes in parse order
        a, b = here[:-1], here[1:]
        near = np.flatnonzero(rank[a] == rank[b])
        same = near[common(a[near], b[near]) >= length - d]
        flags[a[same], d] = True
        flags[b[same], d] = True
    out: list[np.ndarray] = [np.empty(0, dtype=bool)] * n
    for row, i in enumerate(order):
        left, more = int(lefts[row]), int(mores[row])
        out[i] = flags[row, left - more:left + 1][::-1]
    return out


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


_PLACE = [T.StructField("text_hash", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]


def _ordered(strings: DataFrame, shape: Shape) -> DataFrame:
    """Repeated starts (key, text_hash, first, last) of the classes in ``strings``, by their order in the corpus."""
    schema = T.StructType([strings.schema["key"], *_PLACE])
    arrow = to_arrow_schema(schema)

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        flags = order_strings([(r[5], r[3], r[4]) for r in rows], shape)
        out = [(r[1], r[2], r[6] + a, r[6] + b) for r, f in zip(rows, flags) for a, b in _intervals(f)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) >= ORDERED and held[-1][0] != row[0]:
                    yield judged(held)
                    held = []
                held.append(row)
        if held:
            yield judged(held)

    rows = strings.repartition("context").sortWithinPartitions("context")
    return rows.select("context", "key", "text_hash", "left", "more", "content", "start").mapInArrow(run, schema)


def _counted(strings: DataFrame, shape: Shape) -> DataFrame:
    """The same for classes of crowded contexts: every string is named by a hash, and names are counted."""
    schema = T.StructType([
        T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), strings.schema["key"], *_PLACE[:2]])
    arrow = to_arrow_schema(schema)
    length = shape.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            for at in range(0, len(rows), 256):
                names, out = [], []
                for key, text, start, content in rows[at:at + 256]:
                    for i in range(len(content) - length + 1):
                        names.append(xxhash.xxh3_128_digest(content[i:i + length]))
                        out.append((key, text, start + i))
                halves = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                    *[pa.array([x[k] for x in out], arrow.field(2 + k).type) for k in range(3)]], schema=arrow)

    named = materialise(strings.select("key", "text_hash", "start", "content").mapInArrow(run, schema))
    often = materialise(named.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"))
    return named.join(often, ["one", "two"], "left_semi").select("key", "text_hash", "first", F.col("first").alias("last"))


def _same_row(a: DataFrame, b: DataFrame):
    return a["key"].eqNullSafe(b["key"]) & (a["text_hash"] == b["text_hash"])


def repeated_starts(texts: DataFrame, shape: Shape, crowd: int = CROWD) -> DataFrame:
    """``text_hash``, ``key``, ``first`` and ``last``: ranges of starts of repeated strings, each range once per text and key.

    ``texts`` has ``key`` and ``text`` (binary, not null).
    """
    contexts = _parse(texts, shape, True)
    often = materialise(contexts.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n"))
    found = materialise(_parse(texts, shape, False).join(often, "context"))
    classes = materialise(found.groupBy("context", "class").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "text_hash", "start", "left", "more")).alias("one")))
    several = materialise(classes.where(F.col("n") > 1).select("context", "class"))
    whole = found.join(several, ["context", "class"], "left_semi").select(
        "key", "text_hash", F.col("start").alias("first"), (F.col("start") + F.col("more")).alias("last"))

    # contexts with a class that occurs once: one phrase of each of their classes, with its text
    open_contexts = materialise(classes.groupBy("context").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where(
        (F.col("least") == 1) & (F.col("classes") > 1)).select("context", "classes"))
    picked = classes.join(open_contexts, "context").select("context", "classes", "n", "one.*")
    per_text = materialise(picked.groupBy("key", "text_hash").agg(F.collect_list(F.struct("context", "classes", "n", "start", "left", "more")).alias("list")))
    packed = _packed(texts)
    strings = materialise(_cut_out(packed.join(per_text, _same_row(packed, per_text)).select(
        packed["key"], packed["text_hash"], "packed", "list"), shape))
    calm = _ordered(strings.where(F.col("classes") <= crowd), shape)
    crowded = _counted(strings.where(F.col("classes") > crowd), shape)
    return whole.unionByName(calm).unionByName(crowded)


def _packed(texts: DataFrame, *others: str) -> DataFrame:
    """Texts compressed before they are shuffled, with the hash that tells texts of one key apart."""
    rest = [texts.schema[c] for c in others]
    schema = T.StructType([texts.schema["key"], T.StructField("text_hash", T.LongType()), T.StructField("packed", T.BinaryType()), *rest])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            content = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(_signed(xxhash.xxh3_64_intdigest(t) for t in content)), pa.array([pack(t) for t in content], pa.binary()),
                *batch.columns[2:]], schema=arrow)

    return texts.select("key", "text", *others).mapInArrow(run, schema)


def _cut_out(rows: DataFrame, shape: Shape) -> DataFrame:
    schema = T.StructType([
        T.StructField("context", T.LongType()), T.StructField("classes", T.LongType()), T.StructField("n", T.LongType()), rows.schema["key"],
        T.StructField("text_hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("left", T.IntegerType()),
        T.StructField("more", T.IntegerType()), T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for key, text_hash, packed, wanted in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns]):
                    text = unpack(packed)
                    out += [(p["context"], p["classes"], p["n"], key, text_hash, p["start"], p["left"], p["more"],
                             text[p["start"]:p["start"] + p["more"] + shape.length]) for p in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings at these ranges of starts cover."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def cut_repeats(
    df: DataFrame, length: int = 200, *, key: str = "doc_id", text: str = "text", others: list[str] | None = None,
    whole_characters: bool = False, crowd: int = CROWD,
) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (start and end of removed runs), ``kept`` (binary, what is left) and the columns ``others``.

    With ``whole_characters`` a character goes only if all its bytes do, so that ``kept`` stays UTF-8.
    """
    shape, others = Shape(length), others or []
    texts = _texts(df, key, text)
    starts = repeated_starts(texts, shape, crowd).distinct()
    per_text = materialise(starts.groupBy("key", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    rest = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
                     *[F.col(c).alias(f"other_{i}") for i, c in enumerate(others)])
    names = [f"other_{i}" for i in range(len(others))]
    packed = _packed(rest, *names)
    joined = packed.join(per_text, _same_row(packed, per_text), "left").select(packed["key"], "packed", "ranges", *names)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([
        T.StructField("key", df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span),
        T.StructField("kept", T.BinaryType()), *[joined.schema[n] for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for content, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                content = unpack(content)
                runs, left, at = _spans(ranges or [], length), [], 0
                if whole_characters:
                    runs = [(a, b) for a, b in ((_forward(content, a), _back(content, b)) for a, b in runs) if a < b]
                for a, b in runs:
                    left.append(content[at:a])
                    at = b
                left.append(content[at:])
                n_bytes.append(len(content))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(left))
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, arrow.field(2).type), pa.array(kept, pa.binary()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = joined.mapInArrow(run, schema)
    return out.select(F.col("key").alias(key), "n_bytes", "spans", "kept", *[F.col(n).alias(c) for n, c in zip(names, others)])


def _forward(text: bytes, at: int) -> int:
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def _back(text: bytes, at: int) -> int:
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at
