"""Quality rules: a hashed n-gram classifier, calibrated, behind fixed base rules.

Words are runs without ASCII white space (space, tab to carriage return).  Base rules look at a text by itself: characters in
words, symbols of ``#*$%&|<>``, lines that repeat an earlier line (whole lines between ``\\n``, with a word in them), and
words inside windows of eight words that stand more than once in the text.  Windows are compared by ranks of their words,
doubled three times, so equal ranks are equal words.  A text fails with fewer than 20 words or with more than 30 percent
repeated words.

The classifier is a logistic regression on words, pairs of neighbouring words and byte sequences of three to five bytes, each hashed to one of
2^``bits`` places.  A text's features are shares: how often a place is met over all n-grams of its kind.  Shares depend
on the kind of text and not on its length, and the score is a mean of weights, so a text of any length is scored in pieces
of bounded size.  It is trained with Spark's own logistic regression on a bounded sample of labelled rows (``per_class``
of each label, those with the least hash of their id); a fifth of them, told by another hash, is not trained on but
calibrates: a second regression of one variable turns margins into probabilities (Platt).  A text is kept if its
probability of being good reaches ``threshold`` and the base rules pass.

A null or empty text has no words and fails.  Without labelled rows of both kinds nothing is learned, the probability is
null and only the base rules decide.  Labels that repeat an id count once if they agree, and not at all if they don't.
Repeated rows of a document are judged one by one, each by its own text.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.texts import keyed_texts, map_rows
from pulseloom.session import materialise, scratch

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BYTES, WORDS = (3, 4, 5), (1, 2)  # lengths of the n-grams
PIECE = 1 << 20  # bytes of a text that are hashed at a time
SCALE = 30.0  # of the shares, so that weights have the size that regularisation expects

_BLANKS = b" \t\n\x0b\x0c\r"
_NO_CHARACTER = _BLANKS + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character
_EIGHT = np.uint64(8)
#: Odd factors, of hashes in windows and for the kinds (n: bytes, -n: words).
_FACTORS = {n: np.uint64(pow(0x9E3779B97F4A7C15, 2 * n + 5, 1 << 64)) for n in range(-2, 6)}


def _repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words covered by windows that occur at least twice."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h, width = hashes, 1
    while width < WINDOW:
        h = h[:-width] * _FACTORS[width] + h[width:]
        width *= 2
    if len(np.unique(h)) == len(h):  # different hashes: different windows
        return 0
    names: dict[bytes, int] = {}
    rank = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=n)
    width = 1
    while width < WINDOW:  # equal ranks: equal runs of ``width`` words
        rank = np.unique(rank[:-width] * n + rank[width:], return_inverse=True)[1]
        width *= 2
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def _read(text: str | None) -> tuple[bytes, list[bytes], np.ndarray]:
    """A text's bytes, its words and their hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() cuts at the same six characters
    return raw, words, np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)) * _FACTORS[0]


def base_counts(raw: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and repeated words of a text."""
    characters = len(raw.translate(None, _NO_CHARACTER))
    return len(words), characters, len(raw) - len(raw.translate(None, SYMBOLS)), _repeated_lines(raw), _repeated_words(words, hashes)


def _places(raw: bytes, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The kind of n-grams (from 0) and their places: the upper ``bits`` of a product of their codes.

    Long texts come in several pieces; every n-gram is in the piece in which it starts.
    """
    cut = np.uint64(64 - bits)
    data = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(data), PIECE):
        codes = wide = data[at:at + PIECE + max(BYTES) - 1].astype(np.uint64)
        for n in range(2, max(BYTES) + 1):
            codes = (codes[:-1] << _EIGHT) | wide[n - 1:]
            if n in BYTES:
                yield BYTES.index(n), ((codes[:PIECE] * _FACTORS[n]) >> cut).view(np.int64)
    for i, n in enumerate(WORDS, len(BYTES)):
        h = hashes[:max(len(hashes) - n + 1, 0)]
        for k in range(1, n):
            h = h * _FACTORS[1] + hashes[k:len(hashes) - n + 1 + k]
        yield i, ((h * _FACTORS[-n]) >> cut).view(np.int64)


def shares(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's features and their shares."""
    raw, _, hashes = _read(text)
    counts = np.zeros((len(BYTES) + len(WORDS), 1 << bits))
    for kind, places in _places(raw, hashes, bits):
        counts[kind] += np.bincount(places, minlength=1 << bits)
    total = SCALE * (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).sum(axis=0)
    places = np.flatnonzero(total)
    return places, total[places]


@dataclass(frozen=True)
class Model:
    """Weights of the places, and how a margin becomes a probability."""

    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def margin(self, raw: bytes, hashes: np.ndarray) -> float:
        bits = len(self.weights).bit_length() - 1
        sums, sizes = np.zeros(len(BYTES) + len(WORDS)), np.zeros(len(BYTES) + len(WORDS))
        for kind, places in _places(raw, hashes, bits):
            sums[kind] += self.weights[places].sum()
            sizes[kind] += len(places)
        return self.intercept + SCALE * float((sums / np.maximum(sizes, 1)).sum())

    def probability(self, raw: bytes, hashes: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(raw, hashes) + self.offset, -500, 500))))


def _agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``_key`` and ``_good`` (0.0 or 1.0) of every id whose labels agree."""
    own = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_good"))
    own = own.where(F.col("_good").isin(0.0, 1.0) & F.col("_key").isNotNull())
    both = own.groupBy("_key").agg(F.min("_good").alias("_good"), F.max("_good").alias("_most"))
    return both.where(F.col("_good") == F.col("_most")).select("_key", "_good")


def _sample(documents: DataFrame, agreed: DataFrame, key: str, text: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each kind, those with the least hash, as ``key``, ``text`` and ``good``."""
    order = (F.xxhash64("_key"), F.col("_key"))
    picked = agreed.where("_good = 0").orderBy(*order).limit(per_class).unionByName(agreed.where("_good = 1").orderBy(*order).limit(per_class))
    # broadcast: at most 2 * per_class ids.  An id may stand in many rows, so rows are counted again.
    rows = keyed_texts(documents, key, text).where(F.col("_text").isNotNull()).join(F.broadcast(picked), "_key")
    rank = F.row_number().over(Window.partitionBy("_good").orderBy(*order, "_text"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= per_class).select(
        F.col("_key").cast("string").alias("key"), F.col("_text").alias("text"), F.col("_good").alias("good"))


def learn(
    documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    per_class: int = 1000, bits: int = 16, strength: float = 1e-4,
) -> Model | None:
    """The classifier from at most ``per_class`` labelled rows of each kind; None if one kind is missing.

    Probabilities are those of the labelled rows as they are mixed: calibration weighs each kind by its share of all labels.
    """
    def features(keys, texts, good):
        found = [shares(t.as_py(), bits) for t in texts]
        offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in found)]), pa.int32())
        return (keys, good, *(
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]), kind))
            for i, kind in ((0, pa.int32()), (1, pa.float64()))))

    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("good", T.DoubleType()), T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("shares", T.ArrayType(T.DoubleType()))])
    with scratch(documents.sparkSession) as keep:
        agreed = materialise(_agreed(labels, key, label))
        sizes = {r["_good"]: r["n"] for r in agreed.groupBy("_good").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            return None
        rows = keep(map_rows(_sample(documents, agreed, key, text, per_class), features, schema))
    sparse = F.udf(lambda places, values: Vectors.sparse(1 << bits, places, values), VectorUDT())
    held = F.pmod(F.crc32(F.concat(F.lit("held "), "key")), F.lit(5)) == 0
    parts = rows.select("good", held.alias("held"), sparse("places", "shares").alias("features"))
    found = {(r["held"], r["good"]): r["n"] for r in parts.groupBy("held", "good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not {(False, 0.0), (False, 1.0)} <= set(found):
        return None
    fitted = LogisticRegression(labelCol="good", regParam=strength, maxIter=40, standardization=False).fit(parts.where(~F.col("held")))
    model = Model(fitted.coefficients.toArray(), float(fitted.intercept), 1.0, 0.0)
    if not {(True, 0.0), (True, 1.0)} <= set(found):
        return model
    margins = fitted.transform(parts.where("held")).select(
        "good", array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)).alias("features"),
        F.when(F.col("good") == 1, sizes[1.0] / found[True, 1.0]).otherwise(sizes[0.0] / found[True, 0.0]).alias("weight"))
    platt = LogisticRegression(labelCol="good", weightCol="weight", regParam=1e-3, maxIter=100).fit(margins)
    return Model(model.weights, model.intercept, float(platt.coefficients[0]), float(platt.intercept))


def judge(
    documents: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5,
    least_words: int = 20, repeated_percent: int = 30,
) -> DataFrame:
    """``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``probability``
    and ``kept`` of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as many weights as there are buckets

    def work(keys, texts):
        own, out = shared.value, []
        for content in texts.to_pylist():
            raw, words, hashes = _read(content)
            counts = base_counts(raw, words, hashes)
            failed = counts[0] < least_words or 100 * counts[4] > repeated_percent * counts[0]
            good = None if own is None else own.probability(raw, hashes)
            out.append((*counts, failed, good, not failed and (good is None or good >= threshold)))
        return [keys, *([r[i] for r in out] for i in range(8))]

    whole = T.LongType()
    schema = T.StructType([
        T.StructField(key, documents.schema[key].dataType), *[T.StructField(n, whole) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return map_rows(keyed_texts(documents, key, text), work, schema)
