"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, words padded with a
boundary), most frequent first.  A document gets such a list of its own, and the language whose list is nearest: the
out-of-place distance adds up how far each n-gram of the document stands from its place in the profile, and a full
profile's length for n-grams that the profile lacks.

Letters are lower-cased one by one.  Letters that no profile holds are one symbol.  Equal counts are ordered by n-gram
length, then alphabetically; equal distances by language name.  A null text, or one without a letter, is ``und`` with
score 0, and so is every text if nothing was learned.  The score is 1 minus the distance over its largest value.

Learning reads a bounded sample (``per_language`` rows of each language, those with the least hash of their key) and
collects one list per language; prediction reads every whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.texts import keyed_texts, map_rows

UNKNOWN = "und"
BOUNDARY = "_"


def words_of(text: str) -> list[str]:
    """Runs of letters, each letter lower-cased for itself."""
    return "".join(_lower(c) if c.isalpha() else " " for c in text).split(" ")


def _lower(letter: str) -> str:
    low = letter.lower()
    return low if len(low) == 1 else letter


def grams_of(word: str) -> list[str]:
    padded = BOUNDARY + word + BOUNDARY
    return [*word, *[padded[i:i + 2] for i in range(len(padded) - 1)], *[padded[i:i + 3] for i in range(len(padded) - 2)]]


@dataclass(frozen=True)
class Profiles:
    """Per language its n-grams, most frequent first; ``length`` places are kept, and a document uses ``document_length``."""

    ranked: dict[str, tuple[str, ...]]
    length: int
    document_length: int

    @cached_property
    def languages(self) -> list[str]:
        return sorted(self.ranked)

    @cached_property
    def letters(self) -> list[str]:
        return sorted({c for grams in self.ranked.values() for g in grams for c in g if c != BOUNDARY})

    @cached_property
    def symbols(self) -> np.ndarray:
        """Symbol of each code point: 0 for no letter, 1.. for the letters of the profiles, one more for all others."""
        known = {c: i for i, c in enumerate(self.letters, 1)}
        table = np.zeros(0x110000, dtype=np.uint32)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                table[point] = known.get(_lower(c), len(known) + 1)
        return table

    @cached_property
    def radix(self) -> int:
        return len(self.letters) + 2

    def code(self, gram: str) -> int:
        known = {c: i for i, c in enumerate(self.letters, 1)}
        value = 0
        for c in gram:
            value = value * self.radix + (0 if c == BOUNDARY else known[c])
        return len(gram) * self.radix ** 3 + value

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-gram codes of the profiles, sorted, and per language the place of each (``length``: not in it)."""
        codes = {g: self.code(g) for grams in self.ranked.values() for g in grams}
        ordered = sorted(codes, key=codes.__getitem__)
        column = {g: i for i, g in enumerate(ordered)}
        places = np.full((len(self.languages), len(ordered)), self.length, dtype=np.int64)
        for row, language in enumerate(self.languages):
            for place, gram in enumerate(self.ranked[language]):
                places[row, column[gram]] = place
        return np.array([codes[g] for g in ordered], dtype=np.uint64), places

    def top_codes(self, text: str) -> np.ndarray:
        """Codes of the text's most frequent n-grams, most frequent first."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = self.symbols[points]
        letter = found > 0
        if not letter.any():
            return np.empty(0, dtype=np.uint64)
        s = np.zeros(len(found) + 2, dtype=np.uint64)
        s[1:-1] = found
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        s = s[keep]
        r = np.uint64(self.radix)
        cube = r * r * r
        two, mid = s[:-1] * r + s[1:], s[1:-1] > 0
        codes = np.concatenate([cube + s[s > 0], np.uint64(2) * cube + two, np.uint64(3) * cube + (two[:-1] * r + s[2:])[mid]])
        if 4 * self.radix ** 3 < 1 << 32:
            codes = codes.astype(np.uint32)  # sorts faster
        codes.sort()
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        counts = np.diff(np.append(first, len(codes)))
        return codes[first[np.argsort(-counts, kind="stable")[:self.document_length]]].astype(np.uint64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        top = self.top_codes(text)
        if not len(top):
            return UNKNOWN, 0.0
        codes, places = self.places
        at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
        place = np.where(codes[at] == top, places[:, at], self.length)
        off = np.where(place == self.length, self.length, np.abs(place - np.arange(len(top))))
        distances = off.sum(axis=1)
        best = int(np.argmin(distances))
        worst = len(top) * max(self.length, self.document_length)
        return self.languages[best], max(0.0, 1.0 - float(distances[best]) / worst)


_KEPT: dict[tuple, Profiles] = {}


def shared(profiles: Profiles) -> Profiles:
    """The same profiles with their tables, kept by the Python worker between tasks."""
    key = (tuple(profiles.ranked.items()), profiles.length, profiles.document_length)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = profiles
    return _KEPT[key]


def learn(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1000,
    length: int = 400, document_length: int = 400,
) -> Profiles:
    """Profiles from at most ``per_language`` labelled rows of each language; rows with a null text or label are left out.

    The number of languages is taken to be small: the driver gets ``length`` n-grams of each.
    """
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where(
        F.col("_text").isNotNull() & F.col("_lang").isNotNull()).withColumn("_hash", F.xxhash64("_key"))
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({}, length, document_length)
    # a first cut by hash, generous enough to leave per_language rows, so that few rows are ranked
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (2.0 * per_language + 100) / n))])
    near = rows.where(F.pmod(F.col("_hash"), F.lit(1 << 32)) < F.element_at(share, F.col("_lang")) * float(1 << 32))
    order = Window.partitionBy("_lang").orderBy("_hash", "_key", "_text")
    sample = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).select("_lang", "_text")

    def count(langs, texts):
        totals: dict[str, Counter] = {}
        for language, content in zip(langs.to_pylist(), texts.to_pylist()):
            total = totals.setdefault(language, Counter())
            for word, n in Counter(words_of(content)).items():
                if word:
                    for gram in grams_of(word):
                        total[gram] += n
        out = [(language, gram, n) for language, total in totals.items() for gram, n in total.items()]
        return [[r[i] for r in out] for i in range(3)]

    counted = map_rows(sample, count, T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())]))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), F.length("gram"), "gram")
    best = (
        counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= length)
    )
    ranked: dict[str, list[tuple[int, str]]] = {}
    for r in best.collect():
        ranked.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return Profiles({k: tuple(g for _, g in sorted(v)) for k, v in ranked.items()}, length, document_length)


def predict(df: DataFrame, profiles: Profiles, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every whole text."""
    def work(keys, texts):
        own = shared(profiles)
        found = [own.predict(t) for t in texts.to_pylist()]
        return keys, [f[0] for f in found], [f[1] for f in found]

    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_rows(keyed_texts(df, key, text), work, schema)


def keep_known(df: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a language (not ``und``), all columns as they are."""
    at = df.columns.index(text)

    def work(*columns):
        own, texts = shared(profiles), columns[at].to_pylist()
        known = np.array([own.predict(t)[0] != UNKNOWN for t in texts], dtype=bool)
        mask = pa.array(known)
        return [c.filter(mask) for c in columns]

    return map_rows(df, work, df.schema)
