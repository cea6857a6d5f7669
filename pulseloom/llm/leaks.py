"""Benchmark decontamination with the q-gram lemma.

Texts and benchmark items are compared without case and punctuation: A-Z are lower-cased, other ASCII characters than letters
and digits become spaces, runs of spaces one space.  A benchmark item is cut into windows of ``window`` bytes, one every
``step`` bytes and the last one; a shorter item is one window.  A document holds a window if some stretch of it differs from
the window by at most ``edits`` insertions, deletions and changes of bytes (in proportion for shorter windows).

By the lemma such a stretch shares at least ``window - q + 1 - edits * q`` of the window's q-grams, on diagonals (text position
minus window position) no more than ``edits`` apart.  So shared q-grams are counted in diagonal bands that overlap by half, and
only windows whose count in one band meets the bound are verified, by an alignment inside that band.

Equal windows, of one item or of several, are looked for once, and a text is gone through in pieces that meet at most about ``PAIRS``
pairs of equal q-grams.  So an item or a text that repeats itself takes time in proportion to its length, and bounded memory.

Null and empty texts hold nothing.  Items of fewer than ``q`` bytes give no evidence and are left out; equal items are found
under each of their ids.  The items are sent to the tasks in blocks of at most ``BLOCK`` bytes, each with a pass of its own, so a
large benchmark means more passes, never a larger broadcast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.texts import keyed_texts, map_rows

BLOCK = 4 << 20
CHUNK = 1 << 20
PAIRS = 1 << 18
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_GONE = b"\0"  # no normalised text has it


@dataclass(frozen=True)
class Rule:
    window: int = 80
    edits: int = 6
    q: int = 10
    step: int = 8

    def __post_init__(self):
        if not 8 <= self.q <= 16 or self.bound(self.window, self.edits) < 1:
            raise ValueError("q from 8 to 16, and a window whose bound is at least one")

    def bound(self, size: int, edits: int) -> int:
        return size - self.q + 1 - edits * self.q

    def windows(self, size: int) -> tuple[list[int], int, int]:
        """Starts, length and edit budget of the windows of an item."""
        if size < self.q:
            return [], 0, 0
        if size <= self.window:
            return [0], size, min(self.edits * size // self.window, (size - self.q) // self.q)
        return sorted({*range(0, size - self.window, self.step), size - self.window}), self.window, self.edits


def normalise(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


def raw_place(text: bytes, place: int) -> int:
    """Where in ``text`` the byte at ``place`` of its normalised form lies."""
    seen, space = 0, True
    for at in range(0, len(text), CHUNK):
        part = np.frombuffer(text[at:at + CHUNK].translate(_PLAIN), dtype=np.uint8)
        blank = part == 32
        keep = ~blank | ~np.concatenate(([space], blank[:-1]))
        if seen + int(keep.sum()) > place:
            return at + int(np.flatnonzero(keep)[place - seen])
        seen, space = seen + int(keep.sum()), bool(blank[-1])
    return len(text)


def _grams(data: bytes, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    first = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    last = np.ndarray((n,), dtype="<u8", buffer=data, offset=q - 8, strides=(1,))
    h = first * np.uint64(0x9E3779B97F4A7C15)
    h ^= last * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def banded(windows: np.ndarray, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each window (row) and a stretch of its text that begins on one of ``width`` diagonals and stays on
    them, and the diagonal where the best one ends.  Row ``k`` of ``texts`` starts at the first diagonal."""
    rows, size = windows.shape
    inserts = np.arange(width)
    cost = np.zeros((rows, width), dtype=np.int64)
    for i in range(size):
        step = cost + (texts[:, i:i + width] != windows[:, i:i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a byte of the window is missing
        cost = np.minimum.accumulate(step - inserts, axis=1) + inserts  # bytes of the text are extra
    at = cost.argmin(axis=1)
    return cost[np.arange(rows), at], at


class Index:
    """The q-grams of a block of items and where they stand."""

    def __init__(self, items: list[bytes], rule: Rule):
        self.items, self.rule = items, rule
        self.plans = [rule.windows(len(t)) for t in items]
        # all windows, by item and start, and the first window that is equal to each
        self.window_item = np.repeat(np.arange(len(items)), [len(starts) for starts, _, _ in self.plans])
        self.window_start = np.array([s for starts, _, _ in self.plans for s in starts], dtype=np.int64)
        first: dict[bytes, int] = {}
        equal = np.array([
            first.setdefault(hashlib.blake2b(items[i][s:s + self.plans[i][1]], digest_size=16).digest(), k)
            for k, (i, s) in enumerate(zip(self.window_item.tolist(), self.window_start.tolist()))], dtype=np.int64)
        self.by_equal = np.argsort(equal, kind="stable")
        self.equal = equal[self.by_equal]
        chosen = np.flatnonzero(equal == np.arange(len(equal)))
        self.chosen = np.split(chosen, np.searchsorted(self.window_item[chosen], np.arange(1, len(items)))) if items else []

        grams, covered = [_grams(t, rule.q) for t in items], []
        for windows, found, (_, size, _) in zip(self.chosen, grams, self.plans):
            edge = np.zeros(len(found) + 1, dtype=np.int64)
            np.add.at(edge, self.window_start[windows], 1)
            np.add.at(edge, self.window_start[windows] + max(size - rule.q + 1, 0), -1)
            covered.append(np.flatnonzero(np.cumsum(edge[:-1]) > 0))
        values = np.concatenate([*[g[c] for g, c in zip(grams, covered)], np.empty(0, dtype=np.uint64)])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.item = np.repeat(np.arange(len(items)), [len(c) for c in covered])[order]
        self.place = np.concatenate([*covered, np.empty(0, dtype=np.int64)]).astype(np.int64)[order]
        self.begins = np.cumsum([0, *[len(t) for t in items]])
        self.shift = np.uint64(64 - min(26, max(12, (16 * len(values)).bit_length())))
        self.seen = np.zeros(1 << int(np.uint64(64) - self.shift), dtype=bool)
        self.seen[self.values >> self.shift] = True
        sized = [(size, edits) for starts, size, edits in self.plans if starts]
        self.least = min((rule.bound(size, edits) for size, edits in sized), default=1)
        self.reach = max((size + edits for size, edits in sized), default=0)

    def find(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(window, edits, first, last place in ``data``) of every place where ``data`` holds a window, the first of equal ones; a
        place may come twice, and its beginning may be off by the edits."""
        grams = _grams(data, self.rule.q)
        hits = np.flatnonzero(self.seen[grams >> self.shift])
        if len(hits) < self.least:
            return []
        # only hits in a stretch with enough of them, whatever the diagonal
        after = np.searchsorted(hits, hits + self.reach - self.rule.q, side="right")
        dense = np.flatnonzero(after - np.arange(len(hits)) >= self.least)
        if not len(dense):
            return []
        edge = np.zeros(len(hits) + 1, dtype=np.int64)
        np.add.at(edge, dense, 1)
        np.add.at(edge, after[dense], -1)
        hits = hits[np.cumsum(edge[:-1]) > 0]
        low, high = np.searchsorted(self.values, grams[hits], "left"), np.searchsorted(self.values, grams[hits], "right")
        there = high > low
        hits, low, n = hits[there], low[there], (high - low)[there]
        pairs, found, at = np.cumsum(n), [], 0
        widest = self.reach + 2 * max((e for _, _, e in self.plans), default=0) + 2
        while at < len(hits):  # windows that begin in this piece; it reads on as far as they can go
            end = int(np.searchsorted(pairs, pairs[at] - n[at] + PAIRS, "right"))
            end = max(end, int(np.searchsorted(hits, hits[at] + 4 * widest, "left")))
            to = int(np.searchsorted(hits, hits[min(end, len(hits)) - 1] + widest, "right"))
            many = n[at:to]
            where = np.repeat(hits[at:to], many)
            entry = np.repeat(low[at:to] - np.cumsum(many) + many, many) + np.arange(len(where))
            found += self._verified(data, self.item[entry], where - self.place[entry], self.place[entry])
            at = end if to < len(hits) else len(hits)
        return found

    def _verified(self, data, item, diagonal, place):
        if not len(item):
            return []
        block = diagonal // np.array([e + 1 for _, _, e in self.plans], dtype=np.int64)[item]
        # every hit counts in two bands: the one that begins with its block of diagonals and the one before
        lowest, total = int(block.min()) - 1, int(self.begins[-1])
        key = (block - lowest) * total + self.begins[item] + place
        band, place = np.divmod(np.unique(np.concatenate([key, key - total])), total)
        item = np.searchsorted(self.begins, place, "right") - 1
        place -= self.begins[item]
        first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
        sizes = np.diff(np.append(first, len(item)))
        wanted = []
        for at, n in zip(first[sizes >= self.least].tolist(), sizes[sizes >= self.least].tolist()):
            which, where = int(item[at]), int(band[at]) + lowest
            _, size, edits = self.plans[which]
            places, windows = place[at:at + n], self.chosen[which]
            begin = self.window_start[windows]
            count = np.searchsorted(places, begin + size - self.rule.q, "right") - np.searchsorted(places, begin, "left")
            wanted += [(which, where, k) for k in windows[count >= self.rule.bound(size, edits)].tolist()]
        out = []
        text = np.frombuffer(data, dtype=np.uint8)
        by_plan: dict[tuple[int, int], list] = {}
        for w in wanted:
            by_plan.setdefault(self.plans[w[0]][1:], []).append(w)
        for (size, edits), group in by_plan.items():
            width = 2 * (edits + 1)
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                starts = self.window_start[[k for _, _, k in part]]
                begins = starts + np.array([b * (edits + 1) for _, b, _ in part])
                windows = np.stack([np.frombuffer(self.items[i][s:s + size], dtype=np.uint8) for (i, _, _), s in zip(part, starts.tolist())])
                places = begins[:, None] + np.arange(size + width)
                inside = (places >= 0) & (places < len(text))
                texts = np.where(inside, text[np.clip(places, 0, len(text) - 1)], 0)
                cost, at_diagonal = banded(windows, texts, width)
                for (_, _, k), c, d, b in zip(part, cost.tolist(), at_diagonal.tolist(), begins.tolist()):
                    if c <= edits:
                        out.append((k, c, max(b + d, 0), min(b + d + size, len(text))))
        return out

    def documents(self, texts: list[bytes | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """Per text the (item, windows held, least edits, first and last byte of the passage)."""
        found: list[dict] = [{} for _ in texts]

        def note(row: int, window: int, cost: int, first: int, last: int) -> None:
            least, a, b = found[row].get(window, (cost, first, last))
            found[row][window] = (min(least, cost), min(a, first), max(b, last))

        def by_item(held: dict) -> dict[int, tuple[int, int, int, int]]:
            """The windows held, all that are equal to a found one counted, by item."""
            out: dict[int, tuple[int, int, int, int]] = {}
            for window, (cost, first, last) in held.items():
                same = self.by_equal[np.searchsorted(self.equal, window, "left"):np.searchsorted(self.equal, window, "right")]
                for item, n in zip(*(x.tolist() for x in np.unique(self.window_item[same], return_counts=True))):
                    count, least, a, b = out.get(item, (0, cost, first, last))
                    out[item] = (count + n, min(least, cost), min(a, first), max(b, last))
            return out

        overlap = self.reach + 2 * self.rule.edits + 2
        pending, held = [], 0

        def flush() -> None:
            gap = _GONE * max(self.rule.q, 1)
            begins = np.cumsum([0, *[len(t) + len(gap) for _, _, t in pending]])
            for window, cost, first, last in self.find(gap.join(t for _, _, t in pending)):
                k = int(np.searchsorted(begins, min(first + self.rule.edits, last - 1), "right")) - 1
                row, offset, part = pending[k]
                at = int(begins[k])
                note(row, window, cost, offset + max(first - at, 0), offset + min(last - at, len(part)))

        for row, text in enumerate(texts):
            plain = normalise(text) if text else b""
            for at in range(0, max(len(plain) - overlap, 1), CHUNK):
                part = plain[at:at + CHUNK + overlap]
                if len(part) < self.rule.q:
                    continue
                pending.append((row, at, part))
                held += len(part)
                if held >= CHUNK:
                    flush()
                    pending, held = [], 0
        if pending:
            flush()
        return [
            [(item, n, least, raw_place(texts[row], a), raw_place(texts[row], b - 1) + 1)
             for item, (n, least, a, b) in sorted(by_item(held).items())] for row, held in enumerate(found)]


_INDEXES: dict[str, Index] = {}


def _index(items: list[bytes], rule: Rule) -> Index:
    """Built once per Python worker."""
    name = hashlib.sha256(repr((items, rule)).encode()).hexdigest()
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items, rule)
    return _INDEXES[name]


def _blocks(benchmark: DataFrame, key: str, text: str, block: int) -> list[tuple[list, list[bytes]]]:
    """Ids and normalised texts of the items, in blocks of at most about ``block`` bytes."""
    items = benchmark.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block)) if total > block else 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r["key"] is None, r["key"] if r["key"] is not None else 0, bytes(r["text"])))
        if rows:
            yield [r["key"] for r in rows], [normalise(bytes(r["text"])) for r in rows]


def find_leaks(
    df: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", block: int = BLOCK,
) -> DataFrame:
    """``key``, ``item_key``, ``n_windows`` (windows of the item that the text holds), ``n_edits`` (of the nearest), ``first`` and
    ``last`` (bytes of the passage in the text): one row per row of ``df`` and item of which it holds a window."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType),
        T.StructField("n_windows", T.LongType()), T.StructField("n_edits", T.LongType()), T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType())])
    rows = keyed_texts(df, key, text).withColumn("_text", F.col("_text").cast("binary"))
    parts = []
    for ids, items in _blocks(benchmark, item_key, item_text, block):
        def work(keys, texts, ids=ids, items=items):
            held = _index(items, rule).documents(texts.to_pylist())
            flat = [(row, *h) for row, found in enumerate(held) for h in found]
            columns = [keys.take(pa.array([f[0] for f in flat], pa.int64())), [ids[f[1]] for f in flat]]
            return [*columns, *[[f[k] for f in flat] for k in range(2, 6)]]

        parts.append(map_rows(rows, work, schema))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], schema)


def without_leaks(
    df: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), *, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``df`` whose text holds no window of the benchmark, all columns as they are."""
    at = df.columns.index(text)
    for _, items in _blocks(benchmark, item_key, item_text, block):
        def work(*columns, items=items):
            texts = columns[at].cast(pa.binary()).to_pylist()
            clean = pa.array([not held for held in _index(items, rule).documents(texts)], pa.bool_())
            return [c.filter(clean) for c in columns]

        df = map_rows(df, work, df.schema)
    return df
