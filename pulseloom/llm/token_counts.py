"""Token counts of texts and of all their prefixes, by dynamic programming over prefixes.

The last token of the BPE encoding of a prefix is the only token that ends there and that stays next to
the last token of the prefix before it: the pair, merged for itself, gives the same two tokens.  So the
counts of all prefixes of a match follow from left to right, ``count[i] = count[i - len(last[i])] + 1``,
and truncation and budget questions are answered from the counts without encoding anything again.

Counts are those of the library that reads the file: texts are split by the byte-level pattern, strings of
special tokens inside a text count as one token each, and nothing is added, cut or padded.  Prefixes end
between characters.  Nulls and empty texts have no tokens.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulseloom.llm.bpe import merge
from pulseloom.llm.texts import keyed_texts, map_rows, splitter

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_space = regex.compile(r"\s+").fullmatch
_NEVER = 1 << 60
_CACHE = 600_000
_PAIRS = 300_000
_LONG_PIECE = 256
_CHARACTERS = 1_000_000  # of texts whose matches are counted together


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabularies of this kind use for each byte, and the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceCounts:
    """Counts for all byte prefixes of one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int], vocabulary: set[bytes]):
        self.ranks = ranks
        # a token that merging its own bytes does not give never ends a prefix
        self.tokens = {t for t in vocabulary if len(merge(t, ranks)) == 1}
        self.longest = max(map(len, vocabulary), default=1)
        self._edges: tuple[dict, dict] = ({}, {})
        self._pairs: dict[tuple[bytes, bytes], bool] = {}

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge gives ``token`` (of two bytes or more)."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that lie at the left (0) or right (1) end of ``token`` while it is merged, from one byte to
        all, each with the rank of the merge that ends it."""
        known = self._edges[side].get(token)
        if known is None:
            if len(token) == 1:
                known = [(token, _NEVER)]
            else:
                known = list(self.edge(self.halves(token)[side], side))
                known[-1] = (known[-1][0], self.ranks[token])
                known.append((token, _NEVER))
            self._edges[side][token] = known
        return known

    def stays(self, left: bytes, right: bytes) -> bool:
        """Does merging ``left + right`` give these two tokens?  True if no pair of parts that ever meet at the seam
        is merged before one of them grows."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: bytes, right: bytes) -> bool:
        xs, ys, i, j, rank = self.edge(left, 1), self.edge(right, 0), 0, 0, self.ranks.get
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            r = rank(x + y)
            if r is not None and r < x_ends and r <= y_ends:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def of(self, piece: bytes) -> list[int]:
        """``counts[i]``: tokens of the first ``i`` bytes, for ``i`` from 0 to the length."""
        counts, last = [0], [b""]
        self._extend(piece, counts, last)
        return counts

    def totals(self, pieces: list[bytes]) -> Iterator[int]:
        """Tokens of every piece.  Each goes on from the counts of the prefix that it shares with the piece before it, so sorted
        pieces share most of the work."""
        counts, last, before = [0], [b""], b""
        for piece in pieces:
            same, most = 0, min(len(piece), len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del counts[same + 1:], last[same + 1:]
            self._extend(piece, counts, last)
            before = piece
            yield counts[-1]

    def _extend(self, piece: bytes, counts: list[int], last: list[bytes]) -> None:
        tokens, longest, stays = self.tokens, self.longest, self.stays
        if len(self._pairs) > _PAIRS:
            self._pairs.clear()
        known = self._pairs.get
        for stop in range(len(counts), len(piece) + 1):
            for start in range(stop - longest if stop > longest else 0, stop):
                token = piece[start:stop]
                if token in tokens:
                    fits = not start or known((last[start], token))
                    if fits is None:
                        fits = stays(last[start], token)
                    if fits:
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends {piece[:stop]!r}")


class Counter:
    """Counts by a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are read")
        to_byte = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(map(to_byte.__getitem__, token))

        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(left + right), rank)
        vocabulary = {raw(t) for t in model["vocab"] if t not in special}
        self.pieces = PieceCounts(ranks, vocabulary)
        self.special = special
        self._special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = splitter(PATTERN)
        self._totals: dict[str, int] = {}

    def prefix(self, piece: str) -> list[int]:
        """Counts for all prefixes of one match, by number of characters."""
        counts = self.pieces.of(piece.encode("utf-8", "replace"))
        if len(counts) == len(piece) + 1:
            return counts
        return [counts[i] for i in accumulate((len(c.encode("utf-8", "replace")) for c in piece), initial=0)]

    def total(self, piece: str) -> int:
        known = self._totals.get(piece)
        if known is None:
            known = self.prefix(piece)[-1]
            if len(piece) <= _LONG_PIECE:
                if len(self._totals) > _CACHE:
                    self._totals.clear()
                self._totals[piece] = known
        return known

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """(part, is it a special string) from left to right."""
        found, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            if m.start() > at:
                found.append((text[at:m.start()], False))
            found.append((m.group(), True))
            at = m.end()
        if at < len(text):
            found.append((text[at:], False))
        return found

    def learn(self, texts: list[list[str]]) -> None:
        """Count the matches of several texts that were not counted before, each once and in order."""
        known = self._totals
        if len(known) > _CACHE:
            known.clear()
        new: dict[bytes, str] = {}
        for items in texts:
            totals = list(map(known.get, items))
            if None in totals:
                new.update((p.encode("utf-8", "replace"), p) for p, n in zip(items, totals) if n is None and len(p) <= _LONG_PIECE)
        for piece, n in zip(ordered := sorted(new), self.pieces.totals(ordered)):
            known[new[piece]] = n

    def cut(self, text: str | None) -> tuple[list[str], set[int]]:
        """The matches of a text and its special strings, and the places of the special strings."""
        items: list[str] = []
        places: set[int] = set()
        for part, special in self.parts(text or ""):
            if special:
                places.add(len(items))
                items.append(part)
            else:
                items += self.split(part)
        return items, places

    def tokens(self, items: list[str], places: set[int]) -> list[int]:
        """Tokens of each of what ``cut`` gives."""
        totals = list(map(self._totals.get, items))
        if places or None in totals:
            total = self.total
            totals = [1 if i in places else n if n is not None else total(p) for i, (p, n) in enumerate(zip(items, totals))]
        return totals

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last of its prefix counts."""
        return sum(self.tokens(*self.cut(text)))

    def prefixes(self, text: str | None) -> "PrefixCounts":
        items, places = self.cut(text)
        return PrefixCounts(self, text or "", items, self.tokens(items, places), places)


class PrefixCounts:
    """Exact counts of all prefixes of one text: sums up to each match, and the counts inside each match.

    A prefix that ends in white space has its whole last run of white space as one match; one that ends inside
    a contraction has its apostrophe and its letter as two.  One that ends inside a special string has the text from the
    last special string before it on cut anew; matches that were counted before are looked up.
    """

    def __init__(self, counter: Counter, text: str, items: list[str], totals: list[int], special: set[int]):
        self.counter, self.text, self.items, self.special = counter, text, items, special
        self.starts = list(accumulate(map(len, items), initial=0))
        self.sums = list(accumulate(totals, initial=0))
        self._inside: dict[int, list[int]] = {}

    def at(self, stop: int) -> int:
        """Tokens of the first ``stop`` characters."""
        if stop <= 0 or not self.items:
            return 0
        if stop >= len(self.text):
            return self.sums[-1]
        k = bisect_right(self.starts, stop - 1) - 1
        done = stop - self.starts[k]
        if k in self.special:
            if done == len(self.items[k]):
                return self.sums[k + 1]
            first = k
            while first and first - 1 not in self.special:
                first -= 1
            return self.sums[first] + self.counter.count(self.text[self.starts[first]:stop])
        if _space(self.items[k][:done]):
            first = k
            while first and first - 1 not in self.special and _space(self.items[first - 1]):
                first -= 1
            return self.sums[first] + self.counter.total(self.text[self.starts[first]:stop])
        if k not in self._inside:
            self._inside[k] = self.counter.prefix(self.items[k])
        piece = self.items[k]
        if piece[0] == "'" and 1 < done < len(piece) and piece[1].isalpha():
            return self.sums[k] + self.counter.total("'") + self.counter.total(piece[1:done])
        return self.sums[k] + self._inside[k][done]

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix up to which no prefix has more than ``budget`` tokens."""
        if budget < 0:
            return 0
        # a character has four bytes at most, and a byte at most a token: no match before this one can go over
        longest = 4 * max(map(len, self.items), default=0)
        k = max(0, bisect_right(self.sums, budget - longest) - 1)
        while k < len(self.items) and self.sums[k] + len(self.items[k].encode("utf-8", "replace")) <= budget:
            k += 1
        # from here on a prefix may be over; every earlier one has at most a token per byte
        stop = self.starts[k] if k < len(self.items) else len(self.text)
        while stop < len(self.text) and self.at(stop + 1) <= budget:
            stop += 1
        return stop


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One per Python worker, kept between tasks."""
    return Counter(path)


def pieces(texts) -> Iterator[list[str | None]]:
    """The texts in lists of about a million characters, or of one text."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py())
        size += len(some[-1] or "")
        if size >= _CHARACTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


def count_tokens(df: DataFrame, path: str, *, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars`` of every whole text.

    ``fit_chars`` is the length of the longest prefix up to which no prefix is over ``limit``.  ``path`` must be
    readable on the executors.
    """
    def work(keys, texts):
        c, rows = counter(path), []
        for some in pieces(texts):
            cuts = [c.cut(t) for t in some]
            c.learn([items for items, _ in cuts])
            for t, (items, places) in zip(some, cuts):
                totals = c.tokens(items, places)
                n = sum(totals)
                fit = PrefixCounts(c, t, items, totals, places).fit(limit) if n > limit else len(t or "")
                rows.append((len(t.encode("utf-8", "replace")) if t else 0, n, n > limit, fit))
        return [keys, *([r[i] for r in rows] for i in range(4))]

    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
        T.StructField("fit_chars", T.LongType()),
    ])
    return map_rows(keyed_texts(df, key, text), work, schema)


def prefix_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``counts``: the number of tokens of every prefix, from the empty one to the whole text."""
    def work(keys, texts):
        c = counter(path)
        rows = []
        for t in texts.to_pylist():
            p = c.prefixes(t)
            rows.append([p.at(i) for i in range(len(t or "") + 1)])
        return keys, rows

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return map_rows(keyed_texts(df, key, text), work, schema)
