"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A text is split by the pattern of the rank file; every match is merged for itself.  The tree has one
leaf per byte position and sixteen children per node.  The leaf of the first byte of a live part holds the
rank of the pair that this part forms with its right neighbour; inner nodes hold the least rank below them,
the leftmost one if ranks are equal.  A merge takes the root's position, and then updates three leaves: the merged part,
its left neighbour, and the part that is gone.

Nulls and empty texts give no ids and decode to nothing.  Matches that occur again are looked up in a
table of bounded size, which never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.llm.texts import keyed_texts, map_rows, splitter

_BITS = 4  # a node has 2 ** _BITS children: few levels, and each least child is found by one built-in call
_FAN = 1 << _BITS
_SHIFT = 40  # a tree entry is rank << _SHIFT | position
_MASK = (1 << _SHIFT) - 1
_NONE = 1 << 80
_CACHE = 600_000
_LONG_PIECE = 256  # longer matches are not kept in the table


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of ``piece`` after all merges, lowest rank first and leftmost among equal ranks."""
    n = len(piece)
    if n < 2:
        return [piece] if n else []
    rank = ranks.get
    leaves = [_NONE] * n
    for i in range(n - 1):
        r = rank(piece[i:i + 2])
        if r is not None:
            leaves[i] = r << _SHIFT | i
    tree = [leaves]
    while len(tree[-1]) > _FAN:
        below = tree[-1]
        tree.append([min(below[i:i + _FAN]) for i in range(0, len(below), _FAN)])
    top, inner = tree[-1], tree[:-1]
    end = list(range(1, n + 1))  # end[i]: where the live part that starts at i stops
    before = list(range(-1, n))  # before[i]: start of the live part to the left of the one at i

    def put(at: int, value: int) -> None:
        for level in inner:
            level[at] = value
            at >>= _BITS
            value = min(level[at << _BITS:(at + 1) << _BITS])
        top[at] = value

    while not inner and (least := min(top)) < _NONE:  # one level: the same updates without calls
        i = least & _MASK
        gone = end[i]
        stop = end[i] = end[gone]
        top[gone] = top[i] = _NONE
        if stop < n:
            before[stop] = i
            r = rank(piece[i:end[stop]])
            if r is not None:
                top[i] = r << _SHIFT | i
        left = before[i]
        if left >= 0:
            r = rank(piece[left:stop])
            top[left] = _NONE if r is None else r << _SHIFT | left
    while (least := min(top)) < _NONE:
        i = least & _MASK
        gone = end[i]
        stop = end[i] = end[gone]
        put(gone, _NONE)
        if stop < n:
            before[stop] = i
            r = rank(piece[i:end[stop]])
            put(i, _NONE if r is None else r << _SHIFT | i)
        else:
            put(i, _NONE)
        left = before[i]
        if left >= 0:
            r = rank(piece[left:stop])
            put(left, _NONE if r is None else r << _SHIFT | left)
    parts, i = [], 0
    while i < n:
        parts.append(piece[i:end[i]])
        i = end[i]
    return parts


class Encoder:
    """Ids of texts and bytes of ids, by a file of base64 tokens and ranks and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.digits = {b: str(b) for b in self.tokens}
        self._find = splitter(pattern)
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match; a match that is a token itself is never split."""
        raw = text.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        ranks = self.ranks
        return tuple([ranks[p] for p in merge(raw, ranks)])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self._find(text)
        known = self._known
        if len(known) > _CACHE:
            known.clear()
        long = {}
        for p in set(pieces):
            if p not in known:
                (known if len(p) <= _LONG_PIECE else long)[p] = self.piece(p)
        if long:
            return list(chain.from_iterable([long[p] if p in long else known[p] for p in pieces]))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; an id that the file does not have raises a ``KeyError``."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    return Encoder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every whole text; ``path`` must be readable on the executors."""
    def work(keys, texts):
        enc = encoder(path, pattern)
        return keys, [enc.encode(t) for t in texts.to_pylist()]

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_rows(keyed_texts(df, key, text), work, schema)


def decode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``content`` (binary) of every row of ids; null ids give no bytes."""
    def work(keys, rows):
        enc = encoder(path, pattern)
        return keys, [enc.decode(r or ()) for r in rows.to_pylist()]

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("content", T.BinaryType())])
    return map_rows(df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")), work, schema)


def round_trip(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``key``, ``n_tokens``, and digests of the ids and of the decoded bytes.

    Ids are hashed as decimal numbers joined by commas.  Nothing but digests leaves a task.
    """
    def work(keys, texts):
        enc = encoder(path, pattern)
        sizes, ids_hex, bytes_hex = [], [], []
        for t in texts.to_pylist():
            ids = enc.encode(t)
            sizes.append(len(ids))
            ids_hex.append(hashlib.sha256(",".join(map(enc.digits.__getitem__, ids)).encode()).hexdigest())
            bytes_hex.append(hashlib.sha256(enc.decode(ids)).hexdigest())
        return keys, sizes, ids_hex, bytes_hex

    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    return map_rows(keyed_texts(df, key, text), work, schema)
