"""Ranked lexical search: accumulators from short lists, then documents skipped through long lists.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased.  One pass over the texts
keeps, per document, its number of terms and how often it holds each term of the queries.  Document frequencies, the number
of documents with a term and the number of all terms follow by partial sums per task.

A second pass cuts the documents of a task into segments and inverts each: the postings of a term hold what it adds to a document's
score.  For each query the lists of up to ``short`` postings are summed term at a time into accumulators.  These are one
list from then on, bounded by its largest sum, beside the long lists, each bounded by its largest entry.  Lists are ordered by
bound, and those whose bounds together stay below the score of the k-th best document so far can't bring in a
document of their own: candidates come from the others only, in blocks of documents in order of their numbers, and the skipped lists are
searched for the candidates alone, those with the largest bound first, until the bounds left over rule a candidate out.  The best k
of a query pass from one segment of a task to the next, and only they leave the task.

Scores are whole numbers: a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is
100 - 25 + (25 n N) div L, and each occurrence of a term in the query adds weight * ((10^9 tf) div (1000 tf + 12 m)).

Queries are taken in blocks of at most ``block_bytes`` of text, or of one query, and every block goes over all documents, so neither the driver nor a task holds
more.  A null text has no terms, and a document or query without a term of the other side has no row.  A document of any
length is one row of postings, as many as the queries have terms.  Rows that repeat an id are documents, or queries, of their own; equal scores go by
ascending id, a null id last.  Other columns of either table are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.session import materialise, scratch

#: UTF-8 bytes beyond ASCII belong to terms, so terms can be cut from bytes.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SEGMENT = 8192  # documents of a segment
POSTINGS = 2_000_000  # postings of a segment, or those of its only document
NO_ID = np.iinfo(np.int64).max
BLOCK = 256  # candidates that are scored at a time


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Segment:
    """The inverted lists of some documents.

    ``docs`` and ``adds`` hold the postings term by term (``starts``), each list in order of the documents.
    """

    def __init__(self, ids: np.ndarray, known: np.ndarray, doc: np.ndarray, term: np.ndarray, adds: np.ndarray, terms: int):
        order = np.lexsort((ids, ~known))  # documents numbered by id, so that the lowest number wins among equal scores
        self.ids, self.known = ids[order], known[order]
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids))
        by_term = np.lexsort((rank[doc], term))
        self.docs, self.adds = rank[doc][by_term], adds[by_term]
        self.starts = np.searchsorted(term[by_term], np.arange(terms + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.adds[a:b]


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all lists, ascending, and the sums of what they get."""
    docs, adds = np.concatenate([d for d, _ in lists]), np.concatenate([a for _, a in lists])
    order = np.argsort(docs, kind="stable")
    docs, adds = docs[order], adds[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[first], np.add.reduceat(adds, first)


def _found(docs: np.ndarray, adds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """What a list adds to the wanted documents."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, adds[at], 0)


def search(segment: Segment, query: list[tuple[int, int]], k: int, least: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and scores that may be among the ``k`` best: all that reach the running k-th score, at least ``least``.

    ``query`` has each term with its number of occurrences.
    """
    lists = []
    for term, times in query:
        docs, adds = segment.postings(term)
        if len(docs):
            lists.append((docs, adds * times))
    short_lists = [x for x in lists if len(x[0]) <= short]
    lists = [x for x in lists if len(x[0]) > short]
    if short_lists:  # term at a time
        lists.append(_summed(short_lists))
    if not lists:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lists.sort(key=lambda x: int(x[1].max()))
    below = np.cumsum([int(a.max()) for _, a in lists])  # what a list and all with smaller bounds can add together
    best_docs, best = np.empty(0, np.int64), np.empty(0, np.int64)

    def leading() -> int:
        return int(np.searchsorted(below, least))  # lists before it stay below the k-th score together

    at = [0] * len(lists)  # next posting of every list
    while (first := leading()) < len(lists):
        # document at a time, in blocks: the next documents of the lists that can bring in one
        ends = [docs[min(a + BLOCK, len(docs)) - 1] for (docs, _), a in zip(lists[first:], at[first:]) if a < len(docs)]
        if not ends:
            break
        end = min(ends)
        parts = []
        for i in range(first, len(lists)):
            docs, adds = lists[i]
            stop = int(np.searchsorted(docs, end, side="right"))
            if stop > at[i]:
                parts.append((docs[at[i]:stop], adds[at[i]:stop]))
                at[i] = stop
        docs, scores = _summed(parts)
        for i in range(first - 1, -1, -1):  # seek the candidates in the skipped lists
            hope = scores + below[i] >= least
            docs, scores = docs[hope], scores[hope]
            if not len(docs):
                break
            scores = scores + _found(*lists[i], docs)
        good = scores >= max(least, 1)
        best_docs, best = np.concatenate([best_docs, docs[good]]), np.concatenate([best, scores[good]])
        if len(best) > k:
            keep = np.lexsort((best_docs, -best))[:k]
            best_docs, best = best_docs[keep], best[keep]
        if len(best) == k:
            least = max(least, int(best.min()))
    return best_docs, best


class Best:
    """The ``k`` best documents of a query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.known, self.scores = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores.min()) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        ids, known, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.known, known), (self.scores, scores)))
        keep = np.lexsort((ids, ~known, -scores))[:self.k]
        self.ids, self.known, self.scores = ids[keep], known[keep], scores[keep]


_FORWARD = "doc_id long, n long, terms array<int>, times array<long>"


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document its number of terms and its counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by block_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, terms, times, starts = [], [], [], [0]
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                held = Counter(x for x in map(known.get, found) if x is not None)
                lengths.append(len(found))
                terms.extend(held)
                times.extend(held.values())
                starts.append(len(terms))
            offsets = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(run, _FORWARD)


def _frequencies(forward: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and document frequencies of the vocabulary's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(terms + 2, dtype=np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            totals[terms] += np.count_nonzero(n)
            totals[terms + 1] += n.sum()
            totals[:terms] += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["term", "n"])

    rows = forward.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(terms + 2, dtype=np.int64)
    for r in rows:
        totals[r["term"]] = r["n"]
    return int(totals[terms]), int(totals[terms + 1]), totals[:terms]


def _block(docs: DataFrame, queries: list[list[tuple[int, int]]], vocabulary: dict[bytes, int], k: int, short: int) -> DataFrame:
    """``query`` (place in ``queries``), ``doc_id`` and ``score`` of every task's best documents."""
    forward = materialise(_forward(docs, vocabulary))
    documents, length, frequencies = _frequencies(forward, len(vocabulary))
    weights = np.array([weight(documents, int(df)) for df in frequencies], dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((queries, weights))

    def segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Segment]:
        held, size, postings = [], 0, 0

        def inverted() -> Segment:
            counts = np.concatenate([h[3] for h in held])
            doc = np.repeat(np.arange(len(counts)), counts)
            term, tf = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            m = 100 - 25 + (25 * np.concatenate([h[2] for h in held]) * documents) // length
            adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            return Segment(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), doc, term, adds, len(weights))

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids, lists = batch.column("doc_id"), batch.column("terms")
                held.append((
                    ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False),
                    batch.column("n").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False),
                    lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                    batch.column("times").flatten().to_numpy(zero_copy_only=False)))
                size, postings = size + batch.num_rows, postings + len(held[-1][4])
                if size >= SEGMENT or postings >= POSTINGS:
                    yield inverted()
                    held, size, postings = [], 0, 0
        if postings:
            yield inverted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = [Best(k) for _ in queries]
        for segment in segments(batches, weights):
            for query, own in zip(queries, best):
                found, scores = search(segment, query, k, own.least, short)
                if len(found):
                    own.add(segment.ids[found], segment.known[found], scores)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            known = np.concatenate([b.known for b in best])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(np.concatenate([b.ids for b in best]), mask=~known),
                pa.array(np.concatenate([b.scores for b in best]))], names=["query", "doc_id", "score"])

    return forward.where(F.size("terms") > 0).mapInArrow(run, "query long, doc_id long, score long")


def _query_blocks(queries: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The queries (``item``, text) in blocks of bounded text; the driver holds one block at a time."""
    block, size = [], 0
    for row in queries.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        own = len((row["text"] or "").encode("utf-8", "surrogatepass"))
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += own
    if block:
        yield block


def rank(
    docs: DataFrame, queries: DataFrame, *, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", short: int = 256, block_bytes: int = 1 << 22,
) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key`` and ``score`` of the ``k`` best documents of every query with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = queries.schema[item].dataType
    names = [item, "rank", key, "score"]
    done: list[DataFrame] = []
    for block in _query_blocks(queries, item, item_text, block_bytes):
        vocabulary: dict[bytes, int] = {}
        counted = [[(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in Counter(terms_of(content)).items()] for _, content in block]
        if not vocabulary:
            continue
        with scratch(spark) as keep:
            best = _block(rows, counted, vocabulary, k, short)
            order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
            # the best of all tasks in two steps, so that no task sees what all tasks found for a query
            part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
            few = best.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(F.col("rank") <= k)
            last = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
            items = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(block)], T.StructType([
                T.StructField("query", T.LongType()), T.StructField("item", kind)]))
            ranked = last.join(F.broadcast(items), "query").select(F.col("item"), "rank", "doc_id", "score")  # bounded by block_bytes
            done.append(keep(ranked))
    if not done:
        return spark.createDataFrame([], T.StructType([T.StructField(names[0], kind), T.StructField(names[1], T.IntegerType()),
                                                       T.StructField(names[2], T.LongType()), T.StructField(names[3], T.LongType())]))
    return reduce(DataFrame.unionByName, done).toDF(*names)
