"""Ranked lexical search of a set of items over all documents, by windowed bucket scoring.

Index: each partition's rows, in the order of doc_id, are cut into windows of WINDOW rows. A window keeps, for the items'
terms only, its postings term by term (the row's number within the window and how often the term occurs there), its rows'
ids and lengths. The windows are materialised, and from them come N, L and each term's df.

Scoring: a window's contributions are computed once a posting. Each item then adds those of its terms into one array of
WINDOW scores, while the terms' bitsets of occupied rows are or-ed together; the rows of the set bits are harvested into
the item's heap, which keeps the best over all windows of a partition. Heaps of a partition meet in two steps, first some
partitions at a time.

Terms are recognised by a 64-bit hash and confirmed byte by byte. The items are taken in blocks of about TERMS terms, so
what a task holds of them is bounded; every block reads all documents.

Defined results: a null or empty text has no term and is never found; rows that repeat a doc_id are documents of their
own; a row without doc_id comes before all others of its score; rows of one item_id are one item with the terms of all, one
without an id is an item too; an item without terms finds nothing. Empty tables give an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappushpop, heappush
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, slices, span_hashes
from ._spark import cut

#: Rows of a window: 8-byte scores of so many rows stay in a core's cache.
WINDOW = 1 << 13
#: Terms of a block of items, about.
TERMS = 1 << 18
#: Fixed value: what a term is made of, and what it is not.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same by bytes: digits, letters, and all bytes of characters beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = "part bigint, n_docs bigint, n_terms bigint, terms array<int>, dfs array<int>, rows binary, tfs binary, ids binary, no_id binary, lengths binary"


class Vocabulary:
    """The terms of a block of items, found among a text's words by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        spelled = [t.encode() for t in terms]
        raw = np.frombuffer(b"".join(spelled), np.uint8) if spelled else np.zeros(0, np.uint8)
        self.lengths = np.array([len(t) for t in spelled], np.int64)
        ends = np.cumsum(self.lengths)
        hashes = span_hashes(raw, ends - self.lengths, ends) if spelled else np.zeros(0, np.uint64)
        self.raw, self.starts = raw, ends - self.lengths
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in first, terms) of the words data[first:end] that are terms."""
        if not len(self.hashes) or not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = span_hashes(data, first, end)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == hashes)
        term = self.order[near[at]]
        same = end[at] - first[at] == self.lengths[term]
        at, term = at[same], term[same]
        left, byte, same = np.arange(len(at)), 0, np.ones(len(at), bool)
        while len(left):
            same[left] &= data[first[at[left]] + byte] == self.raw[self.starts[term[left]] + byte]
            byte += 1
            left = left[same[left] & (self.lengths[term[left]] > byte)]
        return at[same], term[same]


def _postings(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each row in terms; term, row and tf of each posting, by term and row)."""
    lengths, found, counts = np.zeros(len(texts), np.int64), [], []
    size = np.int64(max(1, len(texts)))
    for lo, hi, data, starts in slices(texts):
        inside = INSIDE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, end = edges[0::2], edges[1::2]
        row = np.searchsorted(starts, first, "right") - 1 + lo
        lengths += np.bincount(row, minlength=len(texts))
        at, term = vocabulary.find(LOWER[data], first, end)
        keys, n = np.unique(term * size + row[at], return_counts=True)
        found.append(keys)
        counts.append(n)
    keys = np.concatenate(found) if found else np.zeros(0, np.int64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")  # a row is in one slice only, so its postings are whole
    return lengths, keys[order] // size, keys[order] % size, n[order]


def index(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each window of each partition."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _regrouped(batches, WINDOW):
            part, ids, texts = (table.column(c).combine_chunks() for c in ("part", "doc_id", "text"))
            lengths, terms, rows, tfs = _postings(texts, vocabulary)
            held, dfs = np.unique(terms, return_counts=True)
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            blobs = (rows.astype(np.uint16), np.minimum(tfs, 2**32 - 1).astype(np.uint32), ids.fill_null(0).to_numpy(), no_id, lengths)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part[0].as_py()], pa.int64()),
                    "n_docs": pa.array([int((lengths > 0).sum())], pa.int64()),
                    "n_terms": pa.array([int(lengths.sum())], pa.int64()),
                    "terms": pa.array([held.tolist()], pa.list_(pa.int32())),
                    "dfs": pa.array([dfs.tolist()], pa.list_(pa.int32())),
                }
                | {name: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for name, x in zip(("rows", "tfs", "ids", "no_id", "lengths"), blobs, strict=True)}
            )

    light = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return light.mapInArrow(windows, INDEX)


def _regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of so many rows from the batches of a partition, the last one of fewer; none is empty."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, rows - n)
            held.append(piece)
            n, batch = n + piece.num_rows, batch.slice(piece.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


class Heap:
    """An item's k best (score, smaller doc_id first) so far."""

    def __init__(self, k: int) -> None:
        self.k, self.best = k, []

    def harvest(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if len(self.best) == self.k:
            at = np.flatnonzero(scores >= self.best[0][0])
            scores, ids, no_id = scores[at], ids[at], no_id[at]
        for i in np.lexsort((ids, ~no_id, -scores))[: self.k]:
            entry = (int(scores[i]), bool(no_id[i]), -int(ids[i]))
            if len(self.best) < self.k:
                heappush(self.best, entry)
            elif heappushpop(self.best, entry) == entry:
                break


def scored(windows: DataFrame, items: list[tuple[int | None, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(part, item_id, doc_id, score): each partition's k best documents of each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, sums, part = [Heap(k) for _ in items], np.zeros(WINDOW, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                rows, tfs = np.frombuffer(row["rows"], np.uint16), np.frombuffer(row["tfs"], np.uint32).astype(np.int64)
                ids, no_id = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], bool)
                lengths, terms, dfs = np.frombuffer(row["lengths"], np.int64), np.array(row["terms"], np.int64), np.array(row["dfs"], np.int64)
                m = 100 - 90 + 90 * lengths * n_docs // n_terms if n_terms else lengths
                gains = np.repeat(weights[terms], dfs) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[rows]))
                ends = np.cumsum(dfs)
                lists, occupied = {}, {}
                for term, lo, hi in zip(terms.tolist(), (ends - dfs).tolist(), ends.tolist(), strict=True):
                    lists[term] = (rows[lo:hi], gains[lo:hi])
                    bits = np.zeros(WINDOW, bool)
                    bits[rows[lo:hi]] = True
                    occupied[term] = np.packbits(bits)
                for (_, asked), heap in zip(items, heaps, strict=True):
                    bitset = np.zeros(WINDOW // 8, np.uint8)
                    for term in asked:
                        if term in lists:
                            where, gain = lists[term]
                            sums[where] += gain
                            bitset |= occupied[term]
                    touched = np.flatnonzero(np.unpackbits(bitset))
                    got = sums[touched]
                    sums[touched] = 0
                    some = got > 0
                    heap.harvest(got[some], ids[touched[some]], no_id[touched[some]])
        rows = [(part, item_id, None if no_id else -less, s) for (item_id, _), heap in zip(items, heaps, strict=True) for s, no_id, less in heap.best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "item_id", "doc_id", "score"])

    return windows.select("part", "terms", "dfs", "rows", "tfs", "ids", "no_id", "lengths").mapInArrow(score, "part bigint, item_id bigint, doc_id bigint, score bigint")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item of items (item_id, text)."""
    spark = docs.sparkSession
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, SMALL), F.lit(TERM), F.lit(0))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(words).alias("terms"))
    asked = asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)
    asked = cut(asked)
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // TERMS)
    # sorted first, so that a window holds ids near each other and a rerun cuts the same windows
    ordered = docs.select("doc_id", "text").sortWithinPartitions("doc_id") if blocks else docs
    out = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about TERMS terms
        terms = sorted({t for r in mine for t in r["terms"]})
        at = {t: i for i, t in enumerate(terms)}
        windows = cut(index(ordered, Vocabulary(terms)))
        n_docs, n_terms = windows.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        held = windows.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs")).collect()  # one row a term of the block
        weights = np.zeros(len(terms), np.int64)
        for term, df in held:
            weights[term] = weight(n_docs, df)
        out.append(scored(windows, [(r["item_id"], [at[t] for t in r["terms"]]) for r in mine], weights, n_docs or 0, n_terms or 0, k))
    if not out:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    some = _best(found.withColumn("some", F.col("part") % 256), ["item_id", "some"], k).drop("rank")
    return _best(some, ["item_id"], k).select("item_id", "rank", "doc_id", "score")
