"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Vectors are turned into integers and dealt into blocks; each block of queries meets each block of candidates. Within a
pair of blocks every dimension is a list of the candidates sorted by value, read from its upper end for queries whose
factor is positive and from its lower end for those whose factor is negative; a factor of 0 needs no list. The lists are
read in step, from one of DEPTHS to the next, and what is read is added to its candidates' sums. After each step a
candidate's score has bounds: its sum, plus for entries that were not read the smallest or the largest value that the
list can still hold. A query is finished when few candidates are left whose upper bound reaches the k-th lower bound;
those are resolved in full. The first block of candidates is read first: the k-th score that a query finds there is a
lower bound for all others, which closes them sooner than their own k-th would. The k best of each pair of blocks then
meet in one aggregation per query, of k rows for each block.

A step serves all open queries of a block at once, and they leave it as they finish. Counts of entries read come with the
results, for tests and for the README's figures. Lists of many dimensions that matter alike close late: with such vectors
most of each list is read, and plain scoring would be cheaper.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without
vec_id. Vectors that are shorter are read with zeros after their end. Rows that share a vec_id are candidates each for
itself, and where it is a query's, what any of them finds is ranked together; none of them is a candidate of another.
Ties go to the smaller vec_id; with fewer candidates than k all are returned. Scores are 64-bit integers and wrap beyond
them, as do components; vectors so large that sums may pass 2**53 are scored in full. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

#: Rows of a block of candidates, and of a block of queries. A candidate travels once for each block of queries and a query
#: once for each block of candidates; SLICE queries of a block are looked at together, which bounds
#: a task's memory.
CANDIDATES, QUERIES, SLICE = 4096, 4096, 128
#: Shares of the lists that have been read when the bounds are compared.
DEPTHS = (0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return usable.select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _packed(rows: DataFrame, block, name: str) -> DataFrame:
    """One row for each block: its ids, vectors and floors as bytes. A block has about as many rows as its size says."""

    def pack(key, table):
        rows = sorted(zip(table.column("vec_id").to_pylist(), table.column("v").to_pylist(), table.column("floor").to_pylist(), strict=True))
        width = max(len(v) for _, v, _ in rows)
        matrix = np.array([v + [0] * (width - len(v)) for _, v, _ in rows], np.int64)
        for kind in ("<i2", "<i4"):
            if (matrix.astype(kind) == matrix).all():
                matrix = matrix.astype(kind)
                break
        return pa.table({name: [key[0].as_py()], f"{name}_ids": [np.array([r[0] for r in rows], np.int64).tobytes()], f"{name}_rows": [matrix.tobytes()], f"{name}_width": [width], f"{name}_floors": [np.array([r[2] for r in rows], np.float64).tobytes()]})

    blocked = rows.withColumn("_block", block)
    return blocked.groupBy("_block").applyInArrow(pack, f"{name} long, {name}_ids binary, {name}_rows binary, {name}_width long, {name}_floors binary")


def _matrix(row: dict, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{name}_ids"], np.int64)
    size = len(row[f"{name}_rows"]) // max(1, len(ids) * row[f"{name}_width"])
    values = np.frombuffer(row[f"{name}_rows"], f"<i{size or 8}").astype(np.int64).reshape(len(ids), row[f"{name}_width"])
    return ids, np.pad(values, ((0, 0), (0, width - values.shape[1])))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _ways(queries: np.ndarray) -> np.ndarray:
    """The factors of the lists' upper ends, then those of their lower ends."""
    return np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)


class Lists:
    """A block's candidates as one sorted list for each dimension, which can be read from either end."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.entries, self.steps = ids, values, 0, {}
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0).astype(np.float64)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(ids))[:, None], axis=0)
        # at which depth an entry is met from the upper and from the lower end
        self.depth = np.concatenate([len(ids) - 1 - rank, rank], axis=1)
        self.both = np.concatenate([values, values], axis=1).astype(np.float64)

    def read(self, sums: np.ndarray, ways: np.ndarray, begin: int, end: int) -> np.ndarray:
        """The sums (candidate, query) with the entries from depth begin to end of every list. A step's entries stand in one
        matrix, in which all others are 0, so one product adds them for all queries."""
        if (begin, end) not in self.steps:
            self.steps[begin, end] = np.where((self.depth >= begin) & (self.depth < end), self.both, 0.0)
        self.entries += np.count_nonzero(ways) * (end - begin)
        return sums + self.steps[begin, end] @ ways.T

    def bounds(self, sums: np.ndarray, ways: np.ndarray, depth: int, lower: bool) -> np.ndarray:
        """The lower or the upper bounds (candidate, query) when every list has been read to a depth."""
        n = len(self.ids)
        if depth >= n:
            return sums
        if depth not in self.steps:
            self.steps[depth] = (self.depth >= depth).astype(np.float64)
        ends = (0, n - 1) if lower else (n - 1 - depth, depth)
        return sums + self.steps[depth] @ (ways * np.concatenate([self.sorted[ends[0]], self.sorted[ends[1]]])).T


def search_block(query_ids: np.ndarray, queries: np.ndarray, lists: Lists, k: int, floors: np.ndarray | None = None):
    """Yields (query id, places of its k best candidates, their scores). floors: for each query a score that k candidates
    of others reach; what is below need not be found."""
    floors = np.full(len(query_ids), -np.inf) if floors is None else floors
    for first in range(0, len(query_ids), SLICE):
        part = slice(first, first + SLICE)
        yield from _search_slice(query_ids[part], queries[part], lists, k, floors[part])


def _search_slice(query_ids, queries, lists: Lists, k: int, floors):
    ids, values, n = lists.ids, lists.values, len(lists.ids)
    own = ids[:, None] == query_ids[None, :]
    if float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * values.shape[1] >= 2**53:
        for i, row in enumerate(queries @ values.T):
            others = np.flatnonzero(~own[:, i])
            best = _best(row[others], ids[others], k)
            yield query_ids[i], others[best], row[others][best]
        return
    ways, open_, sums, depth = _ways(queries.astype(np.float64)), np.arange(len(query_ids)), np.zeros((n, len(query_ids))), 0
    for share in DEPTHS:
        begin, depth = depth, max(1, round(share * n))
        sums = lists.read(sums, ways[open_], begin, depth)
        able, least = ~own[:, open_], floors[open_]
        if n > k and not np.isfinite(least).all():
            lower = np.where(able, lists.bounds(sums, ways[open_], depth, True), -np.inf)
            least = np.maximum(least, np.partition(np.ascontiguousarray(lower.T), n - k, axis=1)[:, n - k])
        able &= lists.bounds(sums, ways[open_], depth, False) >= least[None, :]
        done = able.sum(axis=0) <= (4 * k if depth < n else n)
        for i in np.flatnonzero(done):
            places = np.flatnonzero(able[:, i])
            scores = values[places] @ queries[open_[i]]  # what is still open of a few candidates is resolved
            best = _best(scores, ids[places], k)
            yield query_ids[open_[i]], places[best], scores[best]
        open_, sums = open_[~done], sums[:, ~done]
        if not len(open_):
            return


def _met(candidates: DataFrame, queries: DataFrame, blocks: range, query_blocks: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each of some blocks of candidates."""
    # every pair of blocks is a key of its own, so the pairs spread over `parts` tasks whatever the vectors are
    parts = max(1, min(len(blocks) * query_blocks, 4096))
    each = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
    left = candidates.where(F.col("c").between(blocks.start, blocks.stop - 1)).drop("c_floors").withColumn("q", each(0, query_blocks)).repartition(parts, "c", "q")
    met = left.join(queries.withColumn("c", each(blocks.start, blocks.stop)).repartition(parts, "c", "q"), ["c", "q"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["c_width"], row["q_width"])
                (query_ids, q), (ids, x) = _matrix(row, "q", width), _matrix(row, "c", width)
                found = list(search_block(query_ids, q, Lists(ids, x), k, np.frombuffer(row["q_floors"], np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                        pa.array(np.concatenate([ids[f[1]] for f in found] or [np.zeros(0, np.int64)])),
                        pa.array(np.concatenate([f[2] for f in found] or [np.zeros(0)]).astype(np.int64)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    return met.select("q_ids", "q_rows", "q_width", "q_floors", "c_ids", "c_rows", "c_width").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose vec_id is divisible by `every`."""
    rows = cut(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()))  # by which rows of one id spread
    query = F.col("vec_id") % every == 0
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(query).alias("q")).first()
    blocks, query_blocks = -(-sizes["n"] // CANDIDATES) or 1, -(-sizes["q"] // QUERIES) or 1
    lowest = F.lit(float("-inf"))
    candidates = _packed(rows.withColumn("floor", lowest), F.pmod(F.xxhash64("row"), F.lit(blocks)), "c")
    asked, into = rows.where(query).withColumn("floor", lowest), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks))
    found = _met(candidates, _packed(asked, into, "q"), range(1), query_blocks, k)
    if blocks > 1:
        found = cut(_ranked(found, k))
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reached"))
        asked = asked.join(floors.hint("merge"), "vec_id", "left").withColumn("floor", F.coalesce("reached", lowest)).drop("reached")
        found = found.drop("rank").union(_met(candidates, _packed(asked, into, "q"), range(1, blocks), query_blocks, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
