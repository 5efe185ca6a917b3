"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition go to each block of each shard is drawn first, so that every partition's and every block's
total is exact: that is the law which a uniform permutation of all rows gives these counts. Each partition then permutes
its rows and deals them out by its row of the matrix, rows are exchanged, and each block is permuted again. A shard is
made of blocks of about the square root of all rows (BLOCK at least), so that no task holds a shard.

Matrix: the partitions stand in a binary tree; at each of its nodes the block totals are split between the two halves by
a multivariate hypergeometric draw whose seed is the node. A task walks down to its partition and so draws its own row
of the matrix, in agreement with all others; it needs only the partitions' row counts, which are sent to the tasks (one
number a partition, however many rows there are).

Law: `rows`, so shards differ by one row at most. Rows are first ordered by a hash of their content within a partition
and the permutations are seeded, so a task that runs again deals its rows out as before, and a rerun over equally split
input agrees. Another split of the input gives another, equally uniform shuffle.

Defined results: a null text has size 1 and the CRC of no bytes, 0; rows without doc_id and repeated rows are rows like
others; with fewer rows than shards some shards are empty; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

SHARDS = 8
SEED = 20_240_229
#: Rows of a block, at least.
BLOCK = 1 << 14
#: numpy's hypergeometric draws take totals below this.
LIMIT = 10**9


def block_rows(rows: int) -> int:
    return max(BLOCK, 16 * int(rows**0.5))


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def blocks(rows: int, shards: int) -> tuple[int, np.ndarray]:
    """Blocks of each shard, and the rows of every block, shard by shard; a shard's last blocks may be empty."""
    size, sizes = block_rows(rows), shard_sizes(rows, shards)
    each = max(1, -(-max(sizes) // size))
    return each, np.array([min(size, max(0, s - b * size)) for s in sizes for b in range(each)], np.int64)


def split(rng: np.random.Generator, totals: np.ndarray, left: int) -> np.ndarray:
    """What the left half, of `left` rows, takes of each block: one hypergeometric draw after another."""
    out, rest = np.zeros(len(totals), np.int64), int(totals.sum())
    for j in np.flatnonzero(totals):
        if left == 0:
            break
        mine, rest = int(totals[j]), rest - int(totals[j])
        out[j] = took = _hypergeometric(rng, mine, rest, left)
        left -= took
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy's draw below its limit; beyond, a ratio of uniforms (Stadlober's HRUA) on logarithms of factorials, whose
    error in doubles is about 1e-4 at 1e11 rows."""
    total = good + bad
    if total < LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    few, many, took = min(good, bad), max(good, bad), min(draws, total - draws)
    part = few / total
    spread = ((total - took) * took * part * (1 - part) / (total - 1) + 0.5) ** 0.5
    middle, hat = took * part + 0.5, 1.7155277699214135 * spread + 0.8989161620588988
    weight = lambda k: lgamma(k + 1) + lgamma(few - k + 1) + lgamma(took - k + 1) + lgamma(many - took + k + 1)
    best = weight((took + 1) * (few + 1) // (total + 2))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = int(np.floor(middle + hat * (v - 0.5) / u))
        if max(0, took - many) <= k <= min(took, few) and 2 * log(u) <= best - weight(k):
            break
    k = took - k if good > bad else k
    return good - k if took < draws else k


def matrix_row(before: np.ndarray, totals: np.ndarray, part: int, seed: int) -> np.ndarray:
    """A partition's row of the matrix. before: running row counts of the partitions, from 0 to all rows."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng((seed, lo, hi)), totals, int(before[mid] - before[lo]))
        totals, lo, hi = (left, lo, mid) if part < mid else (totals - left, mid, hi)
    return totals


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    light = cut(light)  # from here on the partitions are fixed
    counted = light.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    counts = np.zeros(light.rdd.getNumPartitions(), np.int64)
    for part, n in counted:
        counts[part] = n
    before = np.concatenate([[0], np.cumsum(counts)])
    rows = int(before[-1])
    each, totals = blocks(rows, shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        rng = np.random.default_rng((seed, part))
        goes = np.repeat(np.arange(len(totals), dtype=np.int32), matrix_row(before, totals, part, seed)) if counts[part] else np.zeros(0, np.int32)
        rng.shuffle(goes)
        for batch in batches:
            n = batch.num_rows
            columns = [batch.column(c) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(goes[at : at + n]), pa.array(rng.integers(0, 1 << 62, n))], ["doc_id", "size", "text_crc32", "block", "key"])
            at += n

    content = [F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed)), "doc_id", "size", "text_crc32"]
    dealt = light.sortWithinPartitions(*content).mapInArrow(deal, "doc_id bigint, size bigint, text_crc32 bigint, block int, key bigint")
    place = F.row_number().over(Window.partitionBy("block").orderBy("key", "doc_id", "size", "text_crc32")).cast("long") - 1
    return dealt.withColumn("slot", place + (F.col("block") % each).cast("long") * block_rows(rows)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.floor(F.col("block") / each).cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
