"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document's set holds its distinct k-word shingles as 64-bit hashes; documents with equal sets form one class, known
by 128 bits of the full set, and only one document of each class is compared. Classes meet in the buckets of a banded
signature, and each bucket compares pivots with its other members, never all pairs:

1. The pivot of a bucket is the member that meets most others over all its buckets, which is the hub of a group of edited
   copies. It meets every other member.
2. The links found become components. A bucket that is one component by now is done, as nothing in it can join more. In
   the others each member is described by what it differs in from the pivot. A member x that is not linked to the pivot
   differs from it in more than the threshold allows, so another member y is only similar enough if it shares more than
   about half of its own differences with x. Pairs are therefore looked up by x's differences among the rarest half of
   y's, and kept if enough are common. Copies that were each edited for themselves share hardly any, so a large group
   of them gives few pairs.

So no link that the buckets hold is lost, except where both ends are connected anyway.

A pair is checked batch by batch of its signatures. After n hashes with m matches the similarity has the posterior
Beta(m + 1, n - m + 1) under a uniform prior; the pair is dropped when the posterior probability of reaching the
threshold is below MISS. Survivors are confirmed on their full sets.

Buckets, hubs and components may be hot. They are counted with partial sums, and joined from written tables, so that
Spark's adaptive joins split them.

Defined results: A null or wordless text has an empty set and is linked with nothing; with fewer than k words the
whole sequence is the one shingle. Rows that repeat a doc_id each give a row, and their classes are compared like
any others. A null doc_id is never a component's name unless a group holds no other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, mix, slices, span_hashes, word_bounds
from ._spark import cut, release

#: Probability with which the bands, or one step of the verification, miss a pair just at the threshold.
MISS = 1e-5
#: Number of hash functions, unless a very low threshold needs more.
HASHES = 192
#: Hashes compared before each look at the posterior.
BATCH = 30
#: Document ids up to this number (8 bytes each) are broadcast to the scan of texts; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000


@lru_cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(multipliers, seeds) of n hash functions; the first ones are the same for every n."""
    odd = np.random.default_rng(8).integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, np.random.default_rng(9).integers(0, 2**32, n, dtype=np.uint32)


def band_plan(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands with which a pair at the threshold is missed with MISS at most."""
    s = percent / 100
    for rows in range(12, 0, -1):
        bands = ceil(log(MISS) / log(1 - s**rows)) if s < 1 else 1
        if rows * bands <= HASHES:
            break
    return rows, bands


def least_matches(n: int, percent: int) -> int:
    """The fewest matches of n hashes with which P(similarity >= threshold) is still MISS: Beta(m + 1, n - m + 1)
    exceeds t with the probability that n + 1 trials of probability t succeed m times at most."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= MISS:
            return m
    return n


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi, data, starts in slices(column):
        data = LOWER[data]
        first, end = word_bounds(data)
        hashes = span_hashes(data, first, end)
        bounds = np.searchsorted(first, starts)
        whole = hashes
        for i in range(1, words):  # shingle of the words at j .. j + words - 1, also across rows; those are not used
            whole = mix(whole[: max(0, len(hashes) - i)] * np.uint64(0x9E3779B97F4A7C15) + hashes[i:] + np.uint64(i))
        for row in range(hi - lo):
            a, b = int(bounds[row]), int(bounds[row + 1])
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = mix(np.array([short]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, hashes: int) -> bytes:
    """The low 16 bits of the smallest value of each hash function over the set."""
    multipliers, seeds = _functions(hashes)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 512):
        values = (x[None, lo : lo + 512] ^ seeds[:, None]) * multipliers[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least.astype("<u2").tobytes()


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the full set; two sets that differ share them with a probability of 2**-128."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig) for each row; h1 and h2 name the set and are null, as is sig, if the set is empty."""

    def run(batches):
        for batch in batches:
            n, keys, sigs = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                keys.append(_key(s) if len(s) else (None, None))
                sigs.append(signature(s, hashes) if len(s) else None)
            h1, h2 = ([k[i] for k in keys] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "n", "h1", "h2", "sig"])

    return _text(docs).mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, width)


def _likely(pairs: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that sequential comparison of signature batches does not rule out."""
    steps = [(lo, min(lo + BATCH, hashes)) for lo in range(0, hashes, BATCH)]
    least = [least_matches(hi, percent) for _, hi in steps]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _rows_of(batch.column(2), hashes), _rows_of(batch.column(3), hashes)
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for (lo, hi), needed in zip(steps, least, strict=True):
                matches = matches + (x[alive, lo:hi] == y[alive, lo:hi]).sum(axis=1)
                alive, matches = alive[matches >= needed], matches[matches >= needed]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(k, shingles) of the classes (k, h1, h2, doc_id), from a second reading of their first documents."""

    def run(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0), words) if len(s)]
            keys = [_key(s) for s in sets]
            h1, h2 = ([k[i] for k in keys] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "shingles"])

    ids = classes.select("doc_id")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = _text(docs).alias("t").join(ids.alias("i"), F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    sets = wanted.select("text").mapInArrow(run, "h1 long, h2 long, shingles binary").groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    return cut(sets.join(classes.select("h1", "h2", "k"), ["h1", "h2"]).select("k", "shingles"))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, hashes: int) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out and whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sides = [classes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    sized = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = cut(_likely(sized.select("a", "b", "sig_a", "sig_b"), percent, hashes))
    full = likely.join(sets.select(F.col("k").alias("a"), F.col("shingles").alias("shingles_a")), "a")
    full = full.join(sets.select(F.col("k").alias("b"), F.col("shingles").alias("shingles_b")), "b")
    return cut(full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(run, "a long, b long"))


def _forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the given ones do, from each node of a partition straight to the smallest node
    that the partition connects it with. Holds the nodes of one partition."""

    def run(batches):
        above: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (up := above.setdefault(root, root)) != root:
                root = up
            while above[x] != root:
                above[x], x = root, above[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        rows = [(x, top(x)) for x in list(above)]
        for lo in range(0, len(rows), 10_000):
            a, b = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(k, comp) for each end of edges (a, b): comp is the smallest k that it is connected with.

    Each partition's edges first shrink to stars. Then each round takes the smallest label among a node's neighbours,
    and the label of that label, so a path of d stars needs about log d rounds.
    """
    edges = cut(_forest(edges))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy(F.col("a").alias("k")).agg(F.least(F.col("k"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label.select(F.col("k").alias("b"), "comp"), "b").groupBy(F.col("a").alias("k")).agg(F.min("comp").alias("near"))
        moved = cut(label.join(near, "k").select("k", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        if moved.where("comp <> was").isEmpty():
            release(label.sparkSession)
            return label
        far = moved.select(F.col("k").alias("comp"), F.col("comp").alias("next"))
        label = cut(moved.join(far, "comp").select("k", F.least("comp", "next").alias("comp")))


def _open_entries(members: DataFrame, label: DataFrame, pivots: DataFrame) -> DataFrame:
    """(bucket, k, comp, p, p_comp) of the members, without the pivots, of buckets that hold more than one component."""
    labelled = cut(members.join(label, "k", "left").select("bucket", "k", F.coalesce("comp", "k").alias("comp")))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    of_pivot = label.select(F.col("k").alias("p"), F.col("comp").alias("p_comp"))
    mixed = cut(mixed.join(pivots, "bucket").join(of_pivot, "p", "left").withColumn("p_comp", F.coalesce("p_comp", "p")))
    return labelled.join(mixed, "bucket").where("k <> p")


def _differences(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, k, comp, outside, n, size, need, items) for each class k and pivot p of entries: items are the `size` shingles that
    only one of them holds, outside whether k is of another component than p. A link between k and a class outside
    needs `need` common items: the one outside has more items than the threshold lets it differ from p."""

    def run(batches):
        for batch in batches:
            n, size, need, items = [], [], [], []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                items.append(np.setxor1d(x, y, assume_unique=True))
                n.append(len(x))
                size.append(len(items[-1]))
                need.append((size[-1] * (100 + percent) + (100 - percent) * (len(y) - len(x))) // (2 * (100 + percent)) + 1)
            offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*items, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(need, pa.int64()), lists], ["p", "k", "comp", "outside", "n", "size", "need", "items"])

    pairs = entries.select("p", "k", "comp", (F.col("comp") != F.col("p_comp")).alias("outside")).distinct()
    full = pairs.join(sets.select("k", F.col("shingles").alias("own")), "k").join(sets.select(F.col("k").alias("p"), F.col("shingles").alias("other")), "p")
    return cut(full.select("p", "k", "comp", "outside", "own", "other").mapInArrow(run, "p long, k long, comp long, outside boolean, n long, size long, need long, items array<long>"))


def _beside_pivots(differences: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of two components, compared with one pivot, that can be linked by what they differ in
    from it. Of two such classes one at least is outside, and the two share `need` items of the other. So it is enough to
    look up the items of the one outside among the rarest ones of the other, all but need - 1 of them."""
    items = differences.select("p", "k", F.explode("items").alias("item"))
    held = cut(items.groupBy("p", "item").agg(F.count("*").alias("held")).where("held > 1"))
    of_class = Window.partitionBy("p", "k")
    ranked = items.join(held, ["p", "item"]).select("*", F.row_number().over(of_class.orderBy("held", "item")).alias("rank"), F.count("*").over(of_class).alias("usable"))
    ranked = cut(ranked.join(differences.drop("items"), ["p", "k"]).where("usable >= need").drop("held"))
    side = lambda rows, x: rows.select("p", "item", *[F.col(c).alias(f"{c}_{x}") for c in ("k", "comp", "n", "size", "usable", "need")])
    met = side(ranked.where("outside"), "x").join(side(ranked.where("rank <= usable - need + 1"), "y"), ["p", "item"]).where("comp_x <> comp_y")
    enough = lambda common: (100 + percent) * (F.col("size_x") + F.col("size_y") - 2 * common) <= (100 - percent) * (F.col("n_x") + F.col("n_y"))
    met = met.where(enough(F.least("usable_x", "usable_y"))).groupBy("p", "k_x", "k_y", "size_x", "size_y", "n_x", "n_y", "need_y").agg(F.count("*").alias("common"))
    met = met.where(enough(F.col("common") + F.col("need_y") - 1))
    return met.select(F.least("k_x", "k_y").alias("a"), F.greatest("k_x", "k_y").alias("b")).distinct()


def _links(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int, percent: int, hashes: int) -> DataFrame:
    """(k, comp) of the classes (k, n, sig, h1, h2, doc_id, score) that have links: their components, through the pairs
    that meet in the buckets of members (bucket, k)."""
    sets = _sets(docs, classes, words)
    pivots = cut(members.join(classes.select("k", "score"), "k").groupBy("bucket").agg(F.max_by("k", "score").alias("p")))
    pairs = members.join(pivots, "bucket").where("k <> p").select(F.col("k").alias("a"), F.col("p").alias("b")).distinct()
    found = _confirmed(pairs, classes, sets, percent, hashes)
    del pairs
    release(docs.sparkSession)
    label = components(found)
    differences = _differences(_open_entries(members, label, pivots), sets, percent)
    release(docs.sparkSession)
    if differences.isEmpty():
        return label
    new = _confirmed(_beside_pivots(differences, percent), classes, sets, percent, hashes)
    if new.isEmpty():
        return label
    return components(label.select(F.col("k").alias("a"), F.col("comp").alias("b")).union(new))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Texts are lower-cased in A-Z and split at white space; rows are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable.
    """
    rows, bands = band_plan(percent)
    hashes = rows * bands
    digest = cut(digests(docs, words, hashes))
    filled = digest.where(F.col("h1").isNotNull())
    classes = filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("k", F.monotonically_increasing_id()))

    keys = [F.xxhash64(F.substring("sig", 2 * rows * i + 1, 2 * rows), F.lit(i)) for i in range(bands)]
    entries = classes.select("k", F.explode(F.array(*keys)).alias("bucket"))
    sizes = cut(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = cut(entries.join(sizes, "bucket"))
    meeting = cut(classes.join(members.groupBy("k").agg(F.sum("size").alias("score")), "k"))
    del entries
    release(docs.sparkSession)
    if meeting.isEmpty():
        named = classes.select("h1", "h2", F.col("doc_id").alias("component_id"))
    else:
        label = _links(docs, meeting, members.drop("size"), words, percent, hashes)
        names = cut(label.join(meeting.select("k", "doc_id"), "k").groupBy("comp").agg(F.min("doc_id").alias("name")))
        named = classes.join(label.join(names, "comp").select("k", "name"), "k", "left").select("h1", "h2", F.coalesce("name", "doc_id").alias("component_id"))
    out = filled.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.union(digest.where(F.col("h1").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(True)))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, with all their columns: the row of the smallest doc_id, of its rows the first by a
    hash of the text. Rows are told apart by their number, so a repeated id, a repeated row and a null id each count as a
    row. A row without an id counts as a copy only of another such row, so of these one stays as well."""
    row, n = "_row", 0
    while row in docs.columns:
        row, n = f"_row{n}", n + 1
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("r"), "component_id")
    place = rows.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    groups = cut(groups.join(place, "r"))
    first = groups.groupBy("component_id", F.col("id").isNull()).agg(F.min(F.struct("id", "hash", "r")).alias("first")).select(F.col("first.r").alias("r"))
    gone = cut(groups.join(first, "r", "left_anti").select(F.col("r").alias("_gone")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return rows.join(gone, rows[row] == gone["_gone"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
