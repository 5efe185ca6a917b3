"""A Merkle manifest of documents: one tree for each language, one over the languages' roots, and a proof for each row.

H is the lower-case hex SHA-256 of its inputs' concatenation, digests as hex text. A leaf is H of doc_id, source, lang,
n_chars and text, each `-` if null, else UTF-8 byte count, `:` and value. Every ARITY consecutive nodes of a level (the
last run: fewer, even one) become their H while several remain.

The tree is folded as a monoid of sparse forests. A forest holds the nodes whose parent is not known yet, by tree, level
and index; as each tree's number of leaves is known, so is the length of every run, and a run becomes its parent as soon
as it is complete, whichever way forests are put together. Leaves are sorted into partitions, so a partition's forest
keeps at most ARITY - 1 nodes a level at either end. tree_reduce() then merges FAN forests at a time in grouped rounds. It
is not RDD.treeReduce, as the runs completed on the way are needed for the proofs and must not pass through the driver;
root() is, for those who want the root alone. The proofs come back down the same rounds: a forest's open nodes get their
paths to the root from the group it was merged in, and at last each partition computes the paths of its own rows.

Defined results: rows without doc_id come first in their language, rows of one doc_id by their leaf; equal rows have equal
leaves, so their order changes nothing. A null language is a tree of its own, the first. A row without doc_id is never
tampered with. An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

ARITY = 8
#: Forests merged at a time.
FAN = 16
#: Rows of a partition, about; a partition's hashes are held at once when its proofs are made.
ROWS = 1 << 17
#: More places than this (one for each partition and one for each language) are joined by a shuffle.
FEW_PLACES = 1 << 18
#: The tree over the languages.
TOP = -1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "part bigint, kind string, tree bigint, n bigint, trees bigint, level int, idx bigint, hash string, run array<string>, path array<string>"
PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("tree", pa.int64()), ("n", pa.int64()), ("trees", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("run", pa.list_(pa.string())), ("path", pa.list_(pa.string()))])
_PROOFS = pa.schema([(n, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n in (f.split()[0] for f in PROOF.split(", "))])


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level above n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def place(tree: int, n: int, trees: int, level: int, idx: int) -> tuple[int, int, int, int, int]:
    """A tree's root is a leaf of the tree over the languages."""
    return (TOP, trees, trees, 0, tree) if tree != TOP and width(n, level) == 1 else (tree, n, trees, level, idx)


class Forest:
    """Nodes that wait for siblings. add() is all that merging takes: the order of additions changes nothing."""

    def __init__(self) -> None:
        self.waiting: dict[tuple, dict[int, str]] = {}
        self.runs: list[tuple] = []

    def add(self, tree: int, n: int, trees: int, level: int, idx: int, hash_: str) -> None:
        while True:
            tree, n, trees, level, idx = place(tree, n, trees, level, idx)
            here, run = width(n, level), idx // ARITY
            siblings = self.waiting.setdefault((tree, n, trees, level, run), {})
            siblings[idx] = hash_
            if here == 1 or len(siblings) < min(ARITY, here - run * ARITY):
                return
            hashes = [siblings[i] for i in sorted(siblings)]
            del self.waiting[(tree, n, trees, level, run)]
            self.runs.append((tree, n, trees, level, run, hashes))
            level, idx, hash_ = level + 1, run, digest("".join(hashes))

    def merge(self, other: Forest) -> Forest:
        for node in other.nodes():
            self.add(*node)
        return self

    def nodes(self) -> Iterator[tuple]:
        for (tree, n, trees, level, _), siblings in self.waiting.items():
            for idx, hash_ in siblings.items():
                yield tree, n, trees, level, idx, hash_

    def table(self, part: int, runs: bool) -> pa.Table:
        rows = [(part, "open", *node, None, None) for node in self.nodes()]
        if runs:
            rows += [(part, "run", *run[:5], None, run[5], None) for run in self.runs]
        return _rows(rows, _ARROW)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class Paths:
    """Paths from nodes to the root: a step `left.right` for each run on the way, the hex of the siblings on either side."""

    def __init__(self, runs: dict[tuple, list[str]], known: dict[tuple, list[str]]) -> None:
        self.runs, self.known = runs, known

    def of(self, tree: int, n: int, trees: int, level: int, idx: int) -> list[str]:
        steps, passed = [], []
        while True:
            tree, n, trees, level, idx = place(tree, n, trees, level, idx)
            if (node := (tree, level, idx)) in self.known:
                steps += self.known[node]
                break
            run, at = self.runs[(tree, level, idx // ARITY)], idx % ARITY
            passed.append((node, len(steps)))
            steps.append(f"{''.join(run[:at])}.{''.join(run[at + 1 :])}")
            level, idx = level + 1, idx // ARITY
        for node, begins in passed[1:]:  # the first is asked for once only
            self.known[node] = steps[begins:]
        return steps


def fold(hash_: str, path: list[str]) -> str:
    for step in path:
        left, _, right = step.partition(".")
        hash_ = digest(left + hash_ + right)
    return hash_


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(_field(F.col("doc_id")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars")), _field(text)), 256)


def ranked(docs: DataFrame) -> DataFrame:
    """(part, tree, n, trees, idx, doc_id, leaf, changed) of every row: where its leaf stands, and what tampering makes of it."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    light = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("name"),  # orders as lang does, null first
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(text).alias("leaf"),
        F.when(hit, leaf(F.translate(text, UPPER, LOWER))).alias("changed"),
    ).withColumn("_tie", F.monotonically_increasing_id())  # so that many equal rows can be split
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS))
    order = ["name", "doc_id", "leaf", "_tie"]
    light = cut(light.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie"))
    # the lower 33 bits of this id are the row's place in its partition
    light = light.withColumn("part", F.spark_partition_id().cast("long")).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = light.groupBy("part", "name").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    trees = counts.groupBy("name").agg(F.sum("_n").alias("n"))  # a row for each language
    trees = trees.withColumn("tree", F.row_number().over(Window.orderBy("name")).cast("long") - 1)
    trees = trees.join(trees.agg(F.count("*").alias("trees")).hint("broadcast"))  # one row
    places = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    places = cut(places.join(trees.hint("merge"), "name").select("part", "name", "tree", "n", "trees", "_before"))
    few = places.count() <= FEW_PLACES
    placed = light.join(places.hint("broadcast" if few else "merge"), ["part", "name"])
    placed = placed.select("part", "tree", "n", "trees", (F.col("_at") + F.col("_before")).alias("idx"), "doc_id", "leaf", "changed")
    return placed if few else cut(placed)


def fragments(leaves: DataFrame) -> DataFrame:
    """The open nodes of each partition's forest."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, part = Forest(), None
        for batch in batches:
            for part, tree, n, trees, idx, hash_ in zip(*[batch.column(c).to_pylist() for c in ("part", "tree", "n", "trees", "idx", "leaf")], strict=True):
                forest.add(tree, n, trees, 0, idx, hash_)
            forest.runs.clear()
        if part is not None:
            yield from forest.table(part, False).to_batches()

    return leaves.select("part", "tree", "n", "trees", "idx", "leaf").mapInArrow(local, NODE)


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    forest = Forest()
    for node in zip(*[table.column(c).to_pylist() for c in ("tree", "n", "trees", "level", "idx", "hash")], strict=True):
        forest.add(*node)
    return forest.table(key[0].as_py(), True)


def tree_reduce(open_nodes: DataFrame, parts: int) -> list[DataFrame]:
    """Rounds of merged forests, the first being the partitions' own, the last one forest: open nodes and completed runs."""
    rounds = [cut(open_nodes)]
    while parts > 1:
        left = rounds[-1].where(F.col("kind") == "open")
        rounds.append(cut(left.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(_merged, NODE)))
        parts = -(-parts // FAN)
    return rounds


def _down(key: tuple, table: pa.Table) -> pa.Table:
    nodes, runs, known = [], {}, {}
    for row in table.to_pylist():
        node = (row["tree"], row["level"], row["idx"])
        if row["kind"] == "run":
            runs[node] = row["run"]
        elif row["kind"] == "path":
            known[node] = row["path"]
        else:
            nodes.append(row)
    paths = Paths(runs, known)
    return _rows([(r["part"], "path", *(at := (r["tree"], r["n"], r["trees"], r["level"], r["idx"])), None, None, paths.of(*at)) for r in nodes], _ARROW)


def paths_of_parts(rounds: list[DataFrame]) -> DataFrame:
    """The paths to the root of every partition's open nodes, down the rounds."""
    paths = rounds[-1].where(F.col("kind") == "open").withColumn("kind", F.lit("path")).withColumn("path", F.array().cast("array<string>"))
    for above, below in zip(rounds[:0:-1], rounds[-2::-1], strict=True):
        group = F.floor(F.col("part") / FAN)
        met = above.where(F.col("kind") == "run").unionByName(paths).withColumn("group", F.col("part"))
        met = met.unionByName(below.where(F.col("kind") == "open").withColumn("group", group))
        paths = met.groupBy("group").applyInArrow(_down, NODE)
    return paths


def _prove(root: str):
    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        forest = Forest()
        rows = list(zip(*[leaves.column(c).to_pylist() for c in ("tree", "n", "trees", "idx", "doc_id", "leaf", "changed")], strict=True))
        for tree, n, trees, idx, _, hash_, _ in rows:
            forest.add(tree, n, trees, 0, idx, hash_)
        known = {(r["tree"], r["level"], r["idx"]): r["path"] for r in above.to_pylist()}
        paths, subroots, out = Paths({(tree, level, run): hashes for tree, _, _, level, run, hashes in forest.runs}, known), {}, []
        for tree, n, trees, idx, doc_id, hash_, changed in rows:
            path = paths.of(tree, n, trees, 0, idx)
            if tree not in subroots:
                subroots[tree] = fold(hash_, path[: depth(n)])
            folded = fold(hash_ if changed is None else changed, path)
            out.append((doc_id, hash_, subroots[tree], root, digest("".join(path).replace(".", "")), folded, folded == root))
        return _rows(out, _PROOFS)

    return prove


def depth(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    leaves = ranked(docs)
    rounds = tree_reduce(fragments(leaves), leaves.rdd.getNumPartitions())
    top = rounds[-1].where(F.col("kind") == "open").first()  # one node: everything else is below it
    if top is None:
        return docs.sparkSession.createDataFrame([], PROOF)
    paths = paths_of_parts(rounds)
    return leaves.groupBy("part").cogroup(paths.groupBy("part")).applyInArrow(_prove(top["hash"]), PROOF)


def root(docs: DataFrame) -> str | None:
    """The root alone, by RDD.treeReduce over the partitions' forests; what reaches the driver is one node."""

    def forest(rows: Iterator) -> Iterator[Forest]:
        out = Forest()
        for r in rows:
            out.add(r["tree"], r["n"], r["trees"], r["level"], r["idx"], r["hash"])
        out.runs.clear()
        yield out

    def merge(a: Forest, b: Forest) -> Forest:
        a.merge(b).runs.clear()
        return a

    nodes = list(fragments(ranked(docs)).rdd.mapPartitions(forest).treeReduce(merge).nodes())
    return nodes[0][-1] if nodes else None
