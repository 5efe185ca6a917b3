"""A trigram index that narrows a search to the rows that can match before their texts are read.

    <path>/rows/block=<b>/       the rows, dealt into blocks of about ROWS by a hash of their id
    <path>/grams/part=<p>/       postings: for a field, a trigram and a block the sorted ids of the rows that hold it
    <path>/counts/               how many rows hold each trigram, to choose the rarest of a pattern's
    <path>/index.json            the number of blocks

Texts are indexed in lower case by their trigrams of code points. A condition that a field contains, equals or starts with
a text of three characters or more can hold only where all its trigrams stand; the postings of its RAREST ones are met
block by block. An and needs the rows of all its parts that can be looked up, an or those of any, provided that all can.
Shorter patterns, negations and fields without an index narrow nothing. What is left is a superset: the search's own
predicate decides, so results are those of a search without an index. Only the blocks that hold candidates are read.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.book_files import store
from .filters import POSITIVE, RELATIONS, Condition, Search

#: Rows of a block, parts of the postings, trigrams of a pattern that are looked at and that are met.
ROWS, PARTS, LOOKED_AT, RAREST = 1 << 14, 64, 64, 3
#: Blocks whose postings of a part stand together.
SPAN = 128
QUICK = ("name", "ingredients", "instructions", "keywords", "author", "title")
#: Operations that are passed over in a search stand here for nothing at all.
KNOWN = (*POSITIVE, "not_contains")


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:]) if len(points) > 2 else np.zeros(0, np.int64)


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram): the distinct trigrams of each of some texts, all at once."""
    encoded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(encoded), np.uint32).astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(e) // 4 for e in encoded])
    within = owner[:-2] == owner[2:]
    owner, gram = owner[:-2][within], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[within]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[new], gram[new]


def _postings(key: tuple, rows: pa.Table) -> pa.Table:
    """The postings of one block, from its texts (id, field, text); a text that many rows share is cut up once."""
    out, kinds = [], rows.column("field")
    for field in sorted(pc.unique(kinds).to_pylist()):
        own = rows.filter(pc.equal(kinds, field))
        ids, texts = own.column("id").combine_chunks(), own.column("text").combine_chunks().dictionary_encode()
        ids_in_order = ids.take(by_id := pc.sort_indices(ids))  # postings stand in order of id
        text_of = texts.indices.to_numpy()[by_id.to_numpy()]
        owner, gram = _pairs(texts.dictionary.to_pylist())
        grams_held, gram = np.unique(gram, return_inverse=True)
        # each pair of a text and a trigram stands for all rows of the text
        of_text, held_by = np.argsort(text_of, kind="stable"), np.bincount(text_of, minlength=len(texts.dictionary))
        begin, n = (np.cumsum(held_by) - held_by)[owner], held_by[owner]
        places = of_text[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.sort(np.repeat(gram, n) * len(ids) + places)
        gram, places = both // len(ids), both % len(ids)
        begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
        ends = np.r_[begins, len(gram)]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids_in_order.take(pa.array(places))) if len(gram) else pa.array([], pa.list_(ids.type))
        out.append(pa.table({"field": pa.array([field] * len(begins), pa.string()), "gram": pa.array(grams_held[gram[begins]], pa.int64()), "block": pa.array([key[0].as_py()] * len(begins), pa.int32()), "n": pa.array(np.diff(ends)[: len(begins)], pa.int32()), "ids": lists}))
    return pa.concat_tables(out)


def texts_of(recipes: DataFrame, related: DataFrame | None = None, fields: tuple[str, ...] = QUICK) -> DataFrame:
    """(id, field, text) of recipes, and of related rows (recipe_id, related) as keywords."""
    kinds = dict(recipes.dtypes)
    as_text = lambda f: F.array_join(f, "\n") if kinds[f].startswith("array") else F.col(f).cast("string")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), as_text(f).alias("text")) for f in fields if f in kinds])
    out = recipes.select("id", F.explode(pairs).alias("p")).select("id", "p.field", "p.text")
    return out if related is None else out.unionByName(related.select(F.col("recipe_id").alias("id"), F.lit("keywords").alias("field"), F.col("related").alias("text")))


def build(rows: DataFrame, texts: DataFrame, path: str, block_rows: int = ROWS) -> SubstringIndex:
    """Makes the index of rows (id, ...) by their texts (id, field, text) and opens it. Texts of ids that rows lack do no
    harm; null texts are passed over."""
    spark, path = rows.sparkSession, path.rstrip("/")
    blocks = max(1, -(-rows.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    kind = rows.schema["id"].dataType.simpleString()
    rows.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(f"{path}/rows")
    lowered = texts.where(F.col("text").isNotNull()).select("id", "field", F.lower("text").alias("text"), block.alias("block"))
    found = lowered.groupBy("block").applyInArrow(_postings, f"field string, gram bigint, block int, n int, ids array<{kind}>")
    # a trigram that most rows hold has a list in every block: spans of blocks spread it over files. (Ranges of keys would
    # be found by a first run over all of them.)
    found = found.withColumn("part", F.pmod("gram", F.lit(PARTS)).cast("int"))
    found = found.repartition("part", F.floor(F.col("block") / SPAN)).sortWithinPartitions("part", "gram", "field", "block")
    found.write.partitionBy("part").parquet(f"{path}/grams")
    stored = spark.read.parquet(f"{path}/grams")
    counts = stored.groupBy("field", "gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    files, root = store(path)
    with files.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps({"blocks": blocks}).encode())
    return SubstringIndex(spark, path)


class SubstringIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        files, root = store(self.path)
        with files.open_input_stream(f"{root}/index.json") as held:
            self.blocks = json.loads(held.read())["blocks"]
        self.rows = spark.read.parquet(f"{self.path}/rows")
        self.grams, self.counts = spark.read.parquet(f"{self.path}/grams"), spark.read.parquet(f"{self.path}/counts")
        self.fields = {r[0] for r in self.counts.select("field").distinct().collect()}

    def _none(self) -> DataFrame:
        return self.rows.select("block", "id").limit(0)

    def containing(self, field: str, value: str) -> DataFrame | None:
        """(block, id) of the rows whose field may contain the text, in any case; None where that can't be looked up."""
        if not value.isascii():  # lower case as Spark has it, which texts have been put into
            value = self.spark.range(1).select(F.lower(F.lit(value))).first()[0]
        asked = grams(value.lower() if value.isascii() else value)[:LOOKED_AT].tolist()
        if field not in self.fields or not asked:
            return None
        known = self.counts.where((F.col("field") == field) & F.col("gram").isin(asked)).orderBy("n", "gram").collect()
        if len(known) < len(asked):
            return self._none()
        rarest = [r["gram"] for r in known[:RAREST]]
        lists = self.grams.where(F.col("part").isin(sorted({g % PARTS for g in rarest})) & (F.col("field") == field) & F.col("gram").isin(rarest))
        met = lists.groupBy("block").agg(F.collect_list("ids").alias("l")).where(F.size("l") == len(rarest))
        both = F.aggregate(F.slice("l", 2, RAREST), F.element_at("l", 1), F.array_intersect)
        return met.select("block", F.explode(both).alias("id"))

    def _condition(self, c: Condition) -> DataFrame | None:
        return self.containing({"book": "title"}.get(c.field, c.field), c.value) if c.op in POSITIVE else None

    @staticmethod
    def _every(parts: list[DataFrame | None]) -> DataFrame | None:
        parts = [p for p in parts if p is not None]
        return reduce(lambda a, b: a.join(b, ["block", "id"], "left_semi"), parts) if parts else None

    @staticmethod
    def _any(parts: list[DataFrame | None]) -> DataFrame | None:
        return reduce(DataFrame.union, parts) if parts and all(p is not None for p in parts) else None

    def candidates(self, search: Search) -> DataFrame | None:
        """(block, id), some perhaps more than once, of all rows that a search can find; None where it may find any."""
        always, groups = [], []
        for group in search.groups:
            every = group.logic == "and"
            conditions = [c for c in group.conditions if c.op in KNOWN or c.field in RELATIONS]
            always += [self._condition(c) for c in conditions if every and c.binds_a_row]
            rest = [self._condition(c) for c in conditions if not (every and c.binds_a_row)]
            if rest:
                groups.append((self._every if every else self._any)(rest))
        if groups:
            always.append((self._every if search.group_logic == "and" else self._any)(groups))
        if search.text:
            always.append(self._any([self.containing(f, search.text) for f in QUICK if f in self.fields]))
        return self._every(always)

    def narrowed(self, search: Search) -> DataFrame:
        """The rows that a search can find, from the blocks that hold any."""
        found = self.candidates(search)
        if found is None:
            return self.rows.drop("block")
        blocks = sorted(r[0] for r in found.select("block").distinct().collect())  # as many as there are blocks, at most
        return self.rows.where(F.col("block").isin(blocks) if blocks else F.lit(False)).join(found.select("id"), "id", "left_semi").drop("block")
