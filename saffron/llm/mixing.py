"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources share ratio x (all sizes) by weight, each stopping at `most` times its own size, the excess going to
the others by weight.

Blocks: within its source, documents stand in the order of a hash of their id; their words, repeated from the start as
often as the target needs, form a stream that is cut at the target and into blocks of BLOCK words. Slots: as many as
there are blocks; slot t has the point of the golden-ratio sequence, t times the golden section modulo 1, which the
cumulative block counts of the sources map to a source. The r-th slot of a source takes its r-th block; a block that
got no slot, as the schedule is off by a few slots (by one more for every MODULUS slots, after which the points come
round again), follows after the last one. So any stretch of the mix holds each
source nearly at its share, and each source's words come to its target exactly.

Ranks and running sums are taken within chunks of a source (by the first CHUNK_DIGITS of a hash for documents, RUN slots
for the schedule) and carried over by the chunks' totals, so no task holds a source. Rows equal in id and size are one
unit in this order, so that rows of one id, or without one, are few units however many they are.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own,
last in order; an empty table gives an empty mix. Rows that repeat take their own places; rows equal in id, source and
size may swap theirs, which changes no result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK = 1024
#: Chunks of each source's documents, a power of 16 as they are hexadecimal digits of a hash.
CHUNK_DIGITS = 3
#: Rows equal in id, source and size are ranked together within so many bits of a row's number in its partition.
CHUNK_BITS = 14
#: Slots ranked together.
RUN = 1 << 16
#: The golden section as an odd share of this modulus; a cell is what a source's interval is joined by.
MODULUS, STEP = 1 << 31, 1327217885
CELL = 1 << 21


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size in words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sources: DataFrame, weights: tuple = WEIGHTS, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources stop in the order of most * size / weight; the level of those that do not is what the stopped ones leave,
    shared by weight. The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("weight", weight).withColumn("stop", cap / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(ratio)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level falls from each source that could stop to the next, so the first that no source stops below is the highest
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything)
    return ranked.withColumn("share", level).select("source", "source_size", F.least(cap, F.coalesce(F.col("weight") * F.col("share"), cap)).alias("target"))


def _key(source) -> F.Column:
    """A name under which a null source joins: no source begins with the prefix of another kind."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _before(totals: DataFrame, by: str, chunk: str, value: str) -> DataFrame:
    """For each chunk, the sum of value over the earlier chunks of its key."""
    earlier = Window.partitionBy(by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def placed(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source_key, doc_id, size, source_size, target, start): each unit of sizes (source, place, doc_id, size) with its
    first word's place in its source, in the order of place, doc_id, size."""
    keyed = sizes.select(_key(F.col("source")).alias("source_key"), F.substring("place", 1, CHUNK_DIGITS).alias("chunk"), "place", "doc_id", "size")
    totals = keyed.groupBy("source_key", "chunk").agg(F.sum("size").alias("words"))
    base = _before(totals, "source_key", "chunk", "words").join(goals.select(_key(F.col("source")).alias("source_key"), "source_size", "target"), "source_key")
    inside = Window.partitionBy("source_key", "chunk").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = within.join(base.select("source_key", "chunk", "before", "source_size", "target"), ["source_key", "chunk"])
    return out.select("source_key", "doc_id", "size", "source_size", "target", (F.col("before") + F.col("within")).alias("start"))


def pieces(rows: DataFrame) -> DataFrame:
    """(source_key, block, row, start, words): the part of each row of _ranked() that each block holds."""
    goal = rows.withColumn("goal", F.floor("target").cast("long"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("goal") / F.col("source_size")).cast("long") - 1)
    taken = goal.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    taken = taken.withColumn("lo", F.col("start") + F.col("round") * F.col("source_size"))
    taken = taken.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal"))).where("lo < hi")
    taken = taken.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}"))))
    words = F.least("hi", (F.col("block") + 1) * BLOCK) - F.greatest("lo", F.col("block") * BLOCK)
    return taken.select("source_key", "block", "row", "start", words.alias("words"))


def numbered_blocks(counts: DataFrame) -> DataFrame:
    """(source_key, slots, block) for the numbers below each row's `blocks`, made run by run, so that no row holds an array
    longer than a run or the number of runs."""
    runs = counts.select("source_key", "slots", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {RUN}"))).alias("run"))
    runs = runs.repartition("source_key", "run")
    return runs.select("source_key", "slots", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("blocks")) - 1)).alias("block"))


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, source_key, block): where in the mix each block of each source stands."""
    counts = goals.select(_key(F.col("source")).alias("source_key"), F.ceil(F.floor("target") / BLOCK).cast("long").alias("blocks")).where("blocks > 0")
    running = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("blocks").over(running), F.lit(0))).withColumn("slots", F.sum("blocks").over(Window.partitionBy()))
    counts = counts.withColumn("lo", F.floor(F.col("first") / F.col("slots") * MODULUS).cast("long")).withColumn("hi", F.floor((F.col("first") + F.col("blocks")) / F.col("slots") * MODULUS).cast("long"))
    cells = counts.select("source_key", "blocks", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {CELL}"), F.expr(f"greatest(lo, hi - 1) div {CELL}"))).alias("cell"))

    # the slots of one run for each row, then one row for each slot
    total = counts.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("slots"))
    runs = total.select("slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"slots div {RUN}"))).alias("run")).repartition("run")
    slots = runs.select("run", "slots", F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("slots")) - 1)).alias("slot")).where(f"slot >= run * {RUN} and slot < slots")
    slots = slots.withColumn("point", F.col("slot") % MODULUS * STEP % MODULUS).withColumn("cell", F.expr(f"point div {CELL}"))
    drawn = slots.join(cells, "cell").where("point >= lo and point < hi").select("run", "slot", "source_key")

    in_run = Window.partitionBy("source_key", "run").orderBy("slot")
    per_run = _before(drawn.groupBy("source_key", "run").agg(F.count("*").alias("n")), "source_key", "run", "n")
    ranked = drawn.withColumn("rank", F.row_number().over(in_run) - 1).join(per_run.select("source_key", "run", "before"), ["source_key", "run"])
    ranked = ranked.select("source_key", (F.col("before") + F.col("rank")).alias("block"), "slot")
    blocks = numbered_blocks(counts)
    return blocks.join(ranked.hint("merge"), ["source_key", "block"], "left").select(F.coalesce("slot", F.col("slots") + F.col("block")).alias("slot"), "source_key", "block")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a written table, and the number's column."""
    row, n = "_row", 0
    while row in docs.columns:
        row, n = f"_row{n}", n + 1
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def _ranked(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (row, source_key, source, id, size, hash) with source_size, target and start, where their first word stands
    in their source. Rows equal in id, source, size and hash are one unit in the order, by parts of the table, and are
    ranked within a part, so a group of any size is never in one task."""
    key = ["source_key", "id", "size", "hash", "part"]
    rows = rows.withColumn("part", F.shiftright("row", CHUNK_BITS))
    units = rows.groupBy("source", *key).agg(F.sum("size").alias("words"))
    named = F.struct(F.col("id").try_cast("long").alias("doc_id"), *key[1:]).alias("doc_id")
    starts = placed(units.select("source", F.md5("id").alias("place"), named, F.col("words").alias("size")), goals)
    starts = starts.select("source_key", *[F.col(f"doc_id.{c}").alias(c) for c in key[1:]], "source_size", "target", "start")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("row")) - 1).join(starts.hint("merge"), key)
    return ranked.select("row", "source_key", "size", "source_size", "target", (F.col("start") + F.col("rank") * F.col("size")).alias("start"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, ratio: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(documents, plan): documents has (doc_id, size, source_size, target, taken, first_slot, n_slots) for each row of
    docs (doc_id, text, source); plan has (slot, source_key, block, row, start, words), the mix in the order of slot, then
    start. taken are the words of a row that the plan's slots hold, first_slot and n_slots the first of these and how
    many there are."""
    sizes = cut(_numbered(sized(docs))[0].withColumnRenamed("_row", "row"))
    goals = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, most))
    some = sizes.where("size > 0").select("row", "source", _key(F.col("source")).alias("source_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size", F.lit(0).alias("hash"))
    rows = cut(_ranked(some, goals))
    plan = cut(pieces(rows).join(schedule(goals).hint("merge"), ["source_key", "block"]))
    per_row = plan.groupBy("row").agg(F.sum("words").alias("words"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    of_source = goals.select(_key(F.col("source")).alias("source_key"), "source_size", "target")
    documents = sizes.withColumn("source_key", _key(F.col("source"))).join(of_source, "source_key").join(per_row.hint("merge"), "row", "left")
    return documents.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots")), plan


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs as often as the mix begins them, with all their columns, sorted by where the schedule begins each
    copy: its slot, then its first word. A document that the mix begins is kept whole, so a source passes its target by
    less than one document. Each row has its own place, also among rows equal in id, source and size."""
    kept, row = _numbered(docs)
    kept = cut(kept)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = kept.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("hash"),
        F.col(row).alias("row"),
    )
    rows = cut(rows.where("size > 0").withColumn("source_key", _key(F.col("source"))))
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, ratio, most))
    ranked = _ranked(rows, goals).withColumn("goal", F.floor("target").cast("long"))
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("goal") / F.col("source_size")).cast("long") - 1)
    begun = ranked.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    begun = begun.withColumn("first", F.col("start") + F.col("round") * F.col("source_size")).where("first < goal")
    begun = begun.withColumn("block", F.expr(f"first div {BLOCK}")).join(schedule(goals).hint("merge"), ["source_key", "block"])
    begun = cut(begun.select(F.col("row").alias("_begun"), F.struct("slot", "first").alias("_at")))
    return kept.alias("d").join(begun.alias("b"), F.col(f"d.{row}") == F.col("b._begun")).orderBy("b._at").select(*[F.col(f"d.`{c}`") for c in docs.columns])
