"""The extraction workflow as a state machine over a stream: one state a book, kept by Structured Streaming.

Events (book_id, seq, at, kind, flag, value) report what happened to a book, in the order of seq:

    analysed    value is the kind of extraction, 'block' or any other
    extracted   flag tells whether a recipe has an image
    resolved    flag tells whether an image was found in the archive
    decision    value is a person's answer, 'has_images' or any other

The event that a book's stage waits for moves it on by the rules of operators.workflow; events that come before their
stage does are kept for it, and those passed over by a later one of its kind are dropped. Decisions may come from another
stream; a book's first one counts, whenever it comes, and its seq doesn't matter. A book in review for longer than
`patience` becomes 'overdue' in the first batch after; a decision moves it on all the same. No event is too late.

A book's state is its row of the bucketed table that stream_into() keeps, so a batch is one join of its events, gathered by
book, with the buckets they touch, and a stopped stream goes on from the table's last version. (A store of states beside
the table asks Python for each book's state in a call of its own.)
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import Fold

#: What a book's stage waits for; 'finalise' waits for nothing.
WAITS = {"analyse": "analysed", "extract_file": "extracted", "extract_block": "extracted", "await_human": "decision", "resolve_images": "resolved"}
KEPT = pa.list_(pa.struct([("seq", pa.int64()), ("kind", pa.string()), ("flag", pa.bool_()), ("value", pa.string())]))
#: A book's row: its turn counts the batches in which it moved, `at` is the last event's time of that batch in
#: microseconds, `seen` the seq of the last event that moved it, `due` the millisecond at which its review is overdue.
STATE = pa.schema([("book_id", pa.string()), ("steps", pa.int32()), ("turn", pa.int32()), ("stage", pa.string()), ("status", pa.string()), ("tried", pa.list_(pa.string())), ("response", pa.string()), ("at", pa.int64()), ("seen", pa.int64()), ("kept", KEPT), ("due", pa.int64())])
STATE_DDL = "book_id string, steps int, turn int, stage string, status string, tried array<string>, response string, at bigint, seen bigint, kept array<struct<seq:bigint,kind:string,flag:boolean,value:string>>, due bigint"


def after(stage: str, flag: bool | None, value: str | None, tried: list[str], response: str | None) -> str:
    """The next stage; validation follows extraction at once."""
    if stage == "analyse":
        return "extract_block" if value == "block" else "extract_file"
    if stage in ("extract_file", "extract_block"):
        return "resolve_images" if flag or "block" in tried else "await_human"
    if stage == "await_human":
        return "extract_block" if value == "has_images" else "resolve_images"
    return "finalise" if flag or response is not None or "block" in tried else "await_human"


def advanced(book_id: str | None, old: dict | None, came: list[dict] | None, now: int, patience: int) -> tuple:
    """A book's row after the events of a batch, in the order of STATE."""
    held = old or {"steps": 0, "turn": 0, "stage": "analyse", "status": "running", "tried": [], "response": None, "at": None, "seen": -1, "kept": [], "due": None}
    stage, status, response, steps, turn, at, seen, due = (held[k] for k in ("stage", "status", "response", "steps", "turn", "at", "seen", "due"))
    before, tried, was_due = (stage, status, steps), held["tried"], due
    if came:
        new = {(c["seq"], c["kind"], c["flag"], c["value"]) for c in came}
        kept = {(k["seq"], k["kind"], k["flag"], k["value"]) for k in held["kept"]} | {c for c in new if c[1] == "decision" or c[0] > seen}
        kept = sorted(kept, key=lambda k: (k[0], str(k)))
        while stage != "finalise" and (event := next((k for k in kept if k[1] == WAITS[stage]), None)) is not None:
            seq, kind, flag, value = event
            if kind == "decision":
                response = value
                kept = [k for k in kept if k[1] != "decision" and k[0] > seen]
            else:
                seen = seq
                kept = [k for k in kept if k[1] == "decision" or k[0] > seen]
            if stage in ("extract_file", "extract_block") and stage[8:] not in tried:
                tried = [*tried, stage[8:]]
            stage, steps = after(stage, flag, value, tried, response), steps + 1
        kept = [] if stage == "finalise" else kept
        status = "done" if stage == "finalise" else "running" if stage != "await_human" else status if status == "overdue" else "review"
        if status == "review" and before[1] != "review":
            due = now + patience
        if old is None or (stage, status, steps) != before:
            turn, at = turn + 1, max((c["at"] for c in came if c["at"] is not None), default=None)
    else:
        kept = held["kept"]
    due = due if status == "review" else None
    if due is not None and due == was_due and due <= now:
        status, due, turn, at = "overdue", None, turn + 1, None
    return book_id, steps, turn, stage, status, tried, response, at, seen, [dict(zip(("seq", "kind", "flag", "value"), k, strict=True)) if isinstance(k, tuple) else k for k in kept], due


def transitions(steps: DataFrame, decisions: DataFrame, patience: timedelta = timedelta(days=30)) -> Fold:
    """The states that books come to, for stream_into(). steps and decisions are streams of events."""
    shape = [F.col("book_id").cast("string").alias("book_id"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "kind", F.col("flag").cast("boolean").alias("flag"), F.col("value").cast("string").alias("value")]
    wait = int(patience.total_seconds() * 1000)

    def moved(now: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [advanced(*row, now, wait) for row in zip(*(batch.column(c).to_pylist() for c in ("book_id", "_old", "_came")), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), STATE, strict=True)], schema=STATE)

        return run

    return Fold(steps.select(*shape).union(decisions.select(*shape)), STATE_DDL, moved, lambda now: (F.col("status") == "review") & (F.col("due") <= now))
