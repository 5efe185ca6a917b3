"""Pages of a sorted result by number, at any depth: a page touches one narrow range of the sort's keys.

A range is split at SPLITS of its rows' keys, taken from a sample, and the rows of each part are counted; the counts of
the parts before are carried. The part that holds a page is split again until it has at most NARROW rows, and only those
are sorted. Each split reads the result once, filtered by the range's bounds; splits and counts are kept, so pages near
each other cost no further split. The driver holds SPLITS keys and counts for each split. Rows equal in every key of the
sort can't be split; they are sorted together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS, SAMPLE, NARROW = 32, 2048, 100_000


@dataclass
class Range:
    """Rows after `low` (itself not among them) up to `high`; None: no bound. before: rows of the result before it."""

    low: tuple | None
    high: tuple | None
    before: int
    rows: int
    parts: list[Range] = field(default_factory=list)
    whole: bool = False


class Pages:
    """past(order, key, forward) tells whether a row comes after (before) the one with a key."""

    def __init__(self, rows: DataFrame, order: list, past: Callable[[list, tuple, bool], Column], narrow: int = NARROW, total: int | None = None):
        self.rows, self.order, self.past, self.narrow = rows, order, past, narrow
        self.total = rows.count() if total is None else total
        self.top = Range(None, None, 0, self.total)

    def within(self, r: Range) -> DataFrame:
        rows = self.rows
        if r.low is not None:
            rows = rows.where(self.past(self.order, r.low, True))
        if r.high is not None:
            rows = rows.where(~self.past(self.order, r.high, True))
        return rows

    def split(self, r: Range) -> None:
        """Gives a range its parts, or finds that it can't be split."""
        keys = [k.column.alias(f"k{i}") for i, k in enumerate(self.order)]
        rows = self.within(r)
        some = rows.sample(min(1.0, SAMPLE / r.rows), seed=1).select(*keys)
        sorted_by = [(F.desc_nulls_last if k.down else F.asc_nulls_first)(f"k{i}") for i, k in enumerate(self.order)]
        sample = [tuple(x) for x in some.distinct().orderBy(*sorted_by).collect()]  # about SAMPLE rows
        step = max(1, len(sample) // SPLITS)
        bounds = sample[step - 1 :: step] if sample else []
        if r.high in bounds:
            bounds.remove(r.high)
        if not bounds:
            r.whole = True
            return
        # how many bounds a row is beyond is the number of its part
        part = sum((self.past(self.order, b, True).cast("int") for b in bounds[1:]), self.past(self.order, bounds[0], True).cast("int"))
        counts = dict(rows.groupBy(part.alias("p")).count().collect())
        before = r.before
        for i, (low, high) in enumerate(zip([r.low, *bounds], [*bounds, r.high], strict=True)):
            r.parts.append(Range(low, high, before, counts.get(i, 0)))
            before += counts.get(i, 0)
        r.whole = max(p.rows for p in r.parts) == r.rows

    def ranges(self, lo: int, hi: int) -> list[Range]:
        """Narrow ranges that hold the rows lo to hi of the result."""
        found, left = [], [self.top]
        while left:
            r = left.pop()
            if r.rows == 0 or r.before >= hi or r.before + r.rows <= lo:
                continue
            if r.rows > self.narrow and not r.whole and not r.parts:
                self.split(r)
            if r.rows <= self.narrow or r.whole:
                found.append(r)
            else:
                left += r.parts
        return sorted(found, key=lambda r: r.before)

    def page(self, number: int, per_page: int) -> DataFrame:
        """The rows of a page in order; a page beyond the last is the last."""
        number = min(max(1, number), max(1, -(-self.total // per_page)))
        lo, hi = (number - 1) * per_page, min(number * per_page, self.total)
        sort = [k.sorted() for k in self.order]
        near = self.ranges(lo, hi)
        if not near:
            return self.rows.limit(0)
        joined = Range(near[0].low, near[-1].high, near[0].before, sum(r.rows for r in near))
        return self.within(joined).orderBy(*sort).offset(lo - joined.before).limit(hi - lo)
