"""Exact order statistics of several numeric columns by narrowing brackets.

A pass over the rows counts, for every column, how many values lie below, on the bounds
of, and inside each bracket, and sketches the values inside. The sketch proposes narrower
brackets for the ranks still wanted; the counts of the next pass prove or refute them.
Once a bracket is expected to hold few values, a last pass counts those per distinct
value, and only they are put in order. Two passes do for tables up to some millions of
rows, and each further one divides a bracket by about ``1 / (2 * WIDTH)``.

No pass moves a column: a task sends one sketch per bracket, or its counts of values
inside brackets. Sketches are merged in ``GROUPS`` groups of tasks before all meet.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of one bracket that are ordered at most, about, once it is narrow enough.
LIMIT = 50_000
#: Size of a sketch (rank error below 0.2 %), how far a bracket reaches beyond the wanted
#: rank on either side, and the shares at which a sketch is read out.
SKETCH = 2_048
WIDTH = 0.004
GRID = 400
GROUPS = 512

Interval = tuple[float, float]
Wanted = Callable[[int, int], Iterable[int]]


@dataclass(frozen=True)
class Found:
    """An order statistic: its value, the values below it and those equal to it."""

    value: float
    below: int
    equal: int


@dataclass
class ColumnStats:
    """Summary of one column: non-null and null row counts, mean, quantiles."""

    rows: int = 0
    nulls: int = 0
    mean: float | None = None
    quantiles: dict[float, float] = field(default_factory=dict)


@dataclass
class Order:
    """Counts of one column and the order statistics found, by rank from 0."""

    rows: int = 0
    nulls: int = 0
    total: float = 0.0
    found: dict[int, Found] = field(default_factory=dict)

    def quantile(self, p: float) -> float | None:
        """Linear interpolation between neighbouring order statistics."""
        if not self.rows:
            return None
        return _interpolated(p, self.rows, lambda rank: self.found[rank].value)

    def stats(self, probabilities: Iterable[float]) -> ColumnStats:
        mean = self.total / self.rows if self.rows else None
        quantiles = {p: self.quantile(p) for p in probabilities} if self.rows else {}
        return ColumnStats(self.rows, self.nulls, mean, quantiles)

    def filled(self, value: float, probabilities: Iterable[float]) -> ColumnStats:
        """Statistics as they would be with ``value``, the median, in place of the nulls.

        A rank of the filled column is a rank of the column itself, or ``value``: that
        follows from how many values lie below it.
        """
        middle = [self.found[r] for r in _neighbours(0.5, self.rows)]
        same = [f for f in middle if f.value == value]
        below = same[0].below if same else middle[-1].below
        equal = same[0].equal if same else 0

        def at(rank: int) -> float:
            if rank < below:
                return self.found[rank].value
            return value if rank < below + equal + self.nulls else self.found[rank - self.nulls].value

        rows = self.rows + self.nulls
        quantiles = {p: _interpolated(p, rows, at) for p in probabilities}
        return ColumnStats(rows, 0, (self.total + value * self.nulls) / rows, quantiles)


def _neighbours(p: float, rows: int) -> list[int]:
    """Ranks between which the quantile lies; one, if it falls on a rank."""
    position = p * (rows - 1)
    low = int(position)
    return [low, low + 1] if position > low else [low]


def _interpolated(p: float, rows: int, at: Callable[[int], float]) -> float:
    position = p * (rows - 1)
    low = int(position)
    share = position - low
    if share <= 0.0:
        return at(low)
    return at(low) * (1.0 - share) + at(low + 1) * share


def _slot(value: Column, intervals: list[Interval]) -> Column:
    """Where a value lies: 4 i before interval i, then on its low end, inside, on its high end."""
    out = F.when(value.isNull(), F.lit(-1))
    for i, (low, high) in enumerate(intervals):
        out = (
            out.when(value < F.lit(low), F.lit(4 * i))
            .when(value == F.lit(low), F.lit(4 * i + 1))
            .when(value < F.lit(high), F.lit(4 * i + 2))
            .when(value == F.lit(high), F.lit(4 * i + 3))
        )
    return out.otherwise(F.lit(4 * len(intervals)))


def _placed(df: DataFrame, columns: Mapping[str, Column], intervals: Mapping[str, list[Interval]]) -> DataFrame:
    """(column, slot, value) of every cell, with the group of its task."""
    names = list(intervals)
    held = df.select(*[columns[n].cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    cells = [
        F.struct(F.lit(n).alias("column"), _slot(F.col(f"c{i}"), intervals[n]).alias("slot"), F.col(f"c{i}").alias("value"))
        for i, n in enumerate(names)
    ]
    return held.select(F.inline(F.array(*cells)), (F.spark_partition_id() % GROUPS).alias("part"))


def _inside() -> Column:
    return (F.col("slot") >= 0) & (F.col("slot") % 4 == 2)


def _sketched(placed: DataFrame) -> DataFrame:
    """(column, slot, rows, total, grid): counts of the slots, quantiles of the values inside brackets."""
    sketch = F.kll_sketch_agg_double(F.when(_inside(), F.col("value")), F.lit(SKETCH))
    parts = placed.groupBy("part", "column", "slot").agg(
        F.count("*").alias("rows"), F.sum("value").alias("total"), sketch.alias("sketch")
    )
    merged = parts.groupBy("column", "slot").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    shares = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    grid = F.when(_inside(), F.kll_sketch_get_quantile_double("sketch", shares))
    return merged.select("column", "slot", "rows", "total", grid.alias("grid"))


def _counted(placed: DataFrame) -> DataFrame:
    """(column, slot, value, rows): counts of the slots, inside brackets per distinct value."""
    value = F.when(_inside(), F.col("value")).alias("value")
    return placed.select("column", "slot", value).groupBy("column", "slot", "value").agg(F.count("*").alias("rows"))


def _apart(intervals: Iterable[Interval]) -> list[Interval]:
    """Intervals in order, those that meet made one."""
    out: list[Interval] = []
    for low, high in sorted(set(intervals)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


class _Search:
    """Ranks of one column that are still wanted, and the brackets they are looked for in."""

    def __init__(self):
        self.order = Order()
        self.open: list[int] = []
        self.intervals: list[Interval] = [(-math.inf, math.inf)]

    def place(self, rows: Mapping[int, int], limit: int, grids: Mapping[int, list[float]] | None, values: Mapping[int, list]) -> int:
        """Take in one pass; the values expected inside the widest bracket that is left.

        ``rows`` are the rows of each slot, ``grids`` the sketches read out or None,
        ``values`` the (value, rows) inside brackets.
        """
        slots = sorted(s for s in rows if s >= 0)
        starts, seen = [], 0
        for s in slots:
            starts.append(seen)
            seen += rows[s]
        ordered = {s: sorted(v) for s, v in values.items()}
        running = {}
        for s, pairs in ordered.items():
            running[s] = [0]
            for _, n in pairs:
                running[s].append(running[s][-1] + n)
        left, narrowed, widest = [], [], 0
        for rank in self.open:
            k = bisect_right(starts, rank) - 1
            slot, start, inner = slots[k], starts[k], rank - starts[k]
            i, kind = divmod(slot, 4)
            if kind in (1, 3):
                self.order.found[rank] = Found(self.intervals[i][kind // 2], start, rows[slot])
            elif kind == 2 and grids is None:
                j = bisect_right(running[slot], inner) - 1
                value, n = ordered[slot][j]
                self.order.found[rank] = Found(value, start + running[slot][j], n)
            else:
                left.append(rank)
                if kind == 0:
                    # A refuted bracket: the rank is in the gap before bracket i.
                    low = self.intervals[i - 1][1] if i else -math.inf
                    narrowed.append((low, self.intervals[i][0] if i < len(self.intervals) else math.inf))
                    widest = max(widest, rows[slot])
                elif rows[slot] <= limit:
                    narrowed.append(self.intervals[i])
                    widest = max(widest, rows[slot])
                else:
                    grid, share = grids[slot], inner / rows[slot]
                    low = max(0, math.floor((share - WIDTH) * GRID))
                    high = min(GRID, math.ceil((share + WIDTH) * GRID))
                    narrowed.append((grid[low], grid[high]))
                    widest = max(widest, math.ceil(rows[slot] * (high - low) / GRID))
        self.open, self.intervals = left, _apart(narrowed)
        return widest


def order_statistics(df: DataFrame, columns: Mapping[str, Column], wanted: Wanted, limit: int = LIMIT) -> dict[str, Order]:
    """Counts of each column, and the order statistics at the ranks ``wanted(rows, nulls)``."""
    searches = {name: _Search() for name in columns}
    first, few = True, False
    while todo := {n: s for n, s in searches.items() if first or s.open}:
        placed = _placed(df, columns, {n: s.intervals for n, s in todo.items()})
        # Slots of brackets, and at most about ``limit`` values of each narrow bracket.
        result = (_counted(placed) if few else _sketched(placed)).collect()
        widest = 0
        for name, s in todo.items():
            mine = [r for r in result if r["column"] == name]
            rows: dict[int, int] = {}
            for r in mine:
                rows[r["slot"]] = rows.get(r["slot"], 0) + r["rows"]
            if first:
                s.order.nulls = rows.get(-1, 0)
                s.order.rows = sum(rows.values()) - s.order.nulls
                s.order.total = sum(r["total"] for r in mine if r["slot"] >= 0)
                s.open = sorted({r for r in wanted(s.order.rows, s.order.nulls) if 0 <= r < s.order.rows})
            values: dict[int, list] = {}
            if few:
                for r in mine:
                    if r["slot"] >= 0 and r["slot"] % 4 == 2:
                        values.setdefault(r["slot"], []).append((r["value"], r["rows"]))
            grids = None if few else {r["slot"]: r["grid"] for r in mine}
            widest = max(widest, s.place(rows, limit, grids, values))
        first, few = False, widest <= 2 * limit
    return {name: s.order for name, s in searches.items()}


def column_stats(
    df: DataFrame, columns: Mapping[str, Column], probabilities: list[float], limit: int = LIMIT
) -> dict[str, ColumnStats]:
    """Exact statistics of each column; quantiles interpolate between neighbouring ranks."""

    def wanted(rows: int, nulls: int) -> list[int]:
        return [r for p in probabilities for r in _neighbours(p, rows)] if rows else []

    return {n: o.stats(probabilities) for n, o in order_statistics(df, columns, wanted, limit).items()}


def stats_before_and_after_fill(
    df: DataFrame, columns: Mapping[str, Column], probabilities: list[float], limit: int = LIMIT
) -> dict[str, tuple[ColumnStats, ColumnStats]]:
    """Each column's statistics with its median, and those after the median has replaced the nulls.

    One search serves both: the ranks of the filled column are looked for on either side
    of the median.
    """

    def wanted(rows: int, nulls: int) -> set[int]:
        if not rows:
            return set()
        later = [r for p in probabilities for r in _neighbours(p, rows + nulls)]
        return {*_neighbours(0.5, rows), *later, *(r - nulls for r in later)}

    out = {}
    for name, order in order_statistics(df, columns, wanted, limit).items():
        before = order.stats([0.5])
        after = order.filled(before.quantiles[0.5], probabilities) if order.rows else ColumnStats()
        out[name] = (before, after)
    return out
