"""CSV whose quoted fields hold line breaks, read by many tasks a file.

Lines are read by Spark's text source, which cuts files into splits. Whether a line begins
inside quotes depends on all that stands before it in the file, so each line is taken as a
map from the state before it to the state after it, outside (0) or inside (1) quotes. Such
maps compose: a first pass composes those of each split, a window over the splits of a file
(one row a split) settles the state each split begins with, and the lines are read again
and their own states settled. A line that begins and ends outside is a record by itself;
a scan of its own shuffles the lines of longer records, by their record.

A quote opens a field only at its start, and closes it where it is not doubled; what
follows up to the delimiter belongs to the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}

_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_OPEN = re.compile(rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+"{_QUOTED}')
_CLOSED = re.compile(rf'{_QUOTED}"[^,]*+(,?)')


def _after(line: str) -> tuple[int, int]:
    """The states after a line that begins outside, and inside quotes."""
    outside = int(_OPEN.fullmatch(line) is not None)
    end = _CLOSED.match(line)
    if end is None:
        return outside, 1
    return outside, int(bool(end[1]) and _OPEN.fullmatch(line, end.end()) is not None)


class _Split:
    """States and record numbers along one split, for both states it may begin with."""

    def __init__(self, path: str, start: int):
        self.path, self.start = path, start
        self.state, self.records, self.lines = [0, 1], [0, 0], 0

    def take(self, values: pa.Array) -> dict[str, np.ndarray]:
        n = len(values)
        after = np.zeros((2, n), np.int8)
        after[1] = 1
        for i in np.flatnonzero(pc.count_substring(values, '"').to_numpy(zero_copy_only=False)):
            after[:, i] = _after(values[int(i)].as_py())
        empty = pc.is_in(values, pa.array(["", "\r"], values.type)).to_numpy(zero_copy_only=False)
        turns = np.cumsum(after[0] > after[1])
        fixed = np.maximum.accumulate(np.where(after[0] == after[1], np.arange(n), -1))
        out = {"line": np.arange(self.lines, self.lines + n)}
        for h in (0, 1):
            since = np.where(fixed < 0, turns, turns - turns[fixed])
            end = (np.where(fixed < 0, self.state[h], after[0][fixed]) + since) % 2
            begin = np.concatenate([[self.state[h]], end[:-1]])
            record = self.records[h] + np.cumsum((begin == 0) & ~empty)
            out |= {f"begin{h}": begin.astype(np.int8), f"end{h}": end.astype(np.int8), f"record{h}": record}
            # An empty line outside quotes is no record.
            out[f"none{h}"] = (begin == 0) & empty
            self.state[h], self.records[h] = int(end[-1]), int(record[-1])
        self.lines += n
        return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """A batch cut where another split begins."""
    path, start = batch.column("path"), batch.column("start")
    n = batch.num_rows
    changed = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1]))
    cuts = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield path[a].as_py(), start[a].as_py(), batch.slice(a, b - a)


def _along(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[_Split, pa.RecordBatch, dict[str, np.ndarray]]]:
    split = None
    for batch in batches:
        if batch.num_rows:
            for path, start, part in _runs(batch):
                if split is None or (split.path, split.start) != (path, start):
                    split = _Split(path, start)
                yield split, part, split.take(part.column("value"))


_SPLITS = "path string, start long, after0 tinyint, after1 tinyint, records0 long, records1 long"
_LINES = "path string, start long, value string, line long, " + ", ".join(
    f"begin{h} tinyint, end{h} tinyint, record{h} long, none{h} boolean" for h in (0, 1)
)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(s: _Split) -> pa.RecordBatch:
        arrays = [
            pa.array([s.path]),
            pa.array([s.start], pa.int64()),
            *[pa.array([x], pa.int8()) for x in s.state],
            *[pa.array([x], pa.int64()) for x in s.records],
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SPLITS.split(", ")])

    last = None
    for split, _, _ in _along(batches):
        if last is not None and last is not split:
            yield row(last)
        last = split
    if last is not None:
        yield row(last)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _LINES.split(", ")]
    for _, part, found in _along(batches):
        columns = {**{c: part.column(c) for c in ("path", "start", "value")}, **{k: pa.array(v) for k, v in found.items()}}
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _settled(splits: DataFrame) -> DataFrame:
    """(path, start, state, owner, owner_record): the state a split begins with, and the
    record that was open there."""
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.col("after0") > F.col("after1")
    turned = splits.withColumn("_turns", F.sum(turn.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct("after0", "_turns"))
    turned = turned.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "_before", F.coalesce(F.max("_turns").over(before), F.lit(0))
    )
    state = (
        F.coalesce(F.col("_fixed.after0").cast("long"), F.lit(0))
        + F.col("_before")
        - F.coalesce(F.col("_fixed._turns"), F.lit(0))
    ) % 2
    known = turned.withColumn("state", state.cast("int"))
    records = F.when(F.col("state") == 0, F.col("records0")).otherwise(F.col("records1"))
    owner = F.last(F.when(records > 0, F.struct("start", records.alias("record"))), ignorenulls=True).over(before)
    owned = known.withColumn("_owner", owner)
    return owned.select("path", "start", "state", F.col("_owner.start").alias("owner"), F.col("_owner.record").alias("owner_record"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, record, value): the records of CSV files, in one piece each.

    ``start`` is the first byte of the split a record begins in and ``record`` its number
    there, from 1. Empty lines between records are none. Records end with a line feed; where
    a carriage return stands before it, such pairs inside quotes become line feeds too.
    """

    def scan() -> DataFrame:
        lines = spark.read.option("lineSep", "\n").text(path)
        return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    settled = _settled(scan().mapInArrow(_splits, _SPLITS))
    # One row a split, so lines need no shuffle to meet them.
    held = scan().mapInArrow(_lines, _LINES).join(F.broadcast(settled), ["path", "start"], "left")
    state = F.coalesce(F.col("state"), F.raise_error(F.lit("the splits changed between two passes")).cast("int"))

    def chosen(name: str) -> Column:
        return F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")).alias(name)

    lines = (
        held.withColumn("state", state)
        .select(*[chosen(c) for c in ("begin", "end", "record", "none")], "path", "start", "line", "value", "owner", "owner_record")
        .filter(~F.col("none"))
    )
    alone = (F.col("begin") == 0) & (F.col("end") == 0)
    keys = ["path", "start", "record"]
    single = lines.filter(alone).select(*keys, "value")
    pieces = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), "line", "value")))
    longer = (
        lines.filter(~alone)
        .withColumn("_first", F.col("record") > 0)
        .groupBy(
            "path",
            F.when(F.col("_first"), F.col("start")).otherwise(F.col("owner")).alias("_start"),
            F.when(F.col("_first"), F.col("record")).otherwise(F.col("owner_record")).alias("_record"),
        )
        .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
        .select("path", F.col("_start").alias("start"), F.col("_record").alias("record"), "value")
    )
    whole = single.unionByName(longer)
    bare = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), r"\r\z", "")
    return whole.withColumn("value", F.when(F.col("value").endswith("\r"), bare).otherwise(F.col("value")))


def read(spark: SparkSession, path: str | list[str], schema: T.StructType, path_column: str | None = None) -> DataFrame:
    """The fields of CSV files with a header, by Spark's own parser record by record."""
    if not schema.fields:
        return spark.createDataFrame([], schema if path_column is None else schema.add(path_column, "string"))
    rows = records(spark, path).filter("NOT (start = 0 AND record = 1)")
    layout = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    fields = F.from_csv("value", layout, OPTIONS).alias("_fields")
    parsed = rows.select("path", fields)
    named = [F.col(f"_fields.c{i}").alias(f.name) for i, f in enumerate(schema.fields)]
    if path_column:
        named.append(F.col("path").alias(path_column))
    return parsed.select(*named)
